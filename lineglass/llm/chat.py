"""Multi-party perspective rotation of dialogues.

Every participant of a conversation is the assistant once: that speaker's turns are
rendered as the assistant's and count for training, all others are named users. Long
conversations come in parts of consecutive turns, so no row grows without bound and no
turn is lost.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Roles that give context and take no part.
CONTEXT = ("system",)
# Turns of a part.
TURNS = 64
BEGIN, END = "<|im_start|>", "<|im_end|>"
# What stands for the markers' opening where it is a part of a text or a name.
MARK, PLAIN = "<|", "< |"


def _numbered(turns: DataFrame) -> DataFrame:
    """The place of each turn within its conversation, without gaps.

    Turns are numbered within blocks of their turn number and moved by the sizes of the
    blocks before, so a long conversation is no single task's.
    """
    cut = turns.withColumn("block", F.floor(F.coalesce(F.col("turn"), F.lit(-(2**62))) / TURNS))
    sizes = cut.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("conv").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("conv", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = W.partitionBy("conv", "block").orderBy(F.asc_nulls_first("turn"), "speaker", "text")
    ranked = cut.withColumn("place", F.row_number().over(within) - 1)
    same = [ranked.conv.eqNullSafe(starts.conv), ranked.block == starts.block]
    return ranked.join(starts, same).select(ranked.conv, "speaker", "text", (F.col("start") + F.col("place")).alias("place"))


def perspectives(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    speaker_col: str = "role",
    text_col: str = "text",
    context: tuple[str, ...] = CONTEXT,
    turns: int = TURNS,
) -> DataFrame:
    """``conv_id``, ``speaker``, ``part``, ``turns``, ``own_turns``, ``rendered`` and ``mask``.

    A row for every participant and every part of a conversation. ``mask`` has the spans of
    ``rendered`` to be learned, the speaker's texts with their end markers, in code points
    with exclusive ends; it is empty where the speaker is silent. Turns go by their number,
    then speaker and text; a null number comes first, a null text is empty and a null
    speaker is ``unknown``; repeated turns are turns of their own; null conversations are
    one conversation; one that only has context has no participant and no row; an empty
    table gives no rows; other columns play no part.
    """
    plain = lambda c: F.replace(c, F.lit(MARK), F.lit(PLAIN))
    source = conversations.select(
        F.col(conv_col).cast("long").alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        plain(F.coalesce(F.col(speaker_col).cast("string"), F.lit("unknown"))).alias("speaker"),
        plain(F.coalesce(F.col(text_col), F.lit(""))).alias("text"),
    )
    placed = _numbered(source).withColumn("part", F.floor(F.col("place") / turns))
    gives_context = F.col("speaker").isin(*context)
    people = source.where(~gives_context).select("conv", "speaker").distinct().toDF("with", "self")
    parts = placed.groupBy("conv", "part").agg(F.array_sort(F.collect_list(F.struct("place", "speaker", "text"))).alias("all"))
    met = parts.join(people, F.col("conv").eqNullSafe(F.col("with")))

    def head(turn: Column) -> Column:
        who = (
            F.when(turn["speaker"] == F.col("self"), F.lit("assistant"))
            .when(turn["speaker"].isin(*context), turn["speaker"])
            .otherwise(F.concat(F.lit("user name="), turn["speaker"]))
        )
        return F.concat(F.lit(BEGIN), who, F.lit("\n"))

    pieces = F.transform(
        "all",
        lambda t: F.struct(
            F.concat(head(t), t["text"], F.lit(END + "\n")).alias("text"),
            F.length(head(t)).alias("head"),
            (t["speaker"] == F.col("self")).alias("own"),
        ),
    )
    shaped = met.select(F.col("conv").alias("conv_id"), F.col("self").alias("speaker"), "part", pieces.alias("pieces"))
    # At most ``turns`` pieces are walked, with the length so far and the spans found.
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p["text"])).alias("at"),
            F.when(
                p["own"],
                F.array_append(s["spans"], F.concat_ws(":", s["at"] + p["head"], s["at"] + F.length(p["text"]) - 1)),
            ).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    return shaped.select(
        "conv_id",
        "speaker",
        F.col("part").cast("long").alias("part"),
        F.size("pieces").alias("turns"),
        F.size(F.filter("pieces", lambda p: p["own"])).alias("own_turns"),
        F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("rendered"),
        F.array_join(spans, ",").alias("mask"),
    )


PERSPECTIVES_SQL = """
WITH placed AS (
    SELECT conv_id, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), text) - 1 AS place
    FROM conversations
),
people AS (SELECT DISTINCT conv_id, speaker AS self FROM placed WHERE speaker <> 'system'),
seen AS (
    SELECT p.conv_id, q.self, p.place, p.place // 64 AS part, p.speaker = q.self AS own, p.text,
        '<|im_start|>' || CASE WHEN p.speaker = q.self THEN 'assistant' WHEN p.speaker = 'system' THEN 'system'
            ELSE 'user name=' || p.speaker END || chr(10) AS head
    FROM placed p JOIN people q ON p.conv_id IS NOT DISTINCT FROM q.conv_id
),
pieces AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS piece FROM seen),
ends AS (SELECT *, sum(length(piece)) OVER (PARTITION BY conv_id, self, part ORDER BY place) AS stop FROM pieces)
SELECT conv_id, self AS speaker, part, count(*)::INTEGER AS turns, count(*) FILTER (own)::INTEGER AS own_turns,
    string_agg(piece, '' ORDER BY place) AS rendered,
    coalesce(string_agg((stop - length(piece) + length(head))::BIGINT || ':' || (stop - 1)::BIGINT, ',' ORDER BY place)
        FILTER (own), '') AS mask
FROM ends GROUP BY conv_id, self, part
"""
