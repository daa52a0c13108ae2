"""Secret scan with corpus-wide ownership frequency.

Candidates are found with their places by splitting whole texts at the patterns. Their
hashes are counted by distinct repositories and owners: what many owners have is a copied
example, what one owner has and looks random is a live credential. The base patterns'
spans are reported whatever the counts say; further random-looking strings are reported
where they belong to few owners.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lineglass.llm.common import stored

# The base kinds in the order of their names in a digest, then what is added.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"  # the whole has 20 characters or more; shorter runs hold no longer one
HEX = "[0-9a-f]{24,}"
OPAQUE = "[A-Za-z0-9+/_-]{20,}"
KINDS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "opaque": OPAQUE}
BASE = ("assign", "access", "hex")
VALUE = 6

# Owners from which a value counts as a copied example.
COPIED = 3
# A live-looking value has so many characters, with letters and digits among them.
LIVE = 16


def _found(text: Column) -> Column:
    """For each kind the texts between its matches, as lengths, and the matches."""
    parts = []
    for kind, pattern in KINDS.items():
        between = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        own = F.struct(F.lit(kind).alias("kind"), between.alias("between"), hits.alias("hits"))
        parts.append(F.when(F.regexp_like(text, F.lit(pattern)), own))
    return F.filter(F.array(*parts), lambda p: p.isNotNull())


def _value(kind: Column, hit: Column) -> Column:
    return F.when(kind == "assign", F.regexp_extract(hit, ASSIGN, 2)).otherwise(hit)


def _kept(kind: Column, value: Column) -> Column:
    """Base matches that are long enough; added ones with letters and digits."""
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return F.when(kind == "assign", F.length(value) >= VALUE).when(kind == "opaque", mixed).otherwise(F.lit(True))


def _spans(rows: DataFrame) -> DataFrame:
    """A row for each match that is kept: document, kind, start, end and the hash of its value."""
    parts = rows.select("doc_id", "text_hash", F.explode("found").alias("f")).select(
        "doc_id", "text_hash", "f.kind", F.posexplode(F.arrays_zip("f.between", "f.hits")).alias("nth", "part")
    )
    before = W.partitionBy("doc_id", "text_hash", "kind").orderBy("nth")
    size = F.coalesce(F.length("part.hits"), F.lit(0))
    end = F.sum(F.col("part.between") + size).over(before)
    value = _value(F.col("kind"), F.col("part.hits"))
    placed = parts.withColumns({"end": end, "value": value}).where(F.col("part.hits").isNotNull() & _kept(F.col("kind"), F.col("value")))
    return placed.select(
        "doc_id",
        "text_hash",
        "kind",
        (F.col("end") - F.length("part.hits")).alias("start"),
        "end",
        F.sha2("value", 256).alias("value_hash"),
        (F.length("value") >= LIVE).alias("long_enough") & F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]"),
    ).toDF("doc_id", "text_hash", "kind", "start", "end", "value_hash", "random")


def ownership(rows: DataFrame) -> DataFrame:
    """Distinct repositories and owners of every value's hash."""
    hits = rows.select("owner", "repository", F.explode("found").alias("f")).select(
        "owner", "repository", "f.kind", F.explode("f.hits").alias("hit")
    )
    values = hits.withColumn("value", _value(F.col("kind"), F.col("hit"))).where(_kept(F.col("kind"), F.col("value")))
    once = values.select(F.sha2("value", 256).alias("value_hash"), "owner", "repository").distinct()
    # One row for each value and repository is left; its counts need no distinct of their own.
    owners = once.groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    return owners.groupBy("value_hash").agg(
        F.sum("repositories").alias("repositories"), F.count(F.lit(1)).alias("owners")
    )


def scanned(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: str = "source", repository: str = "lang"
) -> tuple[DataFrame, DataFrame]:
    """The stored rows with their matches, and the classified spans of every document.

    ``repository`` names a repository within its owner. Spans count code points and their
    ends are exclusive; ``verdict`` is ``example`` for values of many owners, ``live`` for
    random-looking ones of few, else ``plain``. Values leave this function as hashes only.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    who = F.coalesce(F.col(owner).cast("string"), F.lit(""))
    rows = stored(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.xxhash64(text).alias("text_hash"),
            who.alias("owner"),
            F.concat_ws("/", who, F.col(repository).cast("string")).alias("repository"),
            _found(text).alias("found"),
        ),
        "candidates",
    )
    hit = rows.where(F.size("found") > 0)
    spans = _spans(hit.dropDuplicates(["doc_id", "text_hash"]))
    # An added string inside a base match is part of it.
    earlier = W.partitionBy("doc_id", "text_hash").orderBy("start", F.col("kind") == "opaque").rowsBetween(W.unboundedPreceding, 0)
    covered = F.max(F.when(F.col("kind") != "opaque", F.col("end"))).over(earlier)
    own = spans.withColumn("covered", covered).where("kind <> 'opaque' OR covered IS NULL OR covered < end").drop("covered")
    verdict = F.when(F.col("owners") >= COPIED, "example").when(F.col("random"), "live").otherwise("plain")
    judged = own.join(ownership(hit), "value_hash").withColumn("verdict", verdict)
    return rows, judged.where("kind <> 'opaque' OR verdict = 'live'").drop("random")


def digests(docs: DataFrame, **columns: str) -> DataFrame:
    """Counts and span digests for every row.

    Null and empty texts have no spans and the hash of an empty list; repeated rows have the
    same digest each; a null id is carried; an empty table gives no rows; of other columns
    only those of owner and repository are read, and null ones count as one owner.
    """
    rows, spans = scanned(docs, **columns)
    order = {kind: n for n, kind in enumerate(KINDS)}
    number = F.coalesce(*[F.when(F.col("kind") == kind, F.lit(n)) for kind, n in order.items()])
    name = F.when(F.col("kind") == "opaque", "owner").otherwise(F.col("kind"))
    listed = F.array_sort(F.collect_list(F.struct("start", number.alias("nth"), name.alias("kind"), "end", "verdict")))

    def joined(some: Column) -> Column:
        return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def many(test) -> Column:
        return F.size(F.filter("all", test)).cast("long")

    found = spans.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(listed.alias("all"))
    met = rows.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left")
    met = met.withColumn("all", F.coalesce("all", F.array().cast(found.schema["all"].dataType)))
    return met.select(
        "doc_id",
        many(lambda s: s["nth"] == order["assign"]).alias("n_assign"),
        many(lambda s: s["nth"] == order["access"]).alias("n_access"),
        many(lambda s: s["nth"] == order["hex"]).alias("n_hex"),
        F.sha2(joined(F.filter("all", lambda s: s["nth"] < len(BASE))), 256).alias("base_sha256"),
        joined(F.col("all")).alias("spans"),
        many(lambda s: s["verdict"] == "live").alias("n_live"),
        many(lambda s: s["verdict"] == "example").alias("n_example"),
    )
