"""Exact top-k search over binary codes by incremental multi-index hashing.

A code of 64 bits a word is cut into segments of 16 bits, and every segment of every code
is indexed. In round ``r`` the queries that are still open probe each segment's index at
distance ``r`` exactly. A code that no round up to ``r`` has met differs in at least
``segments * (r + 1)`` bits, so a query whose kth distance lies below that is done.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lineglass.llm.common import stored

SEGMENT = 16
WORD = 64
PARTS = WORD // SEGMENT


def sign_code(vector: Column, dims: int) -> list[Column]:
    """The signs of a vector as words of 64 bits: bit i is set where dimension i is above zero."""
    words = []
    for first in range(0, dims, WORD):
        bits = F.transform(
            F.slice(vector, first + 1, min(WORD, dims - first)),
            lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")),
        )
        words.append(F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)).alias(f"w{first // WORD}"))
    return words


def _segments(words: list[Column]) -> list[Column]:
    return [F.shiftrightunsigned(w, SEGMENT * p).bitwiseAND(F.lit((1 << SEGMENT) - 1)) for w in words for p in range(PARTS)]


def _bits(a: list[Column], b: list[Column]) -> list[Column]:
    return [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b)]


def _sum(terms: list[Column]) -> Column:
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def _met(queries: DataFrame, index: DataFrame, words: list[str], radius: int) -> DataFrame:
    """Pairs within the query's bound whose first meeting is in this round, each once."""
    masks = ",".join(str(m) for m in range(1 << SEGMENT) if m.bit_count() == radius)
    q_words = [F.col(f"q_{w}") for w in words]
    parts = F.array(*_segments(q_words))
    probes = (
        queries.select(*q_words, "bound", F.posexplode(parts).alias("seg", "value"))
        .withColumn("mask", F.explode(F.expr(f"array({masks})")))
        .withColumn("key", F.shiftleft(F.col("seg").cast("long"), SEGMENT).bitwiseOR(F.col("value").bitwiseXOR(F.col("mask"))))
        .select(*q_words, "bound", "seg", "key")
    )
    apart = _bits(_segments(q_words), _segments([F.col(w) for w in words]))
    total = _sum(_bits(q_words, [F.col(w) for w in words]))
    first = F.lit(True)
    for i, bits in enumerate(apart):
        first = first & ((F.col("seg") == i) | (bits > radius) | ((bits == radius) & (F.col("seg") < i)))
    # Spark takes the probes to be as few as the queries; they must never be broadcast.
    met = probes.join(index.hint("merge"), (probes.key == index.at) & (total <= F.col("bound")) & first)
    return met.select(*q_words, *words, total.alias("distance"))


def top_k(
    vectors: DataFrame, is_query: Column, k: int, dims: int, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``query_id``, ``rank``, ``neighbor_id`` and ``distance``: the k nearest others of every query row.

    Ties go to the smaller id. Equal codes are searched once, as queries and as results, and
    keep the k + 1 least ids, which is all that a result can need. Shorter vectors are
    continued with zeros; rows without an id or a vector are left out; repeated rows count
    once; with fewer than k others all are returned; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    need = k + 1
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    coded = stored(
        rows.select(
            F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), *sign_code(F.col(vector_col), dims)
        ).distinct(),
        "codes",
    )
    words = [c for c in coded.columns if c not in ("id", "asks")]
    q_names = [f"q_{w}" for w in words]
    by_code = W.partitionBy(*words).orderBy("id")
    least = coded.select("id", *words).distinct().withColumn("n", F.row_number().over(by_code)).where(F.col("n") <= need)
    codes = stored(least.groupBy(*words).agg(F.array_sort(F.collect_list("id")).alias("ids")), "by_code")
    # So many results a query can have at all.
    need_here = min(need, coded.select("id").distinct().count())
    segments = len(words) * PARTS
    parts = F.posexplode(F.array(*_segments([F.col(w) for w in words]))).alias("seg", "value")
    index = stored(
        codes.select(*words, parts).select(
            *words, F.shiftleft(F.col("seg").cast("long"), SEGMENT).bitwiseOR(F.col("value")).alias("at")
        ),
        "segments",
    )
    found_type = "array<struct<distance:int,id:bigint>>"
    asked = coded.where("asks").select(*[F.col(w).alias(q) for w, q in zip(words, q_names)]).distinct()
    state = asked.withColumns({"best": F.array().cast(found_type), "bound": F.lit(WORD * len(words)), "done": F.lit(False)})
    by_query = W.partitionBy(*q_names).orderBy("distance", "id")
    finished = None
    for radius in range(SEGMENT + 1):
        state = stored(state, "queries")
        if not state.where("NOT done").limit(1).count():
            break
        still = state.where("NOT done")
        pairs = _met(still, index, words, radius).join(codes, words)
        new = pairs.select(*q_names, "distance", F.explode("ids").alias("id"))
        old = still.select(*q_names, F.inline("best"))
        ranked = new.unionByName(old).withColumn("n", F.row_number().over(by_query)).where(F.col("n") <= need)
        best = ranked.groupBy(*q_names).agg(F.array_sort(F.collect_list(F.struct("distance", "id"))).cast(found_type).alias("best"))
        full = F.size("best") >= need_here
        last = F.element_at("best", -1)["distance"]
        moved = still.select(*q_names).join(best, q_names, "left").withColumn("best", F.coalesce("best", F.array().cast(found_type)))
        moved = moved.withColumn("bound", F.when(full, last).otherwise(F.lit(WORD * len(words)))).withColumn(
            "done", full & (F.col("bound") < segments * (radius + 1))
        )
        closed = state.where("done")
        finished = closed if finished is None else finished.unionByName(closed)
        state = moved
    else:
        state = stored(state, "queries")
    every = state if finished is None else finished.unionByName(state)
    asks = coded.where("asks").select(F.col("id").alias("query_id"), *[F.col(w).alias(q) for w, q in zip(words, q_names)])
    others = asks.join(every.select(*q_names, "best"), q_names).select(
        "query_id", F.slice(F.filter("best", lambda b: b["id"] != F.col("query_id")), 1, k).alias("best")
    )
    return others.select("query_id", F.posexplode("best").alias("n", "b")).select(
        "query_id", (F.col("n") + 1).alias("rank"), F.col("b.id").alias("neighbor_id"), F.col("b.distance").cast("int").alias("distance")
    )
