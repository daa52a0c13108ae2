import random

from pyspark.sql import functions as F

from lineglass.llm import hamming

SCHEMA = "vec_id long, embedding array<float>, distance int, ids string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)


def brute(rows, k, asks):
    kept = sorted({(i, tuple(x > 0 for x in v)) for i, v in rows if i is not None and v is not None})
    out = {}
    for q, a in kept:
        if asks(q):
            near = sorted((sum(x != y for x, y in zip(a, b)), i) for i, b in kept if i != q)
            out[q] = near[:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.distance, r.neighbor_id))
        assert r.rank == len(out[r.query_id])
    return out


def random_vectors(n, dims, seed=3):
    r = random.Random(seed)
    rows = [(i, [r.uniform(-1, 1) for _ in range(dims)]) for i in range(n)]
    return rows + [(n + k, rows[k % 3][1]) for k in range(40)]  # groups of copies


def test_equals_brute_force_with_copies_and_ties(spark):
    rows = random_vectors(150, 64)
    got = found(hamming.top_k(vectors(spark, rows), F.col("vec_id") % 20 == 0, 5, 64))
    assert got == brute(rows, 5, lambda i: i % 20 == 0)


def test_codes_of_several_words(spark):
    rows = random_vectors(40, 100)
    got = found(hamming.top_k(vectors(spark, rows), F.col("vec_id") % 20 == 0, 3, 100))
    assert got == brute(rows, 3, lambda i: i % 20 == 0)


def test_odd_rows(spark):
    ones = [1.0] * 64
    rows = [(0, ones), (0, ones), (20, None), (None, ones), (1, [-1.0] * 64), (2, ones), (3, [0.0] * 64)]
    got = found(hamming.top_k(vectors(spark, rows), F.col("vec_id") % 20 == 0, 10, 64))
    assert got == {0: [(0, 2), (64, 1), (64, 3)]}
    empty = vectors(spark, rows).limit(0)
    assert hamming.top_k(empty, F.lit(True), 10, 64).collect() == []
