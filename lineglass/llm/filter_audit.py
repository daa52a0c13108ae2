"""How five quality filters interact: counts of every filter at every step of every order.

Each document gets one fail bit per filter. Documents are then counted by part and by the
32 combinations of bits, together with how many of them are labelled good or toxic. These
per-part counts are reshaped into tensors of shape 2x2x2x2x2 (axis = filter, index 0 =
pass, 1 = fail), and every figure of every step of every order is one contraction: an
einsum with a selector for each axis, pass ``[1, 0]``, fail ``[0, 1]`` or all ``[1, 1]``.

The filters (fixed values of the audit):

- A: fewer than 200 words;
- B: 100 * distinct words < 50 * words;
- C: 100 * characters in A-Z > 2 * code points;
- D: holds any of ``# $ % & * |``;
- E: identical to the text of a smaller doc_id anywhere in the table, removed or not.

Words are maximal runs of characters other than space and tab to carriage return, case
kept. Texts are compared by their SHA-256 and length, which no pair of real texts shares.

Scale: a text is read once, on the executor that holds it; only bits, ids and hashes move.
E needs the least id of each text: rows are first counted by (hash, part, bits, doc_id),
then folded to one row per (hash, part) carrying the least id's counts, so a text copied
into a third of the table ends as a few rows, never one task's group. Labels join on
doc_id after that fold. Only the 32-cell tables of a part meet in one Python task.

Odd rows: a null text counts as empty (0 words: fails A only), a null source is the part
``''``; a null doc_id never fails E and is never a smaller id; repeated rows count as often
as they occur and rows with one doc_id and equal texts do not fail E against each other;
labels missing count as neither good nor toxic, labels repeated for a doc_id by their
maximum; an empty table gives no rows; other input columns, of any name, are ignored.
"""

import sys
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Executors need not have the package: the helpers below travel with the function.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
PASS, FAIL, ALL = np.array([1, 0]), np.array([0, 1]), np.array([1, 1])

AUDIT_SCHEMA = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def fail_bits(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id``, ``source``, ``fail_a`` to ``fail_d`` (0 or 1) and ``text_key`` for E."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    upper = F.length(t) - F.length(F.regexp_replace(t, "[A-Z]", ""))
    return docs.select(
        "doc_id",
        "source",
        F.when(F.size(words) < 200, 1).otherwise(0).alias("fail_a"),
        F.when(100 * F.size(F.array_distinct(words)) < 50 * F.size(words), 1).otherwise(0).alias("fail_b"),
        F.when(100 * upper > 2 * F.length(t), 1).otherwise(0).alias("fail_c"),
        F.when(t.rlike("[#$%&*|]"), 1).otherwise(0).alias("fail_d"),
        F.concat_ws(":", F.sha2(t, 256), F.length(t).cast("string")).alias("text_key"),
    )


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows ``part, fail_a .. fail_e, n, good, toxic``: documents by part and fail bits."""
    bits = ["fail_a", "fail_b", "fail_c", "fail_d"]
    flagged = fail_bits(docs).withColumn("part", F.coalesce("source", F.lit("")))
    per_doc = flagged.groupBy("text_key", "part", *bits, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("q"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("x"),
    )
    counted = (
        per_doc.join(marks, "doc_id", "left")
        .withColumn("good", F.col("n") * F.coalesce("q", F.lit(0)))
        .withColumn("toxic", F.col("n") * F.coalesce("x", F.lit(0)))
    )
    no_id = counted.where(F.col("doc_id").isNull()).select("part", *bits, F.lit(0).alias("fail_e"), "n", "good", "toxic")
    with_id = counted.where(F.col("doc_id").isNotNull())
    folded = with_id.groupBy("text_key", "part", *bits).agg(
        F.sum("n").alias("all_n"),
        F.sum("good").alias("all_good"),
        F.sum("toxic").alias("all_toxic"),
        F.min(F.struct("doc_id", "n", "good", "toxic")).alias("least"),
    )
    text_least = F.min("least.doc_id").over(Window.partitionBy("text_key"))
    placed = folded.withColumn("_first", F.col("least.doc_id") == text_least)
    first = F.col("_first")
    keep = placed.select(
        "part",
        *bits,
        F.lit(0).alias("fail_e"),
        F.when(first, F.col("least.n")).otherwise(0).alias("n"),
        F.when(first, F.col("least.good")).otherwise(0).alias("good"),
        F.when(first, F.col("least.toxic")).otherwise(0).alias("toxic"),
    )
    copies = placed.select(
        "part",
        *bits,
        F.lit(1).alias("fail_e"),
        (F.col("all_n") - F.when(first, F.col("least.n")).otherwise(0)).alias("n"),
        (F.col("all_good") - F.when(first, F.col("least.good")).otherwise(0)).alias("good"),
        (F.col("all_toxic") - F.when(first, F.col("least.toxic")).otherwise(0)).alias("toxic"),
    )
    every = no_id.unionByName(keep).unionByName(copies)
    return every.groupBy("part", *bits, "fail_e").agg(*[F.sum(c).cast("long").alias(c) for c in ("n", "good", "toxic")])


def contract(tensor: np.ndarray, selectors: list[np.ndarray]) -> int:
    """The count of a 2x2x2x2x2 tensor under one selector for each axis."""
    return int(np.einsum("abcde,a,b,c,d,e->", tensor, *selectors))


def _audit_part(part: pd.DataFrame) -> pd.DataFrame:
    tensors = {m: np.zeros((2,) * 5, np.int64) for m in ("n", "good", "toxic")}
    for row in part.itertuples(index=False):
        at = (row.fail_a, row.fail_b, row.fail_c, row.fail_d, row.fail_e)
        for m in tensors:
            tensors[m][at] += getattr(row, m)
    n = tensors["n"]

    def removed(order: str, step: int, tensor: np.ndarray) -> int:
        axes = {f: PASS for f in order[:step]} | {order[step]: FAIL}
        return contract(tensor, [axes.get(f, ALL) for f in FILTERS])

    shapley = {f: sum(removed(o, o.index(f), n) for o in ORDERS) for f in FILTERS}
    unique = {f: contract(n, [FAIL if g == f else PASS for g in FILTERS]) for f in FILTERS}
    rows = []
    for order in ORDERS:
        for step, f in enumerate(order):
            kept = contract(n, [PASS if g in order[: step + 1] else ALL for g in FILTERS])
            gone = removed(order, step, n)
            failing = contract(n, [FAIL if g == f else ALL for g in FILTERS])
            rows.append(
                (
                    part["part"].iloc[0],
                    order,
                    step + 1,
                    kept,
                    gone,
                    failing - gone,
                    unique[f],
                    removed(order, step, tensors["good"]),
                    removed(order, step, tensors["toxic"]),
                    shapley[f],
                )
            )
    return pd.DataFrame(rows, columns=[c.split()[0] for c in AUDIT_SCHEMA.split(", ")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """600 rows a part: every order of the five filters and every step, with the counts."""
    return cells(docs, labels).groupBy("part").applyInPandas(_audit_part, AUDIT_SCHEMA)


AUDIT_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
    FROM documents
),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS q,
             max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS x FROM labels GROUP BY doc_id),
f AS (
    SELECT part, coalesce(l.q, 0) AS q, coalesce(l.x, 0) AS x,
        list_filter([
            CASE WHEN len(ws) < 200 THEN 'A' END,
            CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' END,
            CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 'C' END,
            CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
            CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' END], lambda s: s IS NOT NULL) AS fails
    FROM d LEFT JOIN l ON d.doc_id = l.doc_id
),
c AS (SELECT part, fails, count(*) AS n, sum(q) AS good, sum(x) AS toxic FROM f GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS y),
orders AS (
    SELECT a.y || b.y || c.y || d.y || e.y AS o
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE a.y NOT IN (b.y, c.y, d.y, e.y) AND b.y NOT IN (c.y, d.y, e.y) AND c.y NOT IN (d.y, e.y) AND d.y <> e.y
),
grid AS (SELECT o, s, substr(o, s, 1) AS letter, substr(o, 1, s - 1) AS before FROM orders, range(1, 6) r(s)),
m AS (
    SELECT part, o, s, letter, fails, n, good, toxic,
        list_contains(fails, letter) AS fail_here,
        len(list_filter(fails, lambda z: contains(before, z))) = 0 AS passed_before
    FROM c, grid
),
steps AS (
    SELECT part, o AS filter_order, s::INTEGER AS step, letter,
        sum(CASE WHEN passed_before AND NOT fail_here THEN n ELSE 0 END)::BIGINT AS kept,
        sum(CASE WHEN passed_before AND fail_here THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN NOT passed_before AND fail_here THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN fail_here AND len(fails) = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN passed_before AND fail_here THEN good ELSE 0 END)::BIGINT AS good_lost,
        sum(CASE WHEN passed_before AND fail_here THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM m GROUP BY part, o, s, letter
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM steps
"""
