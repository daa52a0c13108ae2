"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineglass.llm import (
    chat,
    decontamination,
    filter_audit,
    fim,
    hamming,
    jaccard_join,
    lines,
    packing,
    secrets,
    sharding,
    simhash_links,
    token_rollup,
    toxicity,
)
from lineglass.llm.common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 1024 ids."""
    return packing.pack(table(spark, sf_dir, "documents"))


NEIGHBORS = 10


def op2_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest codes of every query row, an id divisible by 20, among all rows."""
    vectors = table(spark, sf_dir, "embeddings")
    dims = vectors.agg(F.max(F.size("embedding"))).first()[0] or 1
    return hamming.top_k(vectors, F.col("vec_id") % 20 == 0, NEIGHBORS, max(dims, 1))


MULTI_INDEX_SQL = """
WITH pairs AS (
    SELECT q.vec_id AS query_id, v.vec_id AS neighbor_id,
        list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: CASE WHEN (x[1] > 0) <> (x[2] > 0) THEN 1 ELSE 0 END)) AS distance
    FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM pairs)
SELECT query_id, rank::INTEGER AS rank, neighbor_id, distance::INTEGER AS distance FROM ranked WHERE rank <= 10
"""


def op3_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; sizes are near equal, equal texts stay together."""
    placed = sharding.sharded(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret counts and span digests of every document."""
    return secrets.digests(table(spark, sf_dir, "documents"))


def op5_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the runs of lines that an earlier one has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.without_repeats(docs)


def op6_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, and the places that its clauses matched."""
    scored = toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", toxicity.spans("found").alias("spans"))


def op7_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash_links.near_duplicates(table(spark, sf_dir, "documents"))


def op8_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals after batches of inserts, deletes, revisions and a recount of all documents."""
    return token_rollup.maintained(table(spark, sf_dir, "documents"))


def op9_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with score and overlaps."""
    return decontamination.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as each of its participants would learn it."""
    return chat.perspectives(table(spark, sf_dir, "conversations"))


def op11_fim_skip_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rearranged for fill-in-the-middle, as digests of the result and its parse back."""
    return fim.digests(table(spark, sf_dir, "documents"))


def op12_jaccard_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its five-word shingle count and the least id linked to it at Jaccard 0.8."""
    return jaccard_join.joined(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order of five filters, step by step, per source, over all documents and labels."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_multi_index_hashing,
        op3_label_propagation_shards,
        op4_secret_ownership,
        op5_line_winnowing,
        op6_toxicity_grammar,
        op7_simhash_pigeonring,
        op8_token_rollup,
        op9_bm25_decontamination,
        op10_perspective_rotation,
        op11_fim_skip_list,
        op12_jaccard_pigeonhole,
        op13_filter_audit,
    )
}
# Tokenizers, learned weights, fingerprints, shards, packing and components have no SQL form here.
ORACLES = {
    "op2_multi_index_hashing": MULTI_INDEX_SQL,
    "op10_perspective_rotation": chat.PERSPECTIVES_SQL,
    "op11_fim_skip_list": fim.DIGESTS_SQL,
    "op13_filter_audit": filter_audit.AUDIT_SQL,
}
