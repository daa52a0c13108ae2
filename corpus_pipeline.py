"""A training-text pipeline of five stages, each written as Parquet and read by the next.

Toxic documents go, repeated lines go, one document of every near-duplicate group stays,
benchmark leaks go, and what is left is packed into training sequences.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineglass.llm import decontamination, lines, packing, simhash_links, toxicity
from lineglass.llm.common import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # The old n_chars is not read: a column of one join only would shuffle the texts twice.
    kept = lines.without_repeats(docs.drop("n_chars")).drop("removed_lines")
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*dict.fromkeys([*docs.columns, "n_chars"]))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_links.one_of_each(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic),
    ("line_dedup", repeated_lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", leaks),
    ("packing", packed),
]

# Fingerprints, tokenizers and learned weights have no SQL form; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
