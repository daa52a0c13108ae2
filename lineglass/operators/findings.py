"""Findings as a table: merging, filtering, numbering, looking up."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineglass.functions import vocabulary as v
from lineglass.functions.text import base_name
from lineglass.operators.scan import FINDING_COLUMNS
from lineglass.session import shared_dir


def union_findings(*parts: DataFrame) -> DataFrame:
    """Bag union: the same line may be reported by several sources."""
    return reduce(DataFrame.unionByName, [p.select(*FINDING_COLUMNS) for p in parts])


def filter_severity(findings: DataFrame, severity: str = "all") -> DataFrame:
    return findings if severity == "all" else findings.filter(F.col("severity") == severity)


def critical_and_error(findings: DataFrame) -> DataFrame:
    return findings.filter(F.col("severity").isin("critical", "error"))


def warnings(findings: DataFrame) -> DataFrame:
    return findings.filter(F.col("severity") == "warning")


def listing(findings: DataFrame) -> DataFrame:
    """The short form shown in lists."""
    return findings.select(
        "project", base_name(F.col("file")).alias("name"), "line", "severity", "category",
        F.substring("message", 1, v.LISTING_MESSAGE_WIDTH).alias("message"),
    )


def detail_text(f=F.col) -> Column:
    """The long form of one finding; a redacted snippet is left out."""
    head = F.concat(
        F.lit("File: "), f("file"),
        F.lit("\nLine: "), f("line").cast("string"), F.lit(", Column: "), f("column").cast("string"),
        F.lit("\nSeverity: "), F.upper(f("severity")),
        F.lit("\nCategory: "), f("category"),
        F.lit("\nRule: "), f("rule"),
        F.lit("\n\n"), f("message"),
    )
    suggestion = F.when(f("suggestion") != "", F.concat(F.lit("\n\n💡 Suggestion:\n"), f("suggestion")))
    shown = (f("code_snippet") != "") & (f("code_snippet") != v.REDACTED)
    code = F.when(shown, F.concat(F.lit("\n\nCode:\n"), f("code_snippet")))
    return F.concat_ws("", head, suggestion, code)


def finding_lookup(findings: DataFrame) -> DataFrame:
    """For every (file name, line, severity) of a run the finding that comes first.

    A grouped minimum, so repeated keys shrink before the exchange.
    """
    fields = [c for c in FINDING_COLUMNS if c not in ("project", "line", "severity")]
    first = F.min(F.struct("file", "ord", *[c for c in fields if c not in ("file", "ord")])).alias("first")
    return (
        findings.withColumn("name", base_name(F.col("file")))
        .groupBy("project", "name", "line", "severity")
        .agg(first)
        .select("project", "name", "line", "severity", *[F.col(f"first.{c}").alias(c) for c in fields])
    )


def number_rows(df: DataFrame, group: str, order: list[str], name: str = "ordinal") -> DataFrame:
    """Exact 1, 2, 3 … per ``group`` in ``order``, without bringing a group into one task.

    Rows are range-partitioned and sorted; the sorted slices are stored, since a
    rerun of a lost task must not number them differently.  Each slice then only
    needs the number of rows of its group in earlier slices.  Range partitioning
    samples its input first, so pass a stored table.
    """
    shared_dir(df.sparkSession)
    placed = (
        df.repartitionByRange(group, *order)
        .sortWithinPartitions(group, *order)
        .withColumn("_slice", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id())
        .checkpoint()
    )
    slices = placed.groupBy(group, "_slice").agg(F.count("*").alias("_n"), F.min("_place").alias("_start"))
    # One row per slice and group: as many as there are tasks, not rows.
    earlier = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    return (
        placed.join(offsets, [group, "_slice"])
        .withColumn(name, F.col("_before") + F.col("_place") - F.col("_start") + 1)
        .drop("_slice", "_place", "_n", "_start", "_before")
    )


def finding_ordinal(findings: DataFrame) -> DataFrame:
    """Position of each finding in its project's report order."""
    return number_rows(findings, "project", ["file", "ord"])
