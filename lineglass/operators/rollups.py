"""Aggregates and ranked tables over findings and metrics, per project."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineglass.functions import vocabulary as v
from lineglass.functions.text import base_name, thousands


def issue_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("project", "severity").agg(F.count("*").alias("n"))


def category_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("project", "category").agg(F.count("*").alias("n"))


def total_findings(findings: DataFrame) -> DataFrame:
    return findings.groupBy("project").agg(F.count("*").alias("n"))


def project_totals(metrics: DataFrame) -> DataFrame:
    """Files analysed and lines, from any table with one row per file and ``lines_total``."""
    return metrics.groupBy("project").agg(
        F.count("*").alias("files_analyzed"), F.sum("lines_total").cast("bigint").alias("total_lines")
    )


def severity_counts(projects: DataFrame, findings: DataFrame) -> DataFrame:
    """Per project one column for each severity, zero where there are no findings."""
    counts = findings.groupBy("project").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in v.SEVERITIES]
    )
    joined = projects.join(counts, "project", "left")
    return joined.select(
        *projects.columns, *[F.coalesce(F.col(s), F.lit(0)).cast("bigint").alias(s) for s in v.SEVERITIES]
    )


def severity_table(projects: DataFrame, findings: DataFrame) -> DataFrame:
    """Four rows per project in report order."""
    wide = severity_counts(projects.select("project"), findings)
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("rank"), F.lit(s).alias("severity"), F.col(s).alias("n"))
            for i, s in enumerate(v.SEVERITIES, 1)
        ]
    )
    return wide.select("project", F.inline(rows))


def categories_ranked(findings: DataFrame) -> DataFrame:
    """Categories by count; equal counts keep the order in which they first appear."""
    counts = findings.groupBy("project", "category").agg(
        F.count("*").alias("n"), F.min(F.struct("file", "ord")).alias("first")
    )
    order = Window.partitionBy("project").orderBy(F.desc("n"), "first")
    return counts.select("project", "category", "n", F.row_number().over(order).alias("rank"))


def _first(findings: DataFrame, limit: int) -> DataFrame:
    # Spark keeps only ``limit`` rows per project and task before the exchange.
    order = Window.partitionBy("project").orderBy("file", "ord")
    return findings.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def top_critical(findings: DataFrame) -> DataFrame:
    return _first(findings.filter(F.col("severity").isin("critical", "error")), v.TOP_CRITICAL)


def top_warnings(findings: DataFrame) -> DataFrame:
    return _first(findings.filter(F.col("severity") == "warning"), v.TOP_WARNINGS)


def warning_overflow(findings: DataFrame) -> DataFrame:
    """Warnings per project and how many a report leaves unlisted."""
    n = F.count("*")
    return (
        findings.filter(F.col("severity") == "warning")
        .groupBy("project")
        .agg(n.alias("warnings"), F.greatest(n - v.TOP_WARNINGS, F.lit(0)).alias("unlisted"))
    )


def top_complex_files(metrics: DataFrame) -> DataFrame:
    order = Window.partitionBy("project").orderBy(F.desc("complexity"), "filepath")
    ranked = metrics.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= v.TOP_FILES)
    return ranked.withColumn("name", F.substring(base_name(F.col("filepath")), 1, v.FILE_NAME_WIDTH))


def summary_line(totals: DataFrame, findings: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """One line of totals per project, followed by the start of the answer summary if there is one."""
    wide = severity_counts(totals, findings)
    if answers is not None:
        wide = wide.join(answers.select("project", "ai_summary"), "project", "left")
    else:
        wide = wide.withColumn("ai_summary", F.lit(None).cast("string"))
    counts = [
        F.concat(F.lit(f"{v.SEVERITY_MARKERS[s]} {s.title()}: "), F.col(s).cast("string")) for s in v.SEVERITIES
    ]
    line = F.concat_ws(
        "  |  ",
        F.concat(F.lit("Files: "), F.col("files_analyzed").cast("string")),
        F.concat(F.lit("Lines: "), thousands(F.col("total_lines"))),
        *counts,
    )
    note = F.when(
        F.col("ai_summary") != "",
        F.concat(F.lit("\n\nAI: "), F.substring("ai_summary", 1, v.SUMMARY_LINE_LIMIT), F.lit("...")),
    )
    return wide.select("project", F.concat_ws("", line, note).alias("summary_line"))
