"""Findings from linter output that already exists as text or JSON."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineglass.functions.text import strip
from lineglass.operators.scan import FINDING_COLUMNS, finding_order

# Layout of a linter text line and of a linter JSON report.
TEXT_LINE = r"(?d)^([0-9]+):([0-9]+):([\p{L}\p{N}_]+):(.+)"
REPORT_SCHEMA = (
    "results array<struct<line_number string, issue_severity string, test_id string, issue_text string, code string>>"
)
REPORT_SEVERITIES = {"LOW": "info", "MEDIUM": "warning", "HIGH": "error"}


def read_linter_text(spark: SparkSession, path: str) -> DataFrame:
    """Linter text files as ``(project, path, position, value)``: one output file per source file."""
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    text = spark.read.text(path, wholetext=True).select(name.alias("path"), "value")
    return text.select(
        F.lit(path).alias("project"), "path",
        F.posexplode(F.split(strip(F.col("value")), "\n")).alias("position", "value"),
    )


def read_linter_reports(spark: SparkSession, path: str) -> DataFrame:
    """Linter JSON reports as ``(project, path, json)``: one report file per source file."""
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    return spark.read.text(path, wholetext=True).select(F.lit(path).alias("project"), name.alias("path"), F.col("value").alias("json"))


def text_findings(output: DataFrame) -> DataFrame:
    """``(project, path, position, value)`` -> findings.

    Lines in another layout are skipped, and so are those whose numbers are no ``int``.
    """
    part = lambda i: F.regexp_extract(F.col("value"), TEXT_LINE, i)
    code = part(3)
    return (
        output.filter(F.col("value").rlike(TEXT_LINE))
        .select(
            "project", F.col("path").alias("file"),
            part(1).try_cast("int").alias("line"), part(2).try_cast("int").alias("column"),
            F.when(code.startswith("E"), "error").otherwise("warning").alias("severity"),
            F.lit("flake8").alias("category"), code.alias("rule"), strip(part(4)).alias("message"),
            F.lit("").alias("suggestion"), F.lit("").alias("code_snippet"),
            finding_order("flake8", F.col("position"), 0).alias("ord"),
        )
        .where("line IS NOT NULL AND `column` IS NOT NULL")
        .select(*FINDING_COLUMNS)
    )


def report_severity(level: Column) -> Column:
    """Report level to severity; unknown levels are warnings, a missing one is MEDIUM."""
    table = F.create_map(*[F.lit(x) for pair in REPORT_SEVERITIES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.coalesce(level, F.lit("MEDIUM"))), F.lit("warning"))


def report_findings(reports: DataFrame) -> DataFrame:
    """``(project, path, json)`` -> findings, one per entry of ``results``.

    A line number may be given as text; one that is missing or no number counts as 1.
    """
    entries = reports.select(
        "project", F.col("path").alias("file"),
        F.posexplode(F.from_json("json", REPORT_SCHEMA)["results"]).alias("position", "e"),
    )
    text = lambda name, default="": F.coalesce(F.col(f"e.{name}"), F.lit(default))
    return entries.select(
        "project", "file", F.coalesce(F.col("e.line_number").try_cast("int"), F.lit(1)).alias("line"), F.lit(0).alias("column"),
        report_severity(F.col("e.issue_severity")).alias("severity"), F.lit("bandit").alias("category"),
        text("test_id", "B000").alias("rule"), text("issue_text").alias("message"), F.lit("").alias("suggestion"),
        F.substring(text("code"), 1, 80).alias("code_snippet"),
        finding_order("bandit", F.col("position"), 0).alias("ord"),
    ).select(*FINDING_COLUMNS)
