"""Writers of findings, metrics and reports."""

from pyspark.sql import DataFrame


def write_reports(reports: DataFrame, path: str) -> None:
    """Markdown or HTML reports, one text folder per project."""
    reports.select("project", "report").write.mode("overwrite").partitionBy("project").text(path)


def write_json_fragments(fragments: DataFrame, path: str) -> None:
    """JSON reports: the parts of a project's folder, read in name order, are one document.

    Range partitioning keeps a large project on many tasks.
    """
    keys = ["project", "section", "file", "ord"]
    (
        fragments.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select("project", "text")
        .write.mode("overwrite").partitionBy("project").text(path)
    )


def write_table(df: DataFrame, path: str, *partitions: str) -> DataFrame:
    """Store as Parquet and return the stored table."""
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
