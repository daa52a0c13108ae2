"""What a project does with review results: changed files, release gate, trend, risk bands."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hashes(files: DataFrame) -> DataFrame:
    """What a review has to remember of a file to notice a change."""
    return files.select("project", "path", F.sha2("content", 256).alias("content_hash"))


def changed_files(files: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Keys of the files whose content differs from the last review, or is new.

    ``reviewed`` is the ``content_hashes`` of that review.  Hashes are taken where
    the files are read, so only keys and hashes are shuffled, never contents.
    """
    return content_hashes(files).join(reviewed, ["project", "path", "content_hash"], "left_anti")


def file_changes(files: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Every file that is ``new``, ``changed`` or ``removed`` since the last review.

    A file that could not be read has no hash: it counts as changed when it could be read
    before or can be now, and not for ever.
    """
    now, before = content_hashes(files).alias("now"), reviewed.alias("before")
    same = [F.col(f"now.{k}") == F.col(f"before.{k}") for k in ("project", "path")]
    state = (
        F.when(F.col("before.path").isNull(), "new")
        .when(F.col("now.path").isNull(), "removed")
        .when(~F.col("now.content_hash").eqNullSafe(F.col("before.content_hash")), "changed")
    )
    keys = [F.coalesce(f"now.{k}", f"before.{k}").alias(k) for k in ("project", "path")]
    return now.join(before, same, "full").select(*keys, state.alias("state")).where("state IS NOT NULL")


def release_gate(projects: DataFrame, findings: DataFrame) -> DataFrame:
    """A project with a critical finding is blocked."""
    critical = findings.groupBy("project").agg(F.count_if(F.col("severity") == "critical").alias("critical"))
    joined = projects.select("project").join(critical, "project", "left")
    n = F.coalesce("critical", F.lit(0)).cast("bigint")
    return joined.select("project", n.alias("critical"), F.when(n > 0, "blocked").otherwise("passed").alias("gate"))


def quality_trend(runs: DataFrame, values: list[str]) -> DataFrame:
    """``(run, project, values…)`` with each value's change since the project's previous run."""
    before = Window.partitionBy("project").orderBy("run")
    return runs.select(
        "*", *[(F.col(x) - F.lag(x).over(before)).alias(f"{x}_change") for x in values]
    )


def complexity_band(complexity: Column) -> Column:
    # Published bands of complexity.
    return (
        F.when(complexity <= 10, "simple").when(complexity <= 20, "moderate")
        .when(complexity <= 50, "complex").otherwise("very complex")
    )


def maintainability_band(index: Column) -> Column:
    # Published bands of maintainability.
    return F.when(index >= 85, "high").when(index >= 65, "moderate").otherwise("low")


def risk_bands(metrics: DataFrame) -> DataFrame:
    """Files per project and pair of bands."""
    return metrics.groupBy(
        "project",
        complexity_band(F.col("complexity")).alias("complexity_band"),
        maintainability_band(F.col("maintainability")).alias("maintainability_band"),
    ).agg(F.count("*").alias("n"))
