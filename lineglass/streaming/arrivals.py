"""The line rules on a stream of files.

The scan is stateless, so a stream runs the batch operators as they are.  Counts
per severity are kept in event-time windows closed by a watermark.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineglass.functions.rules import ALL_RULES
from lineglass.operators.lines import explode_lines
from lineglass.operators.scan import scan_rules


def stream_findings(files: DataFrame, rules=ALL_RULES, keep: tuple = ()) -> DataFrame:
    """Findings of arriving ``(project, path, content)`` rows."""
    return scan_rules(explode_lines(files, keep), rules, keep)


def severity_windows(findings: DataFrame, time: str = "arrived", width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Findings per severity in tumbling windows of arrival time."""
    return (
        findings.withWatermark(time, delay)
        .groupBy(F.window(time, width), "severity")
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "severity", "n")
    )


def complete_windows(findings: DataFrame, closed: DataFrame, time: str = "arrived", width: str = "1 hour") -> DataFrame:
    """All windows of stored findings next to those that a stream has closed.

    ``n`` counts every stored finding. ``late`` are those that came after the stream had
    closed their window, ``is_open`` tells windows that it has not closed yet, so nothing
    is left out when a stream stops.
    """
    every = findings.groupBy(F.window(time, width), "severity").agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "severity", "n"
    )
    done = closed.groupBy("window_start").agg(F.lit(True).alias("done"))
    counted = closed.select("window_start", "severity", F.col("n").alias("in_time"))
    is_open = F.col("done").isNull()
    late = F.when(is_open, 0).otherwise(F.col("n") - F.coalesce("in_time", F.lit(0)))
    return (
        every.join(done, "window_start", "left")
        .join(counted, ["window_start", "severity"], "left")
        .select("window_start", "window_end", "severity", "n", late.cast("bigint").alias("late"), is_open.alias("is_open"))
    )


def drain(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what has arrived, append it to a table, and return the table.

    Restarting with the same checkpoint continues where the last call stopped.
    """
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
