"""What the operators share: table access, stored intermediate tables, exact numbering."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lineglass.session import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it again.

    Cuts the lineage and survives lost executors; a table is read as often as needed
    without computing it anew.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, group: list[str], order: list[str], name: str, slices: int) -> DataFrame:
    """Add ``name``: 0, 1, 2 ... without gaps within each group, in no stated order.

    A group of any size is dealt out to ``slices`` slices by the hash of its ordering
    columns, each numbered on its own and moved by the rows of the slices before it, so
    no task sees a whole group. Rows that agree in all columns are interchangeable.
    """
    cut = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)))
    sizes = cut.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*group, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = W.partitionBy(*group, "_slice").orderBy(*order)
    ranked = cut.withColumn("_rank", F.row_number().over(within) - 1)
    return (
        ranked.join(starts, [*group, "_slice"])
        .withColumn(name, F.col("_start") + F.col("_rank"))
        .drop("_slice", "_start", "_rank")
    )


def hex64(value: Column) -> Column:
    """A 64-bit number as 16 lowercase hexadecimal digits."""
    return F.lpad(F.lower(F.hex(value)), 16, "0")
