"""Repeated blocks of lines within a project: maximal blocks and their clone classes.

Lines are compared stripped; blank lines are left out and do not break a block. Every run
of ``k`` consecutive non-blank lines of a file (a shingle) is hashed inside the file's row,
so no text moves. A shingle is repeated when its project has it at two places or more,
in one file or in several. Consecutive repeated shingles of a file grow into one maximal
block; blocks with the same lines form a clone class, named by its first member (least
path, then first line), with the number of its members.

Scale: only hashes and positions leave the row. Counting shingles is an aggregation with
map-side combining. A shingle or a block that a project holds very often (a licence
header in every file) would put all its places into one task of a join; such keys, those
behind more than ``1 / HEAVY_ROWS`` of all rows, are broadcast, a table of at most
``HEAVY_ROWS`` rows, and the rest is a shuffle join of small keys. Blocks are formed by a
window over one file's repeated shingles.

Shingles and blocks are compared by 64-bit hashes; two different runs of lines of one
project share none in practice.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineglass.functions.text import strip
from lineglass.operators.corpus import with_language

HEAVY_ROWS = 100_000
BLOCK_LINES = 4


def lookup(left: DataFrame, right: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Join ``right`` (one row a key, ``count`` rows of ``left`` behind it) to ``left``.

    Keys behind more than ``1 / HEAVY_ROWS`` of all rows come from a broadcast of at most
    ``HEAVY_ROWS`` rows; the others by a shuffle join whose keys are all small.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    floor = max(1, total // HEAVY_ROWS)
    heavy = right.where(F.col(count) > floor)
    marked = left.join(F.broadcast(heavy.select(*keys).withColumn("_heavy", F.lit(True))), keys, "left")
    hot = marked.where("_heavy").drop("_heavy").join(F.broadcast(heavy), keys)
    cold = marked.where("_heavy IS NULL").drop("_heavy").join(right.where(F.col(count) <= floor), keys)
    return hot.unionByName(cold)


def shingles(files: DataFrame, k: int = BLOCK_LINES) -> DataFrame:
    """Rows ``project, path, idx, first_line, last_line, h``: every run of ``k`` non-blank lines."""
    files = with_language(files)
    family, content = F.col("family"), F.coalesce(F.col("content"), F.lit(""))
    generic = family == "generic"
    body = F.when(generic & F.endswith(content, F.lit("\n")), F.substring(content, F.lit(1), F.length(content) - 1))
    pieces = F.when(generic & (content == ""), F.array().cast("array<string>")).otherwise(F.split(body.otherwise(content), "\n"))
    numbered = F.transform(pieces, lambda x, i: F.struct((i + 1).alias("line_no"), strip(x).alias("s")))
    filled = F.filter(numbered, lambda x: x["s"] != "")
    runs = F.transform(
        F.sequence(F.lit(0), F.size("_filled") - k),
        lambda j: F.struct(
            j.alias("idx"),
            F.element_at("_filled", j + 1)["line_no"].alias("first_line"),
            F.element_at("_filled", j + k)["line_no"].alias("last_line"),
            F.xxhash64(F.array_join(F.transform(F.slice("_filled", j + 1, k), lambda y: y["s"]), "\n")).alias("h"),
        ),
    )
    rows = files.select("project", "path", filled.alias("_filled"))
    rows = rows.where(F.size("_filled") >= k).select("project", "path", F.explode(runs).alias("x"))
    return rows.select("project", "path", "x.idx", "x.first_line", "x.last_line", "x.h")


def repeated_blocks(files: DataFrame, k: int = BLOCK_LINES) -> DataFrame:
    """Every maximal repeated block: ``project, path, first_line, last_line, lines,
    class_path, class_line, members``.

    ``lines`` counts its non-blank lines, ``members`` the blocks of its class. Files with
    a null project or path are left out; a null content has no lines; an empty table
    gives no rows; files of fewer than ``k`` non-blank lines have no blocks.
    """
    runs = shingles(files.where("project IS NOT NULL AND path IS NOT NULL"), k)
    counts = runs.groupBy("project", "h").agg(F.count(F.lit(1)).alias("places"))
    again = lookup(runs, counts.where("places > 1"), ["project", "h"], "places")
    per_file = Window.partitionBy("project", "path").orderBy("idx")
    islands = again.withColumn("island", F.col("idx") - F.row_number().over(per_file))
    blocks = islands.groupBy("project", "path", "island").agg(
        F.min("first_line").alias("first_line"),
        F.max("last_line").alias("last_line"),
        (F.max("idx") - F.min("idx") + k).alias("lines"),
        F.xxhash64(F.transform(F.sort_array(F.collect_list(F.struct("idx", "h"))), lambda x: x["h"])).alias("content"),
    )
    classes = blocks.groupBy("project", "content", "lines").agg(
        F.count(F.lit(1)).alias("members"), F.min(F.struct("path", "first_line")).alias("first")
    )
    named = lookup(blocks, classes, ["project", "content", "lines"], "members")
    return named.select(
        "project",
        "path",
        F.col("first_line").cast("int"),
        F.col("last_line").cast("int"),
        F.col("lines").cast("long"),
        F.col("first.path").alias("class_path"),
        F.col("first.first_line").cast("int").alias("class_line"),
        F.col("members").cast("long"),
    )


def block_share(files: DataFrame, k: int = BLOCK_LINES) -> DataFrame:
    """Per file with blocks: ``project, path, blocks, lines_in_blocks``."""
    return repeated_blocks(files, k).groupBy("project", "path").agg(
        F.count(F.lit(1)).alias("blocks"), F.sum("lines").alias("lines_in_blocks")
    )
