"""Files to lines, line classes, and per-file line counts.

Everything here is a narrow transformation: a file is one row, so its lines are
split, classified and counted where the file was read, without a shuffle.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineglass.functions.text import strip
from lineglass.operators.corpus import with_language

OPEN, CLOSE = "/*", "*/"

# A line of a block comment that does not close it: either it has the opener
# itself, or it directly follows such a line (\G: the previous match ended here).
# The look-behind stands for "at a line start" and also holds at the end of text.
_BLOCK_LINE = r"(?d)(?<![^\n])(?:(?!\A)\G|(?=[^\n]*/\*))(?![^\n]*\*/)[^\n]*(?:\n|\z)"


def mark_block_lines(content: Column) -> Column:
    """Prefix every line inside a block comment with the opener and a space.

    Afterwards a line is in a block exactly when it has ``/*`` and no ``*/``, so
    the running comment state becomes a property of the single line.
    """
    marked = F.regexp_replace(content, F.lit(_BLOCK_LINE), F.lit("/* $0"))
    return F.when(F.contains(content, F.lit(OPEN)), marked).otherwise(content)


def _in_block(line: Column) -> Column:
    return F.contains(line, F.lit(OPEN)) & ~F.contains(line, F.lit(CLOSE))


def _body(family: Column, content: Column) -> Column:
    """The text whose split at ``\\n`` gives the family's lines.

    Python and JavaScript count the blank piece after a final newline as a line;
    generic files do not, and an empty generic file has no lines at all.
    """
    unterminated = F.substring(content, F.lit(1), F.length(content) - 1)
    return (
        F.when(family == "javascript", mark_block_lines(content))
        .when((family == "generic") & F.endswith(content, F.lit("\n")), unterminated)
        .otherwise(content)
    )


def classify(family: Column, line: Column, in_block: Column, closes: Column) -> Column:
    """``blank``, ``comment`` or ``code``; generic files have no comments."""
    text = strip(line)
    return (
        F.when((family == "javascript") & (in_block | closes), "comment")
        .when(text == "", "blank")
        .when((family == "python") & F.startswith(text, F.lit("#")), "comment")
        .when((family == "javascript") & F.startswith(text, F.lit("//")), "comment")
        .otherwise("code")
    )


def explode_lines(files: DataFrame, keep: tuple = ()) -> DataFrame:
    """``files`` -> one row per line.

    Columns: project, path, language, family, line_no, line, skipped, and those
    named in ``keep``.  ``skipped`` lines (JavaScript block comments) are not
    looked at by any rule.
    """
    files = with_language(files)
    family, raw = F.col("family"), F.col("raw")
    js = family == "javascript"
    pieces = files.filter((family != "generic") | (F.col("content") != "")).select(
        "project", "path", "language", "family", *keep,
        F.posexplode(F.split(_body(family, F.col("content")), "\n")).alias("pos", "raw"),
    )
    inside = js & _in_block(raw)
    return pieces.select(
        "project", "path", "language", "family", *keep,
        (F.col("pos") + 1).alias("line_no"),
        F.when(inside, F.substring(raw, F.lit(4), F.length(raw))).otherwise(raw).alias("line"),
        (js & (inside | F.contains(raw, F.lit(CLOSE)))).alias("skipped"),
    )


def classify_lines(lines: DataFrame) -> DataFrame:
    """Add ``line_class`` to exploded lines."""
    skipped = F.col("skipped")
    return lines.withColumn("line_class", classify(F.col("family"), F.col("line"), skipped, skipped))


def line_counts(files: DataFrame, keep: tuple = ()) -> DataFrame:
    """Per file total, code, comment and blank lines.

    Counted inside the row, so 100 TB of text gives one small row per file with no
    exchange.  ``keep`` names further input columns to pass on.
    """
    files = with_language(files)
    family, content = F.col("family"), F.col("content")
    # Empty generic files and files that could not be read have no lines.
    empty = content.isNull() | ((family == "generic") & (content == ""))
    kinds = F.transform(
        F.split(_body(family, content), "\n"),
        lambda x: classify(family, x, _in_block(x), F.contains(x, F.lit(CLOSE))),
    )
    none = F.array().cast("array<string>")
    tagged = files.select("project", "path", "language", "family", *keep, F.when(empty, none).otherwise(kinds).alias("k"))
    count = lambda kind: F.size(F.filter("k", lambda x: x == kind))
    return tagged.select(
        "project", "path", "language", "family", *keep,
        F.size("k").alias("lines_total"),
        count("code").alias("lines_code"),
        count("comment").alias("lines_comment"),
        count("blank").alias("lines_blank"),
    )


def duplicate_lines(lines: DataFrame) -> DataFrame:
    """Per file its lines that are not blank, those that its project repeats, and their share.

    Lines are compared stripped, by hash.  They are counted per file before they are
    compared, so a line that stands everywhere is one row for each file and not one for
    each place.
    """
    text = strip(F.col("line"))
    per_file = lines.where(text != "").groupBy("project", "path", F.xxhash64(text).alias("hash")).agg(F.count("*").alias("n"))
    again = per_file.groupBy("project", "hash").agg((F.sum("n") > 1).alias("again"))
    n = F.col("n")
    return (
        per_file.join(again, ["project", "hash"])
        .groupBy("project", "path")
        .agg(F.sum(n).alias("lines_filled"), F.sum(F.when(F.col("again"), n).otherwise(0)).alias("lines_repeated"))
        .withColumn("share", F.col("lines_repeated") / F.col("lines_filled"))
    )
