"""Which files are reviewed, in what language, and as what text."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineglass.functions import vocabulary as v
from lineglass.functions.text import base_name, extension


def language_of(path: Column) -> Column:
    """Language by file extension; ``generic`` when the extension is unknown."""
    table = F.create_map(*[F.lit(x) for pair in v.LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("generic"))


def family_of(language: Column) -> Column:
    """The rule family that reviews a language."""
    return (
        F.when(language == "python", "python")
        .when(language.isin("javascript", "typescript"), "javascript")
        .otherwise("generic")
    )


def is_supported(path: Column) -> Column:
    return extension(path).isin(*v.LANGUAGES)


def is_ignored_name(path: Column) -> Column:
    return base_name(path).isin(*v.IGNORED_FILES)


def in_ignored_dir(path: Column) -> Column:
    """True when a directory of the path (relative to the root) is on the ignore list."""
    dirs = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    return F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in v.IGNORED_DIRS]))


def select_tree(files: DataFrame) -> DataFrame:
    """The files a recursive review takes: supported, not ignored, outside ignored directories."""
    path = F.col("path")
    return files.filter(is_supported(path) & ~is_ignored_name(path) & ~in_ignored_dir(path))


def select_single(files: DataFrame, path: str) -> DataFrame:
    """One named file, taken whatever its name or extension."""
    return files.filter(F.col("path") == path)


def with_language(files: DataFrame) -> DataFrame:
    """Add ``language`` and ``family`` to ``(project, path, content)`` unless they are there.

    A corpus stored with them as partition columns keeps its pruning.
    """
    if {"language", "family"} <= set(files.columns):
        return files
    return files.withColumn("language", language_of(F.col("path"))).withColumn(
        "family", family_of(F.col("language"))
    )


def decode_text(content: Column) -> Column:
    """Bytes to text: UTF-8 with invalid bytes dropped, line ends normalised to ``\\n``.

    Valid input takes the short way.  Otherwise genuine replacement characters
    are escaped before invalid bytes are turned into them and removed.
    """
    raw = content.cast("string")
    mark, gone = "﷐", "�"
    safe = F.replace(F.replace(raw, F.lit(mark), F.lit(mark + "a")), F.lit(gone), F.lit(mark + "b"))
    kept = F.replace(F.make_valid_utf8(safe), F.lit(gone), F.lit(""))
    kept = F.replace(F.replace(kept, F.lit(mark + "b"), F.lit(gone)), F.lit(mark + "a"), F.lit(mark))
    text = F.when(F.is_valid_utf8(raw), raw).otherwise(kept)
    unix = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.when(F.contains(text, F.lit("\r")), unix).otherwise(text)
