"""File trees and text tables as corpora ``(project, path, content)``.

Spark's file sources leave out empty files and every name that starts with ``_``
or ``.``, which would lose ``__init__.py``.  Batch reviews therefore list and
read trees with Arrow's file systems inside Spark tasks: directories are listed
level by level, files are read where they were dealt out, and neither paths nor
contents pass through the driver.
"""

import math
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineglass.functions.vocabulary import IGNORED_DIRS, LANGUAGES
from lineglass.operators.corpus import decode_text, is_ignored_name, is_supported, select_tree, with_language
from lineglass.session import shared_dir

READ_BYTES_PER_TASK = 128 * 1024 * 1024
READ_BYTES_PER_BATCH = 32 * 1024 * 1024
# Entries of a listing handed on at once.
LISTED_PER_BATCH = 10_000


def _address(path: str) -> str:
    """A path as Arrow's file systems take it."""
    if "://" in path:
        return path.rstrip("/")
    return os.path.abspath(path.removeprefix("file:"))


def _lister(root: str):
    """List the directories of a batch, one level deep; self-contained for the executors.

    A directory below the root that cannot be listed is passed over, as a walk would.
    """

    def entries(batches):
        import os

        import pandas as pd
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        local = isinstance(system, fs.LocalFileSystem)
        def listing(directory):
            try:
                return system.get_file_info(fs.FileSelector(f"{base}/{directory}" if directory else base))
            except OSError:
                if not directory:
                    raise
                return []

        for batch in batches:
            rows = []
            for directory in batch["path"]:
                for e in listing(directory):
                    is_dir = e.type == fs.FileType.Directory
                    if is_dir and local and os.path.islink(e.path):
                        continue
                    rows.append((f"{directory}/{e.base_name}" if directory else e.base_name, is_dir, e.size or 0))
                    if len(rows) >= LISTED_PER_BATCH:
                        yield pd.DataFrame(rows, columns=["path", "is_dir", "size"])
                        rows = []
            yield pd.DataFrame(rows, columns=["path", "is_dir", "size"])

    return entries


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """``(path, size)`` of all files below ``root``, ignored directories never entered.

    One small job per directory level; each level's listing is stored, so a deep
    tree is not listed again for the next level.
    """
    shared_dir(spark)
    level = spark.createDataFrame([("",)], "path string")
    found = None
    while True:
        listed = level.repartition(spark.sparkContext.defaultParallelism, "path").mapInPandas(
            _lister(_address(root)), "path string, is_dir boolean, size bigint"
        ).checkpoint()
        files = listed.filter(~F.col("is_dir")).select("path", "size")
        found = files if found is None else found.unionByName(files)
        entered = ~F.substring_index("path", "/", -1).isin(*IGNORED_DIRS)
        level = listed.filter(F.col("is_dir") & entered).select("path")
        if level.isEmpty():
            return found


def _reader(root: str, batch_bytes: int):
    """Read the files of a batch; a file that cannot be read has no content."""

    def contents(batches):
        import pandas as pd
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)

        def read(path):
            try:
                with system.open_input_stream(f"{base}/{path}", compression=None) as f:
                    return f.read()
            except OSError:
                return None

        for batch in batches:
            paths, data, held = [], [], 0
            for path in batch["path"]:
                paths.append(path)
                data.append(read(path))
                held += len(data[-1] or b"")
                if held >= batch_bytes:
                    yield pd.DataFrame({"path": paths, "content": data})
                    paths, data, held = [], [], 0
            if paths:
                yield pd.DataFrame({"path": paths, "content": data})

    return contents


def read_paths(listed: DataFrame, root: str, project: str) -> DataFrame:
    """Contents of listed files, decoded; about as many bytes for every task."""
    spark = listed.sparkSession
    total = listed.agg(F.sum("size")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(total / READ_BYTES_PER_TASK))
    raw = listed.select("path").repartition(tasks, "path").mapInPandas(
        _reader(_address(root), READ_BYTES_PER_BATCH), "path string, content binary"
    )
    return raw.select(F.lit(project).alias("project"), "path", decode_text(F.col("content")).alias("content"))


def read_tree(spark: SparkSession, root: str, project: str | None = None) -> DataFrame:
    """Recursive review target: supported files outside ignored directories."""
    path = F.col("path")
    wanted = list_tree(spark, root).filter(is_supported(path) & ~is_ignored_name(path))
    return read_paths(wanted, root, project or root)


def read_file(spark: SparkSession, path: str, project: str | None = None) -> DataFrame:
    """A single review target, taken whatever its name."""
    root, name = _address(path).rsplit("/", 1)
    root = root or "/"
    one = spark.createDataFrame([(name, 0)], "path string, size bigint")
    return read_paths(one, root, project or path)


def source_glob() -> str:
    """A listing glob for every supported extension in any letter case."""
    spelled = ["".join(f"[{c}{c.upper()}]" for c in ext[1:]) for ext in LANGUAGES]
    return "*.{" + ",".join(spelled) + "}"


def _relative(path: Column, root: str) -> Column:
    # The file source reports full addresses; keep what follows the root.
    bare = root.split("://", 1)[1] if "://" in root else root.removeprefix("file:")
    return F.substring(path, F.locate(bare.rstrip("/") + "/", path) + len(bare.rstrip("/")) + 1, F.length(path))


def stream_tree(spark: SparkSession, root: str, project: str | None = None) -> DataFrame:
    """Files as they arrive under ``root``, selected as ``read_tree`` does.

    This is Spark's own file stream: it does not see empty files and names that
    start with ``_`` or ``.``; a nightly ``read_tree`` covers those.
    """
    raw = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", source_glob())
        .load(root)
    )
    located = raw.select(F.lit(project or root).alias("project"), _relative(F.col("path"), root).alias("path"), "content")
    return select_tree(located).withColumn("content", decode_text(F.col("content")))


def from_table(table: DataFrame, project: Column, path: Column, content: Column) -> DataFrame:
    """Any table with text as a corpus."""
    return table.select(project.alias("project"), path.alias("path"), content.alias("content"))


def store_corpus(files: DataFrame, path: str) -> DataFrame:
    """Pack a corpus into Parquet by family and language, and return the stored table.

    Reviews read texts more than once; packed files are split evenly, and the
    Python-only steps skip the other partitions.
    """
    with_language(files).write.mode("overwrite").partitionBy("family", "language").parquet(path)
    schema = "project string, path string, content string, family string, language string"
    return files.sparkSession.read.schema(schema).parquet(path)
