"""File trees as a Spark data source, in batch and as a stream: ``format("lineglass_tree")``.

Spark's own file sources leave out empty files and names that start with ``_`` or ``.``
(``__init__.py``), so trees are read by this source. The driver plans the read: it lists
the first levels of the tree until there are about ``spread`` directory units (at most
``PLAN_DEPTH`` levels, only names), and deals them to ``spread`` partitions. Each task
walks its directories itself, never entering ignored ones, tests what was pushed down
(extensions, names, path ends) on each name before opening the file, and yields one row
a file. No contents and no listings of whole trees pass through the driver.

Options: ``path`` (root), ``projects`` ("true": every directory of the root is a project
and paths are relative to it; otherwise ``project`` names the one project), ``spread``
(partitions, default 64), ``skip_dirs`` (comma-separated directory names never entered;
default the engine's ignore list).

Columns: ``project, path, name, extension, size, modified, content`` with ``content`` the
raw bytes (null when the file cannot be read) and ``modified`` in nanoseconds.

As a stream, an offset is the latest modification time seen; a batch reads the files
modified after the last offset and at or before the new one, so a changed file arrives
again. Finding the latest time walks the tree on the driver, keeping one number, as a
file stream lists its folder. A file written later with an older time is not seen.
"""

import re
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    In,
    InputPartition,
    Not,
    StringEndsWith,
)

from lineglass.functions.vocabulary import IGNORED_DIRS

# The source's classes travel with the plan; Python workers need not import the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "project string, path string, name string, extension string, size long, modified long, content binary"
PLAN_DEPTH = 3
_EXTENSION = re.compile(r"^\.*[^.].*(\.[^.]*)$")


def extension_of(name: str) -> str:
    """The lower-case extension as the engine reads it ('' for none or a leading dot only)."""
    found = _EXTENSION.match(name)
    return found.group(1).lower() if found else ""


class Units(InputPartition):
    """Directories (relative to the root) that one task reads: ``(dir, whole)`` pairs,
    ``whole`` meaning with all subdirectories, else its own files only."""

    def __init__(self, units: list[tuple[str, bool]], start: int = -1, end: int | None = None):
        super().__init__(units)
        self.units, self.start, self.end = units, start, end


class _Tree:
    """What batch and stream reading share."""

    def __init__(self, options: dict):
        self.root = options.get("path", "").rstrip("/") or "/"
        self.projects = str(options.get("projects", "false")).lower() == "true"
        self.project = options.get("project", self.root)
        self.spread = int(options.get("spread", 64))
        skip = options.get("skip_dirs")
        self.skip = set(skip.split(",")) if skip is not None else set(IGNORED_DIRS)
        self.extensions: set[str] | None = None
        self.names_out: set[str] = set()
        self.ends: list[str] = []

    def _system(self):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.root if "://" in self.root else "file://" + self.root)
        return system, base.rstrip("/")

    def _listing(self, system, base: str, directory: str):
        from pyarrow import fs

        try:
            return system.get_file_info(fs.FileSelector(f"{base}/{directory}" if directory else base))
        except OSError:
            return []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, In) and f.attribute == ("extension",):
                self.extensions = set(f.value) if self.extensions is None else self.extensions & set(f.value)
            elif isinstance(f, EqualTo) and f.attribute == ("extension",):
                self.extensions = {f.value} if self.extensions is None else self.extensions & {f.value}
            elif isinstance(f, Not) and isinstance(f.child, In) and f.child.attribute == ("name",):
                self.names_out |= set(f.child.value)
            elif isinstance(f, StringEndsWith) and f.attribute == ("path",):
                self.ends.append(f.value)
            else:
                yield f

    def _plan(self, start: int = -1, end: int | None = None) -> list[Units]:
        """Directory units dealt to partitions; only the first levels are listed."""
        from pyarrow import fs

        system, base = self._system()
        units, frontier = [], [""]
        for _ in range(PLAN_DEPTH):
            if len(units) + len(frontier) >= self.spread:
                break
            below = []
            for directory in frontier:
                units.append((directory, False))
                for e in self._listing(system, base, directory):
                    if e.type == fs.FileType.Directory and e.base_name not in self.skip:
                        below.append(f"{directory}/{e.base_name}" if directory else e.base_name)
            frontier = below
        units += [(d, True) for d in frontier]
        parts = [[] for _ in range(max(1, min(self.spread, len(units))))]
        for k, unit in enumerate(sorted(units)):
            parts[k % len(parts)].append(unit)
        return [Units(p, start, end) for p in parts if p]

    def _wanted(self, rel: str, name: str) -> bool:
        if self.extensions is not None and extension_of(name) not in self.extensions:
            return False
        if name in self.names_out:
            return False
        return not self.ends or any(rel.endswith(e) for e in self.ends)

    def _files(self, units: list[tuple[str, bool]]):
        """(relative path, info) of every file of the units, ignored directories not entered."""
        from pyarrow import fs

        system, base = self._system()
        for top, whole in units:
            stack = [top]
            while stack:
                directory = stack.pop()
                for e in self._listing(system, base, directory):
                    rel = f"{directory}/{e.base_name}" if directory else e.base_name
                    if e.type == fs.FileType.Directory:
                        if whole and e.base_name not in self.skip:
                            stack.append(rel)
                    elif e.type == fs.FileType.File:
                        yield rel, e

    def _rows(self, partition: Units):
        system, base = self._system()
        for rel, info in self._files(partition.units):
            if self.projects:
                if "/" not in rel:
                    continue
                project, path = rel.split("/", 1)
            else:
                project, path = self.project, rel
            name = path.rsplit("/", 1)[-1]
            modified = info.mtime_ns or 0
            if modified <= partition.start or (partition.end is not None and modified > partition.end):
                continue
            if not self._wanted(path, name):
                continue
            try:
                with system.open_input_stream(f"{base}/{rel}", compression=None) as f:
                    content = f.read()
            except OSError:
                content = None
            yield (project, path, name, extension_of(name), info.size or 0, modified, content)


class TreeReader(_Tree, DataSourceReader):
    def partitions(self):
        return self._plan()

    def read(self, partition):
        yield from self._rows(partition)


class TreeStreamReader(_Tree, DataSourceStreamReader):
    def initialOffset(self):
        return {"modified": -1}

    def latestOffset(self):
        system, base = self._system()
        latest = -1
        for _, info in self._files([("", True)]):
            latest = max(latest, info.mtime_ns or 0)
        return {"modified": latest}

    def partitions(self, start, end):
        return self._plan(start["modified"], end["modified"])

    def read(self, partition):
        yield from self._rows(partition)

    def commit(self, end):
        pass


class TreeSource(DataSource):
    @classmethod
    def name(cls):
        return "lineglass_tree"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return TreeReader(self.options)

    def streamReader(self, schema):
        return TreeStreamReader(self.options)


def registered(spark: SparkSession) -> SparkSession:
    """Register the source, with filter push-down into Python sources switched on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
    return spark


def read_tree_source(spark: SparkSession, root: str, project: str | None = None, stream: bool = False) -> DataFrame:
    """Supported files of a tree outside ignored directories and names, decoded: ``project,
    path, content``. With ``project`` None every directory of the root is a project.

    Extensions and ignored names are pushed into the walk, so other files are never opened.
    """
    from pyspark.sql import functions as F

    from lineglass.functions.vocabulary import IGNORED_FILES, LANGUAGES
    from lineglass.operators.corpus import decode_text

    registered(spark)
    reader = spark.readStream if stream else spark.read
    options = {"path": root, "projects": str(project is None).lower(), "project": project or root}
    files = reader.format(TreeSource.name()).options(**options).load()
    wanted = files.where(F.col("extension").isin(*LANGUAGES) & ~F.col("name").isin(*IGNORED_FILES))
    return wanted.select("project", "path", decode_text(F.col("content")).alias("content"))


def write_tree(files: DataFrame, root: str) -> int:
    """Write ``(project, path, content)`` as files ``root/project/path``; returns the count.

    Tasks write where the rows are; a null content is an empty file; rows without a
    project or path are not written.
    """

    def write(batches):
        import pandas as pd
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root if "://" in root else "file://" + root)
        for batch in batches:
            for project, path, content in zip(batch["project"], batch["path"], batch["content"]):
                target = f"{base.rstrip('/')}/{project}/{path}"
                system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(target, compression=None) as out:
                    out.write((content or "").encode("utf-8"))
            yield pd.DataFrame({"n": [len(batch)]})

    rows = files.where("project IS NOT NULL AND path IS NOT NULL").select("project", "path", "content")
    return rows.mapInPandas(write, "n long").agg({"n": "sum"}).first()[0] or 0
