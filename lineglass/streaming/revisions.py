"""Findings of a stream of file versions: a file that arrives again withdraws its old findings.

Every arrival ``(project, path, content, version)`` is scanned by the line rules as in
batch. Its findings and one marker row for the arrival meet in keyed state by
``(project, path)``, which holds the findings of the newest version seen. When a newer
version arrives, the state emits the old findings with ``sign`` -1 and the new ones with
``sign`` +1, and keeps the new ones; an arrival whose version is not newer than the state's
is ignored. So the sum of signs by finding, after any order of arrivals and any split into
micro-batches, is the review of each file's newest version, and a restart from the
checkpoint emits nothing twice.

Scale: the state of a file is its findings, not its text; keys are files, so a project
of any size is spread over tasks. Python handles only the findings of the files of a
batch. Tree rules (C001, C002, B012, E001) are not applied to streams.

Odd rows: a null content is a file without lines; rows without project or path are not
reviewed; a null version counts as the oldest; equal versions of one file count once.
"""

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from lineglass.streaming.arrivals import stream_findings

# The state function travels with the plan; Python workers need not import the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

COLUMNS = ["project", "file", "line", "column", "severity", "category", "rule", "message", "suggestion", "code_snippet", "ord"]
SIGNED = (
    "project string, file string, line int, column int, severity string, category string, rule string, "
    "message string, suggestion string, code_snippet string, ord long, version long, sign int"
)
STATE = "version long, findings string"
# A finding travels and is kept as one JSON line, so that a file is few values to Python.
PACKED = [c for c in COLUMNS if c not in ("project", "file")]
PACKED_SCHEMA = ", ".join(c for c in SIGNED.split(", ") if c.split()[0] in PACKED)
REVISED = "project string, file string, version long, gone string, come string"


def _revised(key, batches, held_version, held: str):
    """The file's old and new findings and the new state, or None when the arrival is not newer."""
    newest, fresh = None, {}
    for rows in batches:
        for version, place, finding in zip(rows["version"].tolist(), rows["ord"].tolist(), rows["finding"].tolist()):
            if newest is None or version > newest:
                newest, fresh = version, {}
            if version == newest and finding is not None:
                fresh.setdefault(place, finding)
    if held_version is not None and newest <= held_version:
        return None
    kept = "\n".join(fresh.values())
    out = {"project": [key[0]], "file": [key[1]], "version": [newest], "gone": [held], "come": [kept]}
    return (pd.DataFrame(out) if held or kept else None), (newest, kept)


def _revise(key, batches, state):
    held_version, held = state.get if state.exists else (None, "")
    done = _revised(key, batches, held_version, held)
    if done is not None:
        state.update(done[1])
        if done[0] is not None:
            yield done[0]


def _once(key, rows):
    done, _ = _revised(key, [rows], None, "")
    return done if done is not None else pd.DataFrame(columns=[c.split()[0] for c in REVISED.split(", ")])


def revised_findings(files: DataFrame, rules=None) -> DataFrame:
    """Signed findings of a stream (or table) of ``(project, path, content, version)``."""
    kept = files.where("project IS NOT NULL AND path IS NOT NULL").withColumn(
        "version", F.coalesce(F.col("version").cast("long"), F.lit(-(2**62)))
    )
    found = stream_findings(kept, keep=("version",)) if rules is None else stream_findings(kept, rules, keep=("version",))
    packed = found.select("project", "file", "version", "ord", F.to_json(F.struct(*PACKED)).alias("finding"))
    marks = kept.select(
        "project", F.col("path").alias("file"), "version", F.lit(-1).cast("long").alias("ord"), F.lit(None).cast("string").alias("finding")
    )
    by_file = packed.unionByName(marks).groupBy("project", "file")
    if files.isStreaming:
        revised = by_file.applyInPandasWithState(_revise, REVISED, STATE, "append", GroupStateTimeout.NoTimeout)
    else:
        revised = by_file.applyInPandas(_once, REVISED)
    signed = lambda column, sign: F.transform(
        F.filter(F.split(column, "\n"), lambda x: x != ""), lambda x: F.struct(F.lit(sign).alias("sign"), x.alias("finding"))
    )
    each = revised.select("project", "file", "version", F.explode(F.concat(signed("gone", -1), signed("come", 1))).alias("x"))
    read = each.select("project", "file", "version", "x.sign", F.from_json("x.finding", PACKED_SCHEMA).alias("f"))
    return read.select(*[f"f.{c}" if c in PACKED else c for c in (x.split()[0] for x in SIGNED.split(", "))])


def current_findings(signed: DataFrame) -> DataFrame:
    """Findings whose signs add up to one: the review of every file's newest version."""
    return signed.groupBy(*COLUMNS).agg(F.sum("sign").alias("n")).where("n > 0").drop("n")
