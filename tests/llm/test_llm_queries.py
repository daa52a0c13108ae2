"""The registered queries on the smallest tables, and the pipeline's stages."""

import os
import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from lineglass.llm import decontamination, lines, simhash_links
from lineglass.llm.common import stored, table

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "embeddings", "benchmark", "labels", "conversations"]
OWN = re.compile(r"op\d+_|pipeline$")
DIGESTS = {
    "op1": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op3": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op4": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op6": ["doc_id", "held_out", "score", "predicted"],
    "op7": ["doc_id", "fingerprint", "component_id"],
}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


def plain(row):
    return tuple(float(v) if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if OWN.match(n)))
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(entry.oracle_sql()[name])
    assert columns == sorted(want.columns)
    rows = con.sql(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(plain, df.select(*columns).collect()), key=repr) == sorted(map(plain, rows), key=repr)


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if OWN.match(n) and n.split("_")[0] in DIGESTS))
def test_query_has_its_columns(spark, name):
    df = entry.queries()[name](spark, SF)
    want = DIGESTS[name.split("_")[0]]
    assert df.columns[: len(want)] == want
    if name.split("_")[0] != "op1":
        assert df.count() == table(spark, SF, "documents").count()


def test_all_fourteen_are_registered():
    names = [n for n in entry.queries() if OWN.match(n)]
    assert {n.split("_")[0] for n in names} == {*(f"op{k}" for k in range(1, 14)), "pipeline"}
    assert len(names) == 14


def test_stages_work_on_what_came_before(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        if name == corpus_pipeline.STAGES[-1][0]:
            break
        docs = stored(docs, name)
        assert docs.columns == before.columns
        assert docs.select("doc_id").exceptAll(before.select("doc_id")).isEmpty()
        if name == "line_dedup":
            assert docs.count() == before.count()
            assert lines.repeated_runs(docs).count() <= lines.repeated_runs(before).count()
        if name == "near_duplicates":
            groups = simhash_links.near_duplicates(before)
            assert docs.count() == groups.select("component_id").distinct().count()
        if name == "decontamination":
            bench = table(spark, SF, "benchmark")
            assert decontamination.leaked(docs, bench).isEmpty()
    packed = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
    assert packed == {r.doc_id for r in before.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, SF).count() == docs.count()
