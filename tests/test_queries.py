"""Registered queries against their SQL on the smallest tables."""

import math
import os
import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")

# The driver checks every query; here one stands for several that share a path:
# packs for their rules, the whole report for its sections, one filter for all.
# Queries whose tests lie in a folder of their own.
ELSEWHERE = re.compile(r"op\d+_|pipeline$")
SINGLE_RULE = re.compile(r"(py|js|gen)_[A-Z]+\d+[ab]?$")
COVERED = {
    "report_header", "report_severity_table", "report_category_list", "report_ai", "report_critical", "report_warnings",
    "report_metrics", "sink_html", "sink_parquet", "filter_severity", "critical_error", "findings_listing", "total_findings",
    "category_counts", "warning_overflow", "top_warnings",
}
NAMES = [n for n in entry.oracle_sql() if n not in COVERED and not ELSEWHERE.match(n) and (not SINGLE_RULE.match(n) or n in ("py_C001", "py_E001"))]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "item"):
        value = value.item()
    return round(value, 6) if isinstance(value, float) else value


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_but_known_ones_has_sql():
    own = {n for n in entry.queries() if not ELSEWHERE.match(n)}
    assert own == {n for n in entry.oracle_sql() if not ELSEWHERE.match(n)}


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0
