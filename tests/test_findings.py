import json
import random

from pyspark.sql import functions as F

from lineglass.operators import findings as f
from lineglass.operators import rollups
from lineglass.sources import linters

SCHEMA = ("project string, file string, line int, `column` int, severity string, category string, rule string, "
          "message string, suggestion string, code_snippet string, ord bigint")


def finding(project="p", file="d/a.py", line=1, severity="info", category="style", ord=None, message="m"):
    return (project, file, line, 0, severity, category, "R", message, "", "", line * 1000 if ord is None else ord)


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_numbering_is_exact_with_a_hot_project(spark):
    rng = random.Random(4)
    rows = [finding("hot" if rng.random() < 0.7 else f"p{rng.randrange(5)}", f"f{rng.randrange(40)}.py", i) for i in range(3000)]
    got = f.finding_ordinal(table(spark, rows).repartition(6))
    by_project = {}
    for r in got.collect():
        by_project.setdefault(r.project, []).append((r.ordinal, r.file, r.ord))
    assert sum(map(len, by_project.values())) == len(rows)
    for found in by_project.values():
        found.sort()
        assert [n for n, *_ in found] == list(range(1, len(found) + 1))
        assert [x[1:] for x in found] == sorted(x[1:] for x in found)


def test_a_hot_project_is_numbered_on_several_tasks(spark):
    rows = spark.range(20000).select(F.lit("hot").alias("project"), F.col("id").cast("string").alias("file"), F.lit(1).alias("ord"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = rows.repartitionByRange("project", "file", "ord").groupBy(F.spark_partition_id()).count().collect()
        assert len(placed) > 1 and max(r["count"] for r in placed) < 20000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_lookup_takes_the_first_of_the_same_name_line_and_severity(spark):
    rows = [finding(file="z/a.py", message="later"), finding(file="b/a.py", message="second", ord=2), finding(file="b/a.py", message="first", ord=1),
            finding(file="b/a.py", severity="error", message="other")]
    got = {(r.name, r.line, r.severity): r.message for r in f.finding_lookup(table(spark, rows)).collect()}
    assert got == {("a.py", 1, "info"): "first", ("a.py", 1, "error"): "other"}


def test_union_keeps_equal_rows(spark):
    one = table(spark, [finding()])
    assert f.union_findings(one, one, one).count() == 3


def test_equal_category_counts_keep_first_seen_order(spark):
    rows = [finding(category="b", line=1), finding(category="a", line=2), finding(category="c", line=3), finding(category="c", line=4)]
    got = rollups.categories_ranked(table(spark, rows)).orderBy("rank").collect()
    assert [(r.category, r.n) for r in got] == [("c", 2), ("b", 1), ("a", 1)]


def test_severity_table_is_filled_with_zeros(spark):
    projects = spark.createDataFrame([("p",), ("none",)], "project string")
    got = rollups.severity_table(projects, table(spark, [finding(severity="error")])).orderBy("project", "rank").collect()
    assert [(r.project, r.severity, r.n) for r in got] == [
        ("none", "critical", 0), ("none", "error", 0), ("none", "warning", 0), ("none", "info", 0),
        ("p", "critical", 0), ("p", "error", 1), ("p", "warning", 0), ("p", "info", 0)]


def test_top_lists_only_send_their_limit_per_task(spark):
    rows = [finding(severity="warning", line=i) for i in range(50)]
    top = rollups.top_warnings(table(spark, rows))
    assert [r.line for r in top.orderBy("rank").collect()] == list(range(20))
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_linter_text(spark):
    rows = ["3:7:E501: line too long ", "4:1:W291:trailing", "note", " 5:1:E1:x", "6:1:F401:unused: os", "7:1::x", "8:1:E2:", "99999999999:1:E1: x", "9:99999999999:E1: x"]
    df = spark.createDataFrame([("p", "a.py", i, v) for i, v in enumerate(rows)], "project string, path string, position int, value string")
    got = [(r.line, r.column, r.severity, r.rule, r.message) for r in linters.text_findings(df).orderBy("ord").collect()]
    assert got == [(3, 7, "error", "E501", "line too long"), (4, 1, "warning", "W291", "trailing"), (6, 1, "warning", "F401", "unused: os")]


def test_linter_reports(spark):
    results = [
        {"line_number": 3, "issue_severity": "HIGH", "test_id": "B602", "issue_text": "t", "code": "c" * 90},
        {"issue_severity": "LOW"}, {"issue_severity": "ODD", "code": None}, {},
        {"line_number": "7"}, {"line_number": "many"},
    ]
    rows = [("p", "a.py", json.dumps({"results": results})), ("p", "b.py", "{}"), ("p", "c.py", "not json")]
    got = linters.report_findings(spark.createDataFrame(rows, "project string, path string, json string")).orderBy("ord").collect()
    assert [(r.line, r.severity, r.rule, r.message, r.code_snippet) for r in got] == [
        (3, "error", "B602", "t", "c" * 80), (1, "info", "B000", "", ""), (1, "warning", "B000", "", ""), (1, "warning", "B000", "", ""),
        (7, "warning", "B000", "", ""), (1, "warning", "B000", "", "")]


def test_linter_files_are_read(spark, tmp_path):
    (tmp_path / "a.py.json").write_text(json.dumps({"results": [{"line_number": 4}]}, indent=2))
    got = linters.report_findings(linters.read_linter_reports(spark, str(tmp_path))).collect()
    assert [(r.file, r.line) for r in got] == [("a.py", 4)]


def test_detail_hides_redacted_snippets(spark):
    rows = [("p", "d/a.py", 2, 0, "critical", "secret", "SEC001", "msg", "fix", "[REDACTED]", 1), ("p", "b.py", 3, 1, "info", "style", "W1", "m", "", "code", 2)]
    got = [r[0] for r in table(spark, rows).orderBy("ord").select(f.detail_text()).collect()]
    assert got == [
        "File: d/a.py\nLine: 2, Column: 0\nSeverity: CRITICAL\nCategory: secret\nRule: SEC001\n\nmsg\n\n💡 Suggestion:\nfix",
        "File: b.py\nLine: 3, Column: 1\nSeverity: INFO\nCategory: style\nRule: W1\n\nm\n\nCode:\ncode"]
