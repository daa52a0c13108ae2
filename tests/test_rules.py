import random
import re

import pytest
from pyspark.sql import functions as F

from checks.probes import PROBES, expand, snippets
from lineglass.functions import rules as r
from lineglass.functions.text import java_regex
from lineglass.operators import scan
from lineglass.operators.lines import explode_lines

EXTENSION = {"python": "py", "javascript": "js", "generic": "go"}


def python_hits(family, line):
    """Rules that hold by Python's own regular expressions."""
    hits = [
        x.key for x in r.LINE_RULES
        if x.family == family and re.search(x.pattern, line, re.IGNORECASE if x.ignore_case else 0)
    ]
    return hits + (["E501"] if family == "python" and len(line) > 120 else [])


def spark_hits(spark, files, family, lines, rules=r.ALL_RULES):
    rows = [("p", f"{i}.{EXTENSION[family]}", line) for i, line in enumerate(lines)]
    numbers = {x.number: x.key for x in r.ALL_RULES if x.family == family}
    got = {i: [] for i in range(len(lines))}
    for f in scan.scan_rules(explode_lines(files(rows)), rules).orderBy("ord").collect():
        got[int(f.file.split(".")[0])].append(numbers[f.ord % scan.SLOT])
    return got


def test_catalogue_is_complete():
    assert (len(r.PYTHON_RULES), len(r.JS_RULES), len(r.GENERIC_RULES)) == (39, 20, 7)
    assert {(f, k) for f, k, *_ in PROBES} == {(x.family, x.key) for x in r.LINE_RULES}


@pytest.mark.parametrize("family", EXTENSION)
def test_every_rule_fires_on_its_line_and_not_on_the_near_miss(spark, files, family):
    cases = [(k, expand(hit), expand(miss)) for f, k, hit, miss in PROBES if f == family]
    hits = spark_hits(spark, files, family, [h for _, h, _ in cases])
    misses = spark_hits(spark, files, family, [m for *_, m in cases])
    for i, (key, *_) in enumerate(cases):
        assert key in hits[i]
        assert key not in misses[i]


@pytest.mark.parametrize("family", EXTENSION)
def test_scan_agrees_with_python_on_mixed_up_lines(spark, files, family):
    rng = random.Random(family)
    words = [w for s in snippets(family) for w in re.split(r"(\W)", s) if w]
    odd = ["\u00a0", "\u2028", "\x1c", "\x85", "é", "\u212a", "\u017f", "\u0131", "\u0130", "e\u0301", "$", "\\", "'", '"', "_", "٣"]
    lines = []
    for s in snippets(family):
        lines += [s.upper(), s.lower(), "é" + s, s + "é", s.replace(" ", "\u00a0"), s.replace("k", "\u212a").replace("s", "\u017f")]
        lines += [s.replace("i", "\u0131").replace(" ", "\x1d"), s * 5, " " * 130 + s]
    for _ in range(1500):
        picked = [rng.choice(words + odd + [" ", "(", ")", "="]) for _ in range(rng.randrange(1, 14))]
        lines.append("".join(picked))
    lines = [x.replace("\n", " ").replace("/*", "").replace("*/", "") for x in lines]
    got = spark_hits(spark, files, family, lines)
    for i, line in enumerate(lines):
        assert got[i] == python_hits(family, line), repr(line)


def test_secret_lines_never_leave_the_scan(spark, files):
    lines = [expand(hit) for f, k, hit, _ in PROBES if f == "python" and k.startswith("SEC")]
    found = scan.scan_rules(explode_lines(files([("p", "a.py", "\n".join(lines))])))
    for f in found.filter("category = 'secret'").collect():
        assert f.code_snippet == "[REDACTED]"
        assert f.suggestion == r.SECRET_SUGGESTION
        assert not any(line in str(v) for v in f for line in lines)


def test_snippets_are_stripped_and_cut(spark, files):
    content = "  eval(" + "x" * 200 + "\n" + "  # TODO: " + "y" * 100
    got = {f.rule: f.code_snippet for f in scan.scan_rules(explode_lines(files([("p", "a.py", content)]))).collect()}
    assert got["S001"] == ("eval(" + "x" * 200)[:100]
    assert got["W002"] == ("# TODO: " + "y" * 100)[:80]
    assert got["E501"] == ""


def test_long_lines_count_code_points(spark, files):
    found = scan.scan_rules(explode_lines(files([("p", "a.py", "😀" * 121 + "\n" + "😀" * 120)]))).collect()
    assert [(f.line, f.column, f.message) for f in found] == [(1, 120, "Line too long (121 > 120 characters)")]


RULES = ("family string, number int, rule string, pattern string, ignore_case boolean, "
         "severity string, category string, message string, suggestion string, snippet_len int")


def rule_rows(patterns, start=0):
    return [("python", start + k, f"X{k}", p, False, "info", "style", "m", "", 0) for k, p in enumerate(patterns, 1)]


@pytest.mark.parametrize("more", [0, 400, 600, 5000])
def test_rule_tables_of_any_size_mean_the_same(spark, files, more):
    patterns = [r"\b(?:eval|exec)\s*\(", r"na\sb", r"^\wx=1", r"\bend\b", "é", "="]
    filler = [(f, n, "F", "never\u0001", False, "info", "style", "m", "", 0) for f, n in (("python", k) for k in range(more))]
    table = spark.createDataFrame(rule_rows(patterns, 2000) + filler, RULES)
    df = explode_lines(files([("p", "a.py", "eval (1)\nna\u00a0b\néx=1\nax=1\nthe end.\nna b")]))
    found = scan.scan_rule_table(df, table)
    if more == 600:
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan
    got = [(f.line, f.rule) for f in found.orderBy("ord").collect()]
    # Java's own reading: \\s and \\w are ASCII without a flag.
    assert got == [(1, "X1"), (3, "X5"), (3, "X6"), (4, "X3"), (4, "X6"), (5, "X4"), (6, "X2")]


def test_an_empty_rule_table_finds_nothing(spark, files):
    df = explode_lines(files([("p", "a.py", "eval(1)")]))
    assert scan.scan_rule_table(df, spark.createDataFrame([], RULES)).collect() == []


def test_word_edges_are_read_as_python_reads_them(spark):
    lines = ["a (b)", "x.y", "(end)", " é", "é(", "end", "_(", "", "  "]
    for pattern in [r"\b\(", r"\(\b", r"\b\w+\b", r"x\b.", r"\s\b", r".\bend", r"\w\b\W"]:
        got = spark.createDataFrame([(x,) for x in lines], "line string").select(
            F.col("line").rlike(java_regex(pattern)).alias("hit")
        )
        assert [r.hit for r in got.collect()] == [bool(re.search(pattern, x)) for x in lines], pattern


PROVOKING = {
    "python": ["assert x # ", "subprocess.call(", "yaml.load( Loader ", "if x = ", "random.x(", "print (", "password = '", "type ( x ",
               "yaml.load(a) ", "random.x(a) ", "random.x secrets "],
    "javascript": ["if (a = b ", "if (a ", ".html (a ", "if ( =", "new Function ", "api_key = '", "if (a) ", "a.html(b) "],
}


@pytest.mark.parametrize("family", PROVOKING)
def test_long_lines_do_not_hold_up_a_task(spark, files, family):
    import time

    # Every line is tried by all rules of its family; the provoked one may not take long.
    for text in PROVOKING[family]:
        df = explode_lines(files([("p", f"a.{EXTENSION[family]}", text * (200_000 // len(text)))]))
        start = time.monotonic()
        scan.scan_rules(df).collect()
        assert time.monotonic() - start < 20, text


def test_taken_apart_patterns_hit_what_python_hits(spark, files):
    rng = random.Random(11)
    parts = {
        "javascript": ["if", " ", "(", ")", "=", "==", "a", "if (", ") ", ".html("],
        "python": ["assert ", "x", "#", "security", " ", "subprocess.call", "(", ")", "shell", "=", "True", "yaml.load", "Loader", "None", "random.", "secrets"],
    }
    for family, words in parts.items():
        lines = ["".join(rng.choice(words) for _ in range(rng.randrange(1, 16))) for _ in range(3000)]
        lines = [x for x in lines if x.strip() and "//" not in x]
        got = spark_hits(spark, files, family, lines)
        for i, line in enumerate(lines):
            assert got[i] == python_hits(family, line), repr(line)


def test_scan_has_no_shuffle(spark, files):
    plan = scan.scan_rules(explode_lines(files([("p", "a.py", "x")])))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
