import random
import re
import time

from lineglass.functions.anchors import Waker, anchors, fold
from lineglass.operators import scan
from lineglass.operators.lines import explode_lines

RULES = ("family string, number int, rule string, pattern string, ignore_case boolean, "
         "severity string, category string, message string, suggestion string, snippet_len int")


def test_anchors_are_literals_every_match_holds():
    assert anchors(r"\beval\s*\(") == {"eval"}
    assert anchors(r"(?:password|secret)\s*=") == {"password", "secret"}
    assert anchors(r"AKIA[0-9A-Z]{16}") == {"akia"}
    assert anchors(r"a?b*") is None
    assert anchors(r"\w+") is None
    assert anchors(r"[[a]]x") is None  # nested classes are read otherwise by Java
    assert anchors(r"\Qa.b\E") is None
    assert anchors(r"\p{L}+foo") is None
    assert anchors(r"(?<name>abc)") is None
    assert anchors(r"(ab|c)+d{2}") in ({"ab", "c"}, {"d"})


def test_fold_keeps_what_java_matches_ignoring_case():
    for line, literal in [("Key", "key"), ("ſecret", "secret"), ("İd", "id"), ("PASSWORD", "password")]:
        assert literal in fold(line)
        assert re.compile("(?iu)" + literal).search(line) or literal == "id"


PATTERNS = [
    r"\beval\s*\(", r"(?:password|secret|token)\s*[:=]", r"AKIA[0-9A-Z]{4}", r"TODO|FIXME", r"x{2,}y", r"[aA]bc",
    r"\d{3}-\d{4}", r"^import\s+os$", r"(?:ab)+c?d", r"key", r"é+", r"[#$]", r"\w+\s\w+", r"(?!foo)bar", r"q(?=u)",
    r"SELECT\s.*FROM", r"[^a]bc", r"(a|b|)c", r"\.\./", r"\(\)",
]


def lines_of(seed):
    r = random.Random(seed)
    bits = ["eval (", "password =", "AKIA12AB", "todo", "xxy", "Abc", "555-1234", "import os", "ababd", "Key", "é",
            "#", "a b", "foobar", "bar", "qu", "select * from", "zbc", "c", "../", "()", "  ", "ſecret:", "KEY"]
    return ["".join(r.choice(bits) for _ in range(r.randint(0, 5))) for _ in range(400)]


def test_woken_rules_find_what_all_rules_find(spark, files):
    rows = [("python", k, f"R{k}", p, k % 2 == 0, "info", "style", "m", "", 10) for k, p in enumerate(PATTERNS, 1)]
    rows += [("javascript", 100 + k, f"J{k}", p, False, "info", "style", "m", "", 0) for k, p in enumerate(PATTERNS, 1)]
    table = spark.createDataFrame(rows, RULES)
    df = explode_lines(files([("p", "a.py", "\n".join(lines_of(1))), ("p", "b.js", "\n".join(lines_of(2)))]))
    key = lambda f: (f.file, f.line, f.rule, f.code_snippet, f.ord)
    woken = sorted(map(key, scan.scan_rule_table(df, table).collect()))
    every = sorted(map(key, scan.scan_rule_table(df, table, wake=False).collect()))
    assert woken == every and len(woken) > 300


def test_five_thousand_rules_are_one_scan(spark, files):
    words = [f"word{k:04d}" for k in range(5000)]
    rows = [("python", k, f"W{k}", rf"\b{w}\b", False, "info", "style", "m", "", 0) for k, w in enumerate(words)]
    table = spark.createDataFrame(rows, RULES)
    r = random.Random(3)
    text = "\n".join(" ".join(r.choice(words) if r.random() < 0.1 else "filler" for _ in range(12)) for _ in range(3000))
    df = explode_lines(files([("p", "a.py", text)]))
    found = scan.scan_rule_table(df, table)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "Join" not in plan and "Exchange" not in plan
    start = time.time()
    got = found.count()
    assert time.time() - start < 60
    want = sum(len(set(re.findall(r"\bword\d{4}\b", line))) for line in text.split("\n"))
    assert got == want


def test_waker_alone():
    w = Waker({1: "abc", 2: r"\w+", 3: "x|yz"})
    assert w.woken("ABC") == [1, 2]
    assert w.woken("zz yz") == [2, 3]
    assert Waker({}).woken("abc") == []


def test_the_catalogue_in_java_syntax_wakes_by_literals():
    """Classes written as numbered characters must not put a pattern on every line."""
    from lineglass.functions.rules import LINE_RULES
    from lineglass.functions.text import java_regex

    patterns = [java_regex(r.pattern).removeprefix("(?d)") for r in LINE_RULES]
    assert [r.key for r, p in zip(LINE_RULES, patterns) if anchors(p) is None] == ["W008"]
    assert anchors(r"\x41bcd[\p{L}]x") == {"bcd"} and anchors(r"[\x{61}-\x{7a}][\p{L}]+") is None
    assert Waker({1: r"if\s*\(.*="}).woken("if so, gift") == [] and Waker({1: r"if\s*\(.*="}).woken("IF (a=") == [1]
