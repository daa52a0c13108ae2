import json
import os

from lineglass.plans import followup
from lineglass.plans.review import Review, run_review
from lineglass.sources.files import read_file, read_tree, store_corpus, stream_tree
from lineglass.sources.linters import read_linter_text
from lineglass.streaming.arrivals import drain, stream_findings

TREE = {
    "app/main.py": b"def f(a=[]):\r\n    return eval(a)\r\npassword = 'abcdefgh'\r\n",
    "app/Page.JS": b"var x = 1\n/* hidden\nvar y = 2\n*/\n",
    "app/lib.go": b"// TODO\n\xff\n",
    "app/node_modules/skip.py": b"eval(1)\n",
    "app/x.egg-info/kept.py": b"x = 1\n",
    "app/deep/build/skip.js": b"var z\n",
    "app/package-lock.json": b"{}",
    "app/.py": b"eval(1)",
    "app/notes.txt": b"TODO",
    "app/empty.rb": b"",
    "app/_pkg/__init__.py": b"x = 1\n",
    "app/.hidden.ts": b"let a\n",
}


def make_tree(root):
    for name, data in TREE.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return str(root / "app")


def test_tree_selection_and_text(spark, tmp_path):
    got = {r.path: r.content for r in read_tree(spark, make_tree(tmp_path), "demo").collect()}
    assert set(got) == {"main.py", "Page.JS", "lib.go", "x.egg-info/kept.py", "empty.rb", "_pkg/__init__.py", ".hidden.ts"}
    assert got["lib.go"] == "// TODO\n\n"
    assert "\r" not in got["main.py"]


def test_a_named_file_is_taken_whatever_it_is(spark, tmp_path):
    make_tree(tmp_path)
    row = read_file(spark, str(tmp_path / "app/notes.txt")).first()
    assert (row.path, row.content) == ("notes.txt", "TODO")


def test_an_unreadable_file_counts_with_no_lines(spark):
    df = spark.createDataFrame([("p", x, None) for x in ("a.py", "b.js", "c.go")], "project string, path string, content string")
    done = Review(df)
    assert done.findings.count() == 0
    assert {tuple(m)[2:] for m in done.metrics.collect()} == {(0, 0, 0, 0, 0, 0, 0.0, 0.0)}
    assert done.totals.first().files_analyzed == 3


def test_symlinked_directories_are_not_entered(spark, tmp_path):
    root = make_tree(tmp_path)
    (tmp_path / "app/loop").symlink_to(tmp_path / "app", target_is_directory=True)
    assert not any(r.path.startswith("loop") for r in read_tree(spark, root).collect())


def test_run_review_stores_tables_and_reports(spark, tmp_path):
    files = read_tree(spark, make_tree(tmp_path), "demo")
    out = str(tmp_path / "out")
    done = run_review(files, out, "2026-01-01 00:00:00")
    rules = sorted((r.file, r.rule, r.line) for r in done.findings.collect())
    assert rules == [("Page.JS", "W005", 1), ("lib.go", "W001", 1), ("main.py", "B012", 1), ("main.py", "S001", 2), ("main.py", "SEC001", 3)]
    assert done.metrics.count() == 7

    folder = os.path.join(out, "json", "project=demo")
    parts = sorted(p for p in os.listdir(folder) if p.startswith("part"))
    document = json.loads("".join(open(os.path.join(folder, p), encoding="utf-8").read() for p in parts))
    assert list(document) == ["project_path", "timestamp", "files_analyzed", "total_lines", "issues", "metrics", "ai_summary", "ai_suggestions"]
    assert document["files_analyzed"] == 7 and len(document["issues"]) == 5 and len(document["metrics"]) == 7
    assert [i["file"] for i in document["issues"]] == sorted(i["file"] for i in document["issues"])
    stored = "".join(open(os.path.join(d, f), errors="ignore").read() for d, _, fs in os.walk(out) for f in fs if "json" in d or "md" in d or "html" in d)
    assert "abcdefgh" not in stored


def test_markdown_text(spark, tmp_path):
    files = read_tree(spark, make_tree(tmp_path), "demo")
    text = Review(files).markdown("NOW").first().report
    assert text == "\n".join([
        "# Code Review Report", "", "**Project:** `demo`", "**Date:** NOW", "**Files Analyzed:** 7", "**Total Lines:** 17", "", "---", "",
        "## Summary", "", "| Severity | Count |", "|----------|-------|", "| 🔴 Critical | 2 |", "| 🟠 Error | 1 |", "| 🟡 Warning | 0 |", "| 🔵 Info | 2 |", "",
        "### By Category", "", "- **style**: 2", "- **security**: 1", "- **secret**: 1", "- **bug**: 1", "",
        "## Critical & Error Issues", "",
        "### `main.py` line 2", "**[CRITICAL]** S001: Use of eval() is dangerous - can execute arbitrary code", "```\nreturn eval(a)\n```", "",
        "### `main.py` line 3", "**[CRITICAL]** SEC001: Hardcoded password detected", "> 💡 Move to environment variables or secrets manager", "",
        "### `main.py` line 1", '**[ERROR]** B012: Mutable default argument in function "f"', "> 💡 Use None as default and initialize inside function", "",
        "## Code Metrics", "", "| File | Lines | Complexity | Maintainability |", "|------|-------|------------|-----------------|",
        "| main.py | 3 | 1.0 | 82% |", "| .hidden.ts | 1 | 0.0 | 100% |", "| Page.JS | 1 | 0.0 | 100% |", "| __init__.py | 1 | 0.0 | 91% |",
        "| empty.rb | 0 | 0.0 | 0% |", "| lib.go | 1 | 0.0 | 0% |", "| kept.py | 1 | 0.0 | 91% |", "",
        "---", "*Generated by lineglass*",
    ])


def test_html_escapes_reviewed_text(spark, files):
    html = Review(files([("p", "a.py", "x = eval('<script>&')")])).html("NOW").first().report
    assert "<script>" not in html and "&lt;script>&amp;" in html
    assert "<h1>Code Review Report</h1>" in html and "<strong>Project:</strong> <code>p</code>" in html


def test_answers_appear_in_the_report(spark, files):
    answers = spark.createDataFrame([("p", "All good.", ["a", "b"])], "project string, ai_summary string, ai_suggestions array<string>")
    text = Review(files([("p", "a.go", ""), ("q", "b.go", "")]), answers=answers).markdown("NOW")
    got = {r.project: r.report for r in text.collect()}
    assert "## AI Review\n\nAll good.\n\n### Suggestions\n- a\n- b\n" in got["p"]
    assert "AI Review" not in got["q"]


def test_report_plan_has_no_cross_join(spark, files):
    plan = Review(files([("p", "a.py", "x")])).markdown("NOW")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_packed_corpus_gives_the_same_review_and_prunes(spark, tmp_path):
    files = read_tree(spark, make_tree(tmp_path), "demo")
    packed = store_corpus(files, str(tmp_path / "packed"))
    assert sorted(map(tuple, Review(packed).findings.collect())) == sorted(map(tuple, Review(files).findings.collect()))
    assert sorted(map(tuple, Review(packed).metrics.collect())) == sorted(map(tuple, Review(files).metrics.collect()))
    plan = packed.filter("family = 'python'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(family" in plan


def test_linter_text_files(spark, tmp_path):
    (tmp_path / "a.py.txt").write_text("\n 1:2:E1:x\n2:1:W1:y\n")
    got = [(r.path, r.position, r.value) for r in read_linter_text(spark, str(tmp_path)).collect()]
    assert got == [("a.py", 0, "1:2:E1:x"), ("a.py", 1, "2:1:W1:y")]


def test_changed_files_and_gate(spark, files):
    old, new = files([("p", "a", "1"), ("p", "b", "2")]), files([("p", "a", "1"), ("p", "b", "3"), ("p", "c", "4")])
    changed = followup.changed_files(new, followup.content_hashes(old))
    assert sorted(r.path for r in changed.collect()) == ["b", "c"]
    x = Review(files([("p", "a.py", "eval(x)"), ("q", "b.py", "x = 1")]))
    assert {r.project: r.gate for r in followup.release_gate(x.totals, x.findings).collect()} == {"p": "blocked", "q": "passed"}


def test_a_stream_picks_up_only_new_files(spark, tmp_path):
    root = make_tree(tmp_path)
    out, state = str(tmp_path / "found"), str(tmp_path / "state")
    run = lambda: drain(stream_findings(stream_tree(spark, root, "demo")), out, state)
    first = run().count()
    (tmp_path / "app/new.py").write_bytes(b"exec(x)\n")
    assert run().count() == first + 1
    assert run().count() == first + 1


def test_file_changes_tell_new_changed_and_removed(spark, files):
    from lineglass.plans.followup import content_hashes, file_changes

    before = files([("p", "same", "a"), ("p", "changed", "b"), ("p", "removed", "c"), ("p", "unreadable", None), ("p", "lost", "d")])
    now = files([("p", "same", "a"), ("p", "changed", "B"), ("p", "new", "e"), ("p", "unreadable", None), ("p", "lost", None)])
    got = {r.path: r.state for r in file_changes(now, content_hashes(before)).collect()}
    assert got == {"changed": "changed", "removed": "removed", "new": "new", "lost": "changed"}


def test_now_is_a_report_date():
    import re

    from lineglass.plans.review import now

    assert re.fullmatch(r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d", now())
