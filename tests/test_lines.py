import io
import random

from lineglass.operators.lines import classify_lines, explode_lines, line_counts


def by_hand(path, content):
    """Lines, classes and skips by a plain loop."""
    family = {"py": "python", "js": "javascript"}.get(path.rsplit(".", 1)[-1], "generic")
    lines = [x.removesuffix("\n") for x in io.StringIO(content, newline="\n")] if family == "generic" else content.split("\n")
    out, inside = [], False
    for n, line in enumerate(lines, 1):
        text, skipped = line.strip(), False
        if family == "javascript":
            inside = "*/" not in line and (inside or "/*" in line)
            skipped = inside or "*/" in line
        mark = {"python": "#", "javascript": "//"}.get(family)
        kind = "comment" if skipped else "blank" if not text else "comment" if mark and text.startswith(mark) else "code"
        out.append((n, line, skipped, kind))
    return out


def random_files(seed, count=300):
    rng = random.Random(seed)
    pieces = ["/*", "*/", "\n", "\n", " ", "x", "//", "#", "/", "*", "é", "\u00a0", "\n/*", "*/\n", "/*/"]
    for i in range(count):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(40)))
        yield ("p", f"f{i}.{rng.choice(['py', 'js', 'go'])}", text)


def test_lines_and_block_comments_match_a_loop(spark, files):
    rows = list(random_files(1)) + [("p", "e.go", ""), ("p", "e.js", ""), ("p", "n.go", "\n"), ("p", "e.py", "")]
    got = {}
    for r in classify_lines(explode_lines(files(rows))).collect():
        got.setdefault(r.path, []).append((r.line_no, r.line, r.skipped, r.line_class))
    for _, path, content in rows:
        assert sorted(got.get(path, [])) == by_hand(path, content), (path, content)


def test_line_counts_match_a_loop(spark, files):
    rows = list(random_files(2))
    got = {r.path: (r.lines_total, r.lines_code, r.lines_comment, r.lines_blank) for r in line_counts(files(rows)).collect()}
    for _, path, content in rows:
        kinds = [k for *_, k in by_hand(path, content)]
        assert got[path] == (len(kinds), kinds.count("code"), kinds.count("comment"), kinds.count("blank")), (path, content)


def test_long_block_comment_is_one_pass(spark, files):
    content = "/* start\n" + "x\n" * 200_000 + "*/\ny"
    row = line_counts(files([("p", "a.js", content)])).first()
    assert (row.lines_total, row.lines_comment, row.lines_code) == (200_003, 200_002, 1)


def test_counting_and_exploding_do_not_shuffle(spark, files):
    df = files([("p", "a.py", "x")])
    for plan in (line_counts(df), classify_lines(explode_lines(df))):
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
