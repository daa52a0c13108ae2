import random

from lineglass.operators import blocks

K = blocks.BLOCK_LINES


def brute(rows):
    """Blocks by the definition: runs of repeated k-line shingles of non-blank stripped lines."""
    places, files = {}, {}
    for project, path, content in rows:
        lines = [(n + 1, x.strip()) for n, x in enumerate((content or "").split("\n"))]
        filled = [(n, s) for n, s in lines if s]
        files[(project, path)] = filled
        for i in range(len(filled) - K + 1):
            key = tuple(s for _, s in filled[i : i + K])
            places.setdefault((project, key), []).append((path, i))
    found = []
    for (project, path), filled in files.items():
        rep = [i for i in range(len(filled) - K + 1) if len(places[(project, tuple(s for _, s in filled[i : i + K]))]) > 1]
        start = None
        for j, i in enumerate(rep):
            if start is None:
                start = i
            if j + 1 == len(rep) or rep[j + 1] != i + 1:
                found.append((project, path, start, i))
                start = None
    out = []
    for project, path, a, b in found:
        filled = files[(project, path)]
        content = tuple(s for _, s in filled[a : b + K])
        out.append((project, path, filled[a][0], filled[b + K - 1][0], b - a + K, content))
    result = []
    for project, path, first, last, n, content in out:
        same = sorted((p, f) for q, p, f, _, m, c in out if q == project and c == content and m == n)
        result.append((project, path, first, last, n, same[0][0], same[0][1], len(same)))
    return sorted(result)


def corpus():
    r = random.Random(2)
    pool = [f"line {k}" for k in range(12)] + ["", "   ", "  x = 1  "]
    header = "# licence\n# of this\n# project\n# all rights\n"
    rows = []
    for f in range(40):
        body = "\n".join(r.choice(pool) for _ in range(r.randint(0, 30)))
        rows.append((f"p{f % 2}", f"f{f:02d}.py", (header if f % 3 == 0 else "") + body))
    return rows


def test_blocks_equal_brute_force(spark, files):
    rows = corpus()
    got = sorted(tuple(x) for x in blocks.repeated_blocks(files(rows)).collect())
    assert got == brute(rows)
    assert any(x[-1] > 3 for x in got)


def test_odd_rows(spark, files):
    """Nulls, empty files, fewer lines than a shingle, repeated rows, one file twice."""
    rows = [("p", "a.py", None), ("p", None, "a\nb\nc\nd"), (None, "b.py", "a\nb\nc\nd"), ("p", "c.py", ""),
            ("p", "d.py", "a\nb\nc"), ("p", "e.py", "a\nb\nc\nd\n\na\nb\nc\nd"), ("p", "f.py", "a\nb\nc\nd"),
            ("p", "f.py", "a\nb\nc\nd")]
    got = sorted(tuple(x) for x in blocks.repeated_blocks(files(rows)).collect())
    assert got == [
        ("p", "e.py", 1, 4, 4, "e.py", 1, 4),
        ("p", "e.py", 6, 9, 4, "e.py", 1, 4),
        ("p", "f.py", 1, 4, 4, "e.py", 1, 4),
        ("p", "f.py", 1, 4, 4, "e.py", 1, 4),
    ]
    assert blocks.repeated_blocks(files([])).count() == 0
