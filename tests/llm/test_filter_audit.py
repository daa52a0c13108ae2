import random
import re
from itertools import permutations

from lineglass.llm import filter_audit
from tests.llm import helpers as h


def brute(rows, labels):
    """Filters applied one after another to a list of documents, order by order."""
    marks = {}
    for d, q, x in labels:
        old = marks.get(d, (0, 0))
        marks[d] = (max(old[0], q == 1), max(old[1], x == 1))
    fails = []
    for doc_id, text, source in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = set()
        if len(w) < 200:
            f.add("A")
        if 100 * len(set(w)) < 50 * len(w):
            f.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t):
            f.add("C")
        if re.search("[#$%&*|]", t):
            f.add("D")
        if doc_id is not None and any(o is not None and o < doc_id and (u or "") == t for o, u, _ in rows):
            f.add("E")
        fails.append((source or "", f, marks.get(doc_id, (0, 0))))
    out = {}
    for part in {p for p, _, _ in fails}:
        docs = [(f, m) for p, f, m in fails if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = list(docs)
            for step, letter in enumerate(order):
                gone = [d for d in left if letter in d[0]]
                left = [d for d in left if letter not in d[0]]
                failing = sum(letter in d[0] for d in docs)
                out[(part, order, step + 1)] = [
                    len(left),
                    len(gone),
                    failing - len(gone),
                    sum(d[0] == {letter} for d in docs),
                    sum(d[1][0] for d in gone),
                    sum(d[1][1] for d in gone),
                ]
        for order in map("".join, permutations("ABCDE")):
            for step, letter in enumerate(order):
                out[(part, order, step + 1)].append(
                    sum(out[(part, o, o.index(letter) + 1)][1] for o in map("".join, permutations("ABCDE")))
                )
    return out


def fixture():
    r = random.Random(4)
    rows = []
    for i in range(60):
        n = r.choice([0, 5, 150, 199, 200, 260])
        words = [r.choice(["aa", "bb", "Cc", "DD", "ee"]) if r.random() < 0.5 else f"w{k}" for k in range(n)]
        text = " ".join(words) + r.choice(["", " #", " x|y", " ALL CAPS HERE"])
        rows.append((r.randint(0, 40), r.choice([text, text, None, ""]), r.choice(["a", "b", None])))
    rows += [rows[3], rows[3], (None, rows[5][1], "a"), (41, rows[7][1], "c")]
    labels = [(r.randint(0, 45), r.randint(0, 1), r.randint(0, 1)) for _ in range(50)]
    return rows, labels


def test_audit_equals_filters_applied_in_turn(spark):
    rows, labels = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = filter_audit.audit(docs, h.labels(spark, labels)).collect()
    want = brute(rows, labels)
    assert len(got) == len(want) == 600 * len({(s or "") for _, _, s in rows})
    for r in got:
        assert [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] == want[
            (r.part, r.filter_order, r.step)
        ], (r.part, r.filter_order, r.step)


def test_odd_rows(spark):
    """Nulls everywhere, long, empty and repeated texts, clashing columns; an empty table."""
    odd = h.odd(spark)
    odd = odd.withColumn("fail_a", odd.doc_id).withColumn("part", odd.text)
    rows = filter_audit.audit(odd, h.labels(spark, [(4, 1, 1), (4, 1, 0), (None, 1, 1)])).collect()
    assert len(rows) == 600 * 4
    first = {r.part: r for r in rows if r.filter_order == "ABCDE" and r.step == 5}
    assert first[""].kept + sum(r.removed for r in rows if r.part == "" and r.filter_order == "ABCDE") == 1
    assert sum(r.removed for r in rows if r.part == "a" and r.filter_order == "EDCBA") == 5
    empty = filter_audit.audit(h.documents(spark, []), h.labels(spark, []))
    assert empty.count() == 0
