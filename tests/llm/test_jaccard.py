import random
import re

import numpy as np
import pandas as pd

from lineglass.llm import jaccard_join
from tests.llm import helpers as h


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    if len(words) < width:
        return {" ".join(words)}
    return {" ".join(words[k : k + width]) for k in range(len(words) - width + 1)}


def brute(ids, texts, percent=80):
    """Least id reachable over all pairs whose Jaccard reaches the threshold."""
    sets = [shingles(t) for t in texts]
    root = {k: ids[k] for k in range(len(ids))}
    changed = True
    while changed:
        changed = False
        for a in range(len(ids)):
            for b in range(len(ids)):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    if root[b] < root[a]:
                        root[a], changed = root[b], True
    return [len(s) for s in sets], [root[k] for k in range(len(ids))]


def near_texts():
    r = random.Random(7)
    out = []
    for s in range(40):
        words = h.prose(s, r.choice([3, 8, 20, 60, 150, 400])).split()
        out.append(" ".join(words))
        for k in range(s % 5):
            w = list(words)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = f"changed{r.randint(0, 9)}"
            if r.random() < 0.3:
                del w[r.randrange(len(w))]
            out.append(" ".join(w))
    return [*out, *out[:6], "", None, " ", "One Two", "one two", "a b c d e f"]


def test_components_equal_all_pairs(spark):
    texts = near_texts()
    ids = list(range(len(texts)))
    sizes, roots = brute(ids, texts)
    got = {r.doc_id: r for r in jaccard_join.joined(h.documents(spark, texts)).collect()}
    assert [got[i].n_shingles for i in ids] == sizes
    assert [got[i].component_id for i in ids] == roots
    assert len({*roots}) < len(texts) - 30


def test_bands_cover_every_linked_pair():
    table = jaccard_join.bands(80, 5000)
    band = lambda n: next(b for b, lo, hi, _ in table if lo <= n < hi)
    for r in range(1, 3000):
        for s in (r, r * 100 // 80):
            assert band(s) - band(r) in (0, 1)
            assert (r * 20 // 80) + 1 <= table[band(r)][3]


def test_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, one id with two texts, clashing columns."""
    odd = h.odd(spark).withColumn("node", h.odd(spark).columns and __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
    rows = jaccard_join.joined(odd.withColumn("set", odd.text).withColumn("sig", odd.doc_id)).collect()
    assert len(rows) == 10
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[None][0].component_id is None
    assert by[1][0].n_shingles == 0 and by[1][0].component_id == 1
    assert by[2][0].n_shingles == 0 and by[2][0].component_id == 2
    assert {r.component_id for r in by[4]} == {4}
    assert by[3][0].n_shingles > 29_000
    assert jaccard_join.joined(h.documents(spark, [])).count() == 0


def every_link(texts, percent=80):
    sets = [shingles(t) for t in texts]
    out = set()
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[a] != sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                out |= {(frozenset(sets[a]), frozenset(sets[b])), (frozenset(sets[b]), frozenset(sets[a]))}
    return sets, out


def test_links_within_a_component_are_all_counted(spark, monkeypatch):
    """Near copies of one text link with one another, not only with the least of them."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 700)
    base = h.prose(5, 120).split()
    texts = [*near_texts(), *(" ".join([*base[:k], "else", *base[k + 1 :]]) for k in range(0, 120, 4))]
    texts += [" ".join(base[:k]) for k in range(70, 120, 5)]
    sets, want = every_link(texts)
    got = {r.doc_id: r.n_links for r in jaccard_join.joined(h.documents(spark, texts)).collect()}
    assert got == {k: sum(a == s for a, _ in want) for k, s in enumerate(sets)}
    _, _, pairs = jaccard_join.links(h.documents(spark, texts))
    assert pairs.count() == pairs.distinct().count() == len(want) // 2


def test_two_texts_of_one_id_and_rows_without_id_keep_their_links(spark):
    a, b = h.prose(11, 80).split(), h.prose(12, 80).split()
    near = lambda words: " ".join([*words[:40], "else", *words[41:]])
    texts = [" ".join(a), " ".join(b), near(a), near(b), " ".join([*a[:39], "other", *a[40:]])]
    rows = jaccard_join.joined(h.documents(spark, texts, [4, 4, 7, 8, None])).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.n_links) for r in rows) == [(0, 4, 2), (4, 4, 1), (4, 4, 2), (7, 4, 2), (8, 4, 1)]


def test_sets_that_share_too_few_keys_do_not_meet(spark, monkeypatch):
    """Texts with one passage in common but no more are not met as pairs; linked ones still are."""
    met = []
    sized = jaccard_join._sized
    monkeypatch.setattr(jaccard_join, "_sized", lambda pairs, *a: met.append(pairs.count()) or sized(pairs, *a))
    monkeypatch.setattr(jaccard_join, "FREQUENT", 0)
    passage = h.prose(99, 30)
    texts = [f"{h.prose(200 + k, 60)} {passage} {h.prose(400 + k, 60)}" for k in range(60)] + near_texts()
    ids = list(range(len(texts)))
    sizes, roots = brute(ids, texts)
    got = {r.doc_id: r for r in jaccard_join.joined(h.documents(spark, texts)).collect()}
    assert [got[i].component_id for i in ids] == roots
    assert [got[i].n_shingles for i in ids] == sizes
    # 60 * 59 / 2 pairs for each key of the passage before.
    assert met[1] < 1500


def test_linked_sets_share_the_least_number_of_keys(spark):
    """The bound, against sets of any two sizes that reach the threshold as barely as can be."""
    sizes = [(a, b) for a in range(1, 60) for b in range(a, a * 100 // 80 + 1)]
    rows = spark.createDataFrame(sizes, "na long, nb long").selectExpr("na", "nb", f"{jaccard_join._least_keys(80)} AS least").collect()
    for a, b, least in rows:
        shared = -(-80 * (a + b) // 180)
        left = -(-80 * b // 100) - 1
        assert least == max(1, shared - left)


def test_near_copies_that_fall_short_make_no_table_of_pairs(spark, monkeypatch):
    """Copies of one text with so many changes that few pairs link are compared within a family."""
    met = []
    sized = jaccard_join._sized
    monkeypatch.setattr(jaccard_join, "_sized", lambda pairs, *a: met.append(pairs.count()) or sized(pairs, *a))
    monkeypatch.setattr(jaccard_join, "FREQUENT", 0)
    r, base = random.Random(3), h.prose(21, 300).split()
    texts = []
    for k in range(60):
        words = list(base)
        for n in r.sample(range(300), 8):
            words[n] = f"other{k}"
        texts.append(" ".join(words))
    texts += near_texts()
    ids = list(range(len(texts)))
    sizes, roots = brute(ids, texts)
    sets, want = every_link(texts)
    got = {r.doc_id: r for r in jaccard_join.joined(h.documents(spark, texts)).collect()}
    assert [got[i].component_id for i in ids] == roots
    assert [got[i].n_links for i in ids] == [sum(a == s for a, _ in want) for s in sets]
    # 60 * 59 / 2 pairs with many keys each before; now no more than the entries of the star.
    assert met[1] < met[0]


def test_a_forest_ties_what_all_links_tie(spark):
    """Within one block and across two, a task's few links tie the same sets as all of its links."""
    r = random.Random(5)
    groups = [[sorted(r.sample(range(100 * g, 100 * g + 24), 21)) for _ in range(12)] for g in range(4)]
    sets = [s for group in groups for s in group]
    for sides in ([0] * len(sets), [1 + k % 2 for k in range(len(sets))]):
        rows = pd.DataFrame({"sig": range(len(sets)), "set": [np.array(s) for s in sets], "side": sides})

        def tied(what):
            found, root = jaccard_join._compared(80, what)(rows), list(range(len(sets)))
            for a, b in zip(found["a"], found["b"]):
                root = [root[a] if x == root[b] else x for x in root]
            return len(found), [min(k for k in range(len(sets)) if root[k] == x) for x in root]

        forest, every = tied("forest"), tied("links")
        assert forest[1] == every[1] and forest[0] == len(sets) - len({*every[1]}) < every[0]
