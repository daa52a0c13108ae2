import re

import xxhash
from pyspark.sql import functions as F

from lineglass.llm import components, simhash_links
from tests.llm import helpers as h


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    parts = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


def brute_components(prints):
    """Index -> least index reachable over at most three differing bits."""
    root = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 3 and root[j] < root[i]:
                    root[i], changed = root[j], True
    return root


def near_copies(count):
    texts = []
    for s in range(count):
        words = h.prose(s, 150).split()
        texts.append(" ".join(words))
        for k in range(s % 4):
            words[10 + 30 * k] = "changed"
            texts.append(" ".join(words))
    return [*texts, *texts[:5], "", None, "  ", "One", "one", "Été A b", "x y", "X Y"]


def test_fingerprints_and_components_equal_brute_force(spark):
    texts = near_copies(14)
    prints = [brute_fingerprint(t) for t in texts]
    rows = {r.doc_id: r for r in simhash_links.near_duplicates(h.documents(spark, texts)).collect()}
    assert [rows[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [rows[i].component_id for i in range(len(texts))] == brute_components(prints)


def test_every_pair_within_three_bits_is_met(spark):
    import random

    r = random.Random(5)
    prints = []
    for _ in range(120):
        base = r.getrandbits(64)
        prints.append(base)
        for flips in (1, 2, 3, 4):
            x = base
            for b in r.sample(range(64), flips):
                x ^= 1 << b
            prints.append(x)
    signed = [p - (1 << 64) if p >> 63 else p for p in set(prints)]
    got = {(x.a, x.b) for x in simhash_links.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert got == want


def test_components_of_long_paths_and_stars(spark):
    path = [(k, k + 1) for k in range(40)]
    star = [(100, k) for k in range(101, 140)] + [(139, 100), (100, 100)]
    links = spark.createDataFrame([*path, *star, (7, 8)], "a long, b long")
    roots = {r.node: r.root for r in components.components(links).collect()}
    assert roots == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 140)}}
    assert components.components(links.limit(0)).collect() == []


def test_odd_rows(spark):
    rows = simhash_links.near_duplicates(h.odd(spark)).collect()
    assert len(rows) == 10
    assert {r.component_id for r in rows if r.doc_id in (1, 2)} == {1}
    kept = simhash_links.one_of_each(h.odd(spark))
    assert kept.columns == h.odd(spark).columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 2 not in ids and None in ids
    assert simhash_links.near_duplicates(h.odd(spark).where(F.lit(False))).collect() == []
