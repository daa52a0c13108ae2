from lineglass.llm import decontamination as d
from tests.llm import helpers as h

ITEMS = [(k, h.prose(500 + k, 12 + 6 * k) + ". " + h.prose(600 + k, 8)) for k in range(20)]


def corpus():
    clean = [h.prose(s, 100 + s) for s in range(20)]
    leaky = [h.prose(700 + k, 90) + "\n" + text.upper() + " " + h.prose(800 + k, 40 + k) for k, text in ITEMS]
    return clean, leaky


def brute(texts):
    """Pairs whose five-word shingles are held to four fifths or more, over all texts and items."""
    pairs = set()
    for i, text in enumerate(texts):
        there = set(d.shingles(d.words(text)))
        for k, item in ITEMS:
            own = set(d.shingles(d.words(item)))
            if len(own & there) >= d.OVERLAP * len(own):
                pairs.add((i, k))
    return pairs


def test_leaks_equal_brute_force(spark):
    clean, leaky = corpus()
    cut = [t.replace(ITEMS[k][1].upper(), " ".join(ITEMS[k][1].split()[:-2])) for k, t in enumerate(leaky)]
    halved = [" ".join(ITEMS[k][1].split()[: len(ITEMS[k][1].split()) // 2]) + " " + clean[k] for k in range(20)]
    texts = [*clean, *leaky, *cut, *halved]
    rows = d.leaked(h.documents(spark, texts), h.benchmark(spark, ITEMS)).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == brute(texts)
    assert all(r.question == r.answer == 1 for r in rows if 20 <= r.doc_id < 40)


def test_a_second_index_finds_the_same(spark):
    _, leaky = corpus()
    assert len(d.indexes(h.benchmark(spark, ITEMS), limit=100)) > 1
    docs, items = h.documents(spark, leaky), h.benchmark(spark, ITEMS)
    parts = [d.Index([x]) for x in ITEMS]
    for k, text in enumerate(leaky):
        assert [r[0] for r in parts[k].search(text)] == [k]
    assert d.clean(docs, items).collect() == []


def test_pruning_loses_no_score_above_the_threshold():
    import numpy as np

    index = d.Index(ITEMS)
    for text in (*corpus()[0], *corpus()[1]):
        ids = np.array([index.ids.get(w, -1) for w in d.words(text)])
        windows = max(1, -(-(len(ids) - d.WINDOW) // d.STRIDE) + 1)
        full = {w for w in range(windows) if index.scores(ids[w * d.STRIDE : w * d.STRIDE + d.WINDOW])}
        assert full <= set(index.candidates(ids))


def test_clean_keeps_rows_as_they_are(spark):
    clean, leaky = corpus()
    docs = h.documents(spark, [*clean, *leaky])
    kept = d.clean(docs, h.benchmark(spark, ITEMS))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(len(clean)))


def test_odd_rows(spark):
    items = h.benchmark(spark, [*ITEMS, (None, "x"), (50, None), (51, ""), (52, "..."), ITEMS[0]])
    assert d.leaked(h.odd(spark), items).collect() == []
    assert len(d.clean(h.odd(spark), items).collect()) == 10
    assert d.leaked(h.odd(spark).limit(0), items).collect() == []
    assert len(d.clean(h.odd(spark), items.limit(0)).collect()) == 10
