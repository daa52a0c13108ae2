import hashlib
import random

import numpy as np

from lineglass.llm import fim
from tests.llm import helpers as h


def brute(doc_id, text):
    """The contract, read as plainly as possible."""
    t = text or ""
    n = len(t)
    if doc_id is None:
        return n, "plain", None, None, t
    s = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(s[8 * k : 8 * k + 8], 16) for k in range(4))
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, x = t[:lo], t[lo:hi], t[hi:]
    if not t or "<P>" in t or "<S>" in t or "<M>" in t or h3 % 100 >= 90:
        return n, "plain", None, None, t
    if h4 % 100 < 20:
        return n, "spm", lo, hi - lo, "<S>" + x + "<P>" + p + "<M>" + m
    return n, "psm", lo, hi - lo, "<P>" + p + "<S>" + x + "<M>" + m


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def texts():
    r = random.Random(3)
    alphabet = ["a", "b", " ", "\n", "é", "\U0001f600", "<", ">", "P", "S", "M", "́"]
    out = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(300)]
    return [*out, None, "", "<P> marked", "x<S>", "a<M", h.prose(9, 5000)]


def test_digests_equal_the_contract(spark):
    rows = texts()
    got = {r.doc_id: r for r in fim.digests(h.documents(spark, rows)).collect()}
    forms = set()
    for i, t in enumerate(rows):
        n, form, pc, mc, out = brute(i, t)
        r = got[i]
        forms.add(form)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, pc, mc), (i, t)
        assert r.output_sha256 == sha(out)
        assert r.restored_sha256 == sha(t or "")
    assert forms == {"plain", "psm", "spm"}


def test_skip_list_reaches_every_rank_with_wide_units():
    r = random.Random(1)
    for _ in range(200):
        widths = np.array([r.randint(1, 5) for _ in range(r.randint(0, 700))], np.int64)
        lanes = fim.SkipList(np.ones(len(widths), np.int64), widths)
        starts = np.concatenate([[0], np.cumsum(widths)])
        for rank in {0, len(widths), r.randint(0, len(widths)), r.randint(0, len(widths))}:
            assert lanes.offset(rank) == starts[rank]


def test_word_units_cut_between_words(spark):
    text = "alpha beta  gamma\tdelta " * 40
    docs = h.documents(spark, [text] * 30)
    for row in fim.transform(docs, unit=r"\S+").collect():
        assert row.fim_units == len(__import__("re").findall(r"\S+|\s", text))
        if row.fim_form == "plain":
            continue
        cuts = {row.fim_prefix_chars, row.fim_prefix_chars + row.fim_middle_chars}
        assert all(c in (0, len(text)) or not (text[c - 1].isalnum() and text[c].isalnum()) for c in cuts)


def test_odd_rows(spark):
    """Nulls, empty, long and repeated texts, and a clashing fim_form column."""
    odd = h.odd(spark)
    rows = fim.transform(odd.withColumn("fim_form", odd.doc_id)).collect()
    assert len(rows) == 10
    for r in rows:
        assert r.fim_units == len(r.text or "")
        if r.doc_id is None or not r.text:
            assert r.fim_form == "plain" and r.fim_prefix_chars is None and r.fim_text == (r.text or "")
    for r in fim.digests(odd).collect():
        assert r.restored_sha256 in {sha(t.text or "") for t in odd.collect()}
    assert fim.digests(h.documents(spark, [])).count() == 0
