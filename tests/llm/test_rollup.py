import re
from collections import Counter

from pyspark.sql import functions as F

from lineglass.llm import packing, token_rollup
from lineglass.llm.packing import encoder
from tests.llm import helpers as h

CHANGES = "source string, lang string, tokenizer string, sign int, tokens long, bytes long"


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.documents, r.tokens, r.bytes) for r in rollup.totals().collect()}


def test_batches_count_once_and_cancel(spark, tmp_path):
    rollup = token_rollup.Rollup.create(spark, str(tmp_path / "r"))
    assert totals(rollup) == {}
    first = spark.createDataFrame([("a", "en", "v1", 1, 10, 40), ("a", "en", "v1", 1, 5, 20), (None, None, "v1", 1, 7, 9)], CHANGES)
    assert rollup.commit("one/é", first)
    assert not rollup.commit("one/é", first)
    want = {("a", "en", "v1"): (2, 15, 60), (None, None, "v1"): (1, 7, 9)}
    assert totals(rollup) == want
    # A batch that broke off before its commit is written again.
    first.write.parquet(f"{rollup.path}/batches/two.")
    assert totals(rollup) == want
    revised = spark.createDataFrame([("a", "en", "v1", -1, 10, 40), ("a", "en", "v1", 1, 8, 30), (None, None, "v1", -1, 7, 9), ("b", "de", "v1", None, 3, 3)], CHANGES)
    assert rollup.commit("two", revised)
    want = {("a", "en", "v1"): (2, 13, 50)}
    assert totals(rollup) == want
    rollup.compact("base")
    rollup.compact("base")
    assert totals(rollup) == want
    assert not rollup.commit("two", revised)
    assert totals(token_rollup.Rollup.create(spark, rollup.path)) == want


def test_maintained_totals_equal_a_count_from_scratch(spark):
    texts = [h.prose(k % 9, 40) + "  \n x" * (k % 2) for k in range(30)] + [None, ""]
    kept, want = {}, Counter()
    for k, t in enumerate(texts):
        if (t or "") not in kept or f"src{k % 3}" < kept[t or ""]:
            kept[t or ""] = f"src{k % 3}"
    for t, source in kept.items():
        squeezed = re.sub(r"\s+", " ", t)
        for version in token_rollup.VERSIONS:
            want[source, "en", version, "documents"] += 1
            want[source, "en", version, "tokens"] += len(encoder(version).ids(squeezed)) // 4
            want[source, "en", version, "bytes"] += len(squeezed.encode())
    got = {}
    for r in token_rollup.maintained(h.documents(spark, texts)).collect():
        for name in ("documents", "tokens", "bytes"):
            got[r.source, r.lang, r.tokenizer, name] = r[name]
    assert got == want


def test_odd_rows(spark):
    rows = token_rollup.maintained(h.odd(spark)).collect()
    assert sum(r.documents for r in rows) == 2 * 8
    assert token_rollup.maintained(h.odd(spark).limit(0)).collect() == []


def test_added_tokens_count_as_one(spark):
    row = h.documents(spark, ["a <|endoftext|> b"]).select(token_rollup.tokens(F.col("text"), "byte_bpe_50k.tiktoken").alias("n")).first()
    assert row.n == 4


def test_words_of_a_revision_are_not_encoded_again(spark, monkeypatch):
    """A corpus has more words than are remembered; those of a text still are when its revision is counted."""
    texts = [h.prose(k, 60) + "  \n x" for k in range(40)]
    first, second = token_rollup.VERSIONS
    own, calls = encoder(first), []
    own.forget()
    encode = own.encode
    monkeypatch.setattr(packing, "REMEMBERED", 600)
    for part in (own, own.spaced):
        monkeypatch.setattr(part, "encode", lambda chunk: calls.append(chunk) or encode(chunk))
    for t in texts:
        own.whole(t)
    once = len(calls)
    own.forget()
    calls.clear()
    for t in texts:
        token_rollup._revised_counts(t, re.sub(r"\s+", " ", t), first, second)
    assert once <= len(calls) < 1.3 * once
    columns = token_rollup.revised_tokens(F.col("text"), token_rollup.revised(F.col("text")), first, second)
    rows = h.documents(spark, ["a  b \n c", "a b c", "", None]).select(columns.alias("n")).collect()
    assert [tuple(r.n) for r in rows] == [token_rollup._revised_counts(t, re.sub(r"\s+", " ", t), first, second) for t in ("a  b \n c", "a b c", "", "")]
