import pyarrow as pa

from lineglass.llm import toxicity
from tests.llm import helpers as h


def found(text, learned=None):
    return [(text.lower()[a:b], name) for a, b, name in toxicity.Lexicon(learned or {}).matched(text)]


def test_patterns_depend_on_the_clause():
    assert found("You are an idiot.") == [("idiot", "insult_at")]
    assert found("What an Idiot!! here") == [("idiot", "insult")]
    assert found("You are not an idiot, see") == [("idiot", "negated")]
    assert found("He said you are an idiot.") == [("idiot", "reported")]
    assert found("He said so. An idiot") == [("idiot", "insult")]
    assert found("I will kill you") == [("kill", "threat")]
    assert found("they would kill") == [("kill", "threat_at")]
    assert found("idiotix xidiot kidiotk") == []
    assert found("Grumblefex is here", {"grumb": "L"}) == [("grumblefex", "learned")]
    assert found("") == [] == found("nothing here")
    assert toxicity.Lexicon({}).matched(None) == []


def test_whole_text_is_read():
    assert len(found(h.prose(3, 20_000) + ". you moron")) == 1


def corpus():
    texts, rows = [], []
    for k in range(240):
        words = h.prose(k, 60).split()
        bad = k % 4 == 0
        if bad:
            words[k % 50] = ["idiot", "zzqufab", "zzqumor"][k // 4 % 3]
            words[(k + 7) % 50] = "zzqulin"
        texts.append(" ".join(words))
        rows.append((k, 1, int(bad)))
    return texts, rows


def test_scores_find_labels_that_were_held_out(spark):
    texts, rows = corpus()
    got = toxicity.scored(h.documents(spark, texts), h.labels(spark, rows)).collect()
    import zlib

    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.predicted == int(r.score >= 0.3) == rows[r.doc_id][2]
    assert any(r.held_out and r.predicted for r in got)


def test_held_out_labels_are_not_learned_from(spark):
    texts, rows = corpus()
    import zlib

    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in rows]
    docs = h.documents(spark, texts)
    a, b = (
        {r.doc_id: r.score for r in toxicity.scored(docs, h.labels(spark, some)).collect()} for some in (rows, turned)
    )
    assert a == b


def test_accepted_keeps_clean_rows_as_they_are(spark):
    texts, rows = corpus()
    docs = h.documents(spark, texts)
    kept = toxicity.accepted(docs, h.labels(spark, rows))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _, t in rows if not t}


def test_odd_rows(spark):
    odd_labels = h.labels(spark, [(1, 0, 1), (2, None, None), (None, 1, 1), (4, 1, 0), (4, 1, 1), (99, 0, 1)])
    got = toxicity.scored(h.odd(spark), odd_labels).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.scored(h.odd(spark).limit(0), odd_labels).collect() == []
    assert len(toxicity.scored(h.odd(spark), odd_labels.limit(0)).collect()) == 10


def test_beginnings_leave_a_task_by_the_part(monkeypatch):
    """A batch of many texts is handed on in parts, so that its rows are never held at once."""
    monkeypatch.setattr(toxicity, "HELD", 500)
    texts = [h.prose(k, 60) for k in range(40)] + [None, "", "abcde abcde"]
    labels = [k % 2 for k in range(len(texts))]
    batch = pa.RecordBatch.from_pydict({"label": pa.array(labels, pa.int32()), "text": pa.array(texts, pa.string())})
    parts = list(toxicity._begun(iter([batch, batch.slice(0, 0)])))
    own = [sum(p.num_rows for p in toxicity._begun(iter([batch.slice(k, 1)]))) for k in range(len(texts))]
    assert len(parts) > 5
    assert max(p.num_rows for p in parts) < 500 + max(own)
    assert sum(p.num_rows for p in parts) == sum(own)
    last = [p for p in toxicity._begun(iter([batch.slice(42, 1)]))][0].to_pylist()
    assert sorted((r["label"], r["beginning"], r["context"]) for r in last) == [(0, "abcd", -1), (0, "abcde", -1)]
