import zlib

from lineglass.llm import sharding
from tests.llm import helpers as h


def placed(spark, texts):
    rows = sharding.sharded(h.documents(spark, texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values())
    return rows


def sizes(rows):
    out = [0] * sharding.SHARDS
    for r in rows:
        out[r.shard] += r.size
    return out


def test_equal_texts_stay_together_and_sizes_are_even(spark):
    texts = [h.prose(k % 300, 30 + k % 300 % 40) for k in range(700)]
    rows = placed(spark, texts)
    loads = sizes(rows)
    assert max(loads) <= 1.02 * sum(loads) / 8
    shards = {}
    for r in rows:
        shards.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert sum(len(s) > 1 for s in shards.values()) <= 0.05 * len(shards)


def test_a_third_of_all_rows_is_one_group(spark):
    texts = ["the same text again and again"] * 400 + [h.prose(k, 6) for k in range(800)]
    rows = placed(spark, texts)
    loads = sizes(rows)
    assert max(loads) <= 1.03 * sum(loads) / 8
    assert len({r.shard for r in rows if r.doc_id < 400}) <= 5


def test_flows_keep_every_limit():
    flow = sharding.granted([[0, 90, 10], [5, 0, 0], [80, 60, 0]], [100, 100, 100], 110)
    for j in range(3):
        assert [100, 100, 100][j] + sum(f[j] for f in flow) - sum(flow[j]) <= 110.02


def test_odd_rows(spark):
    rows = sharding.sharded(h.odd(spark)).collect()
    assert len(rows) == 10
    assert {r.size for r in rows if r.doc_id in (1, 2)} == {1}
    assert sharding.sharded(h.odd(spark).limit(0)).collect() == []
