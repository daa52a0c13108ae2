import zlib

import numpy as np
import pytest

from lineglass.llm import packing
from tests.llm import helpers as h

TEXTS = [
    "", " ", "  ", "a", " a", "a  b", "a \n b", "a\n b ", "it's  \t\tfine!!  ", "café naïve  x", " em  　wide",
    "1234 56,78 ... !!! $$$a", "<|endoftext|> a <|endoftext|>", "\U0001f600 \U0001f600\U0001f601", "\x1c \x1d a\x85 b", "x" * 5000, "\r\n \r\n a",
]


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    return made


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("text", [*TEXTS, *[h.prose(s, 60) for s in range(5)]])
def test_ids_are_those_of_the_tokenizer(tokenizer, text):
    got = np.frombuffer(packing.encoder().ids(text), dtype="<u4").tolist()
    assert [*got, 2] == ids_of(tokenizer, text)


def test_plan_is_gapless_and_near_the_bound():
    counts = {1024: 3, 1000: 2, 700: 9, 512: 5, 400: 20, 300: 31, 24: 7, 3: 100, 1: 11}
    bins = {}
    for length, start, end, first, each, at in packing.plan(counts):
        for rank in range(start, end):
            k = rank - start
            bins.setdefault(first + k // each, []).append((at + k % each * length, length))
    assert sum(map(len, bins.values())) == sum(counts.values())
    for slots in bins.values():
        end = 0
        for at, length in sorted(slots):
            assert at == end
            end += length
        assert end <= 1024
    assert len(bins) <= sum(length * n for length, n in counts.items()) / 1024 * 1.1 + 1


def check(rows, texts, tokenizer):
    """Pieces cover each document's ids, and sequences have no gaps."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, text in texts.items():
        ids = np.array(ids_of(tokenizer, text), dtype="<u4")
        at = 0
        for n, r in enumerate(sorted(by_doc.pop(doc), key=lambda r: r.piece)):
            assert (r.piece, r.start) == (n, at)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert r.length == 1024 or n == 0
            at += r.length
        assert at == len(ids)
    assert not by_doc
    for slots in by_sequence.values():
        end = 0
        for offset, length in sorted(slots):
            assert offset == end
            end += length
        assert end <= 1024


def test_pack_places_every_piece(spark, tokenizer):
    texts = dict(enumerate([h.prose(s, 20 + 37 * s % 900) for s in range(60)] + ["same short text"] * 30 + [None, ""]))
    rows = packing.pack(h.documents(spark, list(texts.values()))).collect()
    check(rows, texts, tokenizer)
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= total // 1024 + 2


def test_sequences_hold_the_ids(spark, tokenizer):
    docs = h.documents(spark, [h.prose(s, 300) for s in range(8)])
    placed = packing.place(packing.stored(packing.pieces(docs, with_ids=True), "pieces"))
    made = {r.sequence_id: r.ids for r in packing.sequences(placed).collect()}
    want = sorted(i for r in docs.collect() for i in ids_of(tokenizer, r.text))
    assert sorted(i for ids in made.values() for i in ids) == want


def test_odd_rows(spark):
    rows = packing.pack(h.odd(spark)).collect()
    assert sum(r.doc_id == 4 and r.piece == 0 for r in rows) == 3
    assert {r.length for r in rows if r.doc_id in (1, 2)} == {1}
    assert packing.pack(h.odd(spark).limit(0)).collect() == []


MARKED = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "<|endoftext| > y", "a  <|endoftext|>\n\n é <|endoftext|>"]


def test_added_tokens_are_found_as_the_tokenizer_as_loaded_does(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = dict(enumerate([*TEXTS, *MARKED, "<|endoftext|> " * 800]))
    for text in texts.values():
        assert np.frombuffer(packing.encoder().whole(text), dtype="<u4").tolist() == ids_of(loaded, text)[:-1]
    check(packing.pack(h.documents(spark, list(texts.values()))).collect(), texts, loaded)


def test_a_worker_keeps_one_vocabulary_and_no_chunks_after_its_task():
    own = packing.encoder()
    assert own.whole("one two  three") and own and own.spaced
    own.forget()
    assert not own and not own.spaced
    assert own.encode is own.spaced.encode
