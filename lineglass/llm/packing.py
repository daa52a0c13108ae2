"""Best-fit packing planned on a histogram of lengths.

The plan never sees a document: best-fit decreasing runs over how many pieces there are
of each length, and yields slots. Pieces then take the slots of their length by their
rank within it.
"""

import base64
import json
import re
import zlib
from bisect import insort
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineglass.llm.common import numbered, stored

CAPACITY = 1024
END_ID = 2
# The vocabulary of byte_bpe_50k.json as ranks.
VOCABULARY = "byte_bpe_50k.tiktoken"
# Chunks whose ids a task remembers at most, and rows that it cuts at a time.
REMEMBERED = 400_000
ROWS = 500
SLICES = 64

# A space that may belong to a longer run of white space.
RUN = re.compile(r" (?:\s|$)")

_ENCODERS: dict[str, "Chunks"] = {}


class Chunks(dict):
    """Ids of a text, remembered by chunk as little-endian 32-bit numbers.

    A space before a character that is no white space always begins a new word of the
    tokenizer, so a text can be cut there and its parts encoded on their own. A part is
    remembered without its space, by ``spaced``, a table of the same kind.
    """

    def __init__(self, path: str):
        super().__init__()
        self.before = ""
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding(
            "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
        # The same vocabulary, held once.
        self.spaced = Chunks.__new__(Chunks)
        self.spaced.before, self.spaced.encode = " ", self.encode
        # Tokens beside the merges, which stand for their text wherever it comes.
        made = Path(path).with_suffix(".json")
        found = json.loads(made.read_text("utf-8"))["added_tokens"] if made.exists() else []
        self.added = {t["content"]: np.array([t["id"]], dtype="<u4").tobytes() for t in found}
        longest = sorted(map(re.escape, self.added), key=len, reverse=True)
        self.marks = re.compile(f"({'|'.join(longest)})") if longest else None

    def __missing__(self, chunk: str) -> bytes:
        ids = np.array(self.encode(self.before + chunk), dtype="<u4").tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
        if len(chunk) < 64:
            self[chunk] = ids
        return ids

    def forget(self) -> None:
        """Give back the memory of what is remembered; a worker outlives its task."""
        self.clear()
        self.spaced.clear()

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = text.split(" ")
        if not first or RUN.search(text):
            # Runs of white space stay with what is before them.
            first, *rest = re.split(r" (?=\S)", text)
        return (self[first] if first else b"") + b"".join(map(self.spaced.__getitem__, rest))

    def whole(self, text: str) -> bytes:
        """The ids of a text with the vocabulary's added tokens, as ``tokenizers`` finds them."""
        if not any(map(text.__contains__, self.added)):
            return self.ids(text)
        return b"".join(self.added[t] if n % 2 else self.ids(t) for n, t in enumerate(self.marks.split(text)))


def encoder(vocabulary: str = VOCABULARY) -> Chunks:
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Chunks(public_tokenizers.path(vocabulary))
    return _ENCODERS[vocabulary]


def pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    vocabulary: str = VOCABULARY,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """Tokenize whole texts, end each with ``end_id`` and cut the longer ones.

    A row for each piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.
    The first piece takes what is left over, all others are full. A null text is empty.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if with_ids:
        schema, names = schema + ", ids array<int>", [*names, "ids"]

    def cut(text: str | None) -> list[tuple[int, bytes]]:
        ids = encoder(vocabulary).whole(text or "") + np.array([end_id], dtype="<u4").tobytes()
        head = len(ids) // 4 % capacity or capacity
        bounds = [0, *range(head * 4, len(ids) + 1, capacity * 4)]
        return [(a // 4, ids[a:b]) for a, b in zip(bounds, bounds[1:])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            rows = [
                (doc.as_py(), n, start, len(ids) // 4, zlib.crc32(ids), ids)
                for doc, text in zip(batch.column(0), batch.column(1))
                for n, (start, ids) in enumerate(cut(text.as_py()))
            ]
            doc, n, start, length, crc, ids = zip(*rows) if rows else [()] * 6
            columns = [
                pa.array(doc, pa.int64()), pa.array(n, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
            ]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x, dtype="<i4") for x in ids], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=names)
        encoder(vocabulary).forget()

    return source.mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    ``counts`` says how many pieces there are of each length. The rows of the plan are
    (length, first rank, end rank, first bin, pieces a bin, offset): pieces with a rank in
    that range fill consecutive bins from ``first bin``, so many a bin, from ``offset``.
    Bins that were filled alike are kept as one run, so the plan's size depends on the
    number of lengths and not on the number of pieces.
    """
    open_bins: list[tuple[int, int, int]] = []  # (room, first bin, bins), by room
    bins, rows = 0, []
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = next((k for k, (room, _, _) in enumerate(open_bins) if room >= length), None)
            if at is None:
                each = capacity // length
                new = -(-left // each)
                room, first, n = capacity, bins, new
                bins += new
            else:
                room, first, n = open_bins.pop(at)
                each = room // length
            full = min(n, left // each)
            if full:
                rows.append((length, rank, rank + full * each, first, each, capacity - room))
                rank, left = rank + full * each, left - full * each
                if room - each * length:
                    insort(open_bins, (room - each * length, first, full))
                first, n = first + full, n - full
            if n and left and left < each:  # the last ones do not fill a bin's share
                rows.append((length, rank, rank + left, first, left, capacity - room))
                if room - left * length:
                    insort(open_bins, (room - left * length, first, 1))
                rank, first, n, left = rank + left, first + 1, n - 1, 0
            if n:
                insort(open_bins, (room, first, n))
    return rows


PLAN = "length long, from_rank long, to_rank long, bin long, each long, at long"


def place(cut: DataFrame, capacity: int = CAPACITY, slices: int = SLICES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces.

    The driver sees one count for each length, ``capacity`` rows at most. A length that
    holds a third of all pieces is ranked in slices.
    """
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = spark.createDataFrame(plan(counts, capacity), PLAN)
    ranked = numbered(cut, ["length"], ["doc_id", "piece", "ids_crc32"], "_place", slices)
    met = ranked.join(F.broadcast(slots), (ranked.length == slots.length) & F.expr("_place >= from_rank AND _place < to_rank"))
    nth = F.col("_place") - F.col("from_rank")
    return met.select(
        *[ranked[c] for c in cut.columns],
        (F.col("bin") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + nth % F.col("each") * ranked.length).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, **more) -> DataFrame:
    """Every piece of every row with its place in a sequence of at most ``capacity`` ids.

    Null and empty texts are the end id alone. Repeated rows are packed as often as they
    come; a null id is carried; an empty table gives no rows; other columns play no part.
    """
    return place(stored(pieces(docs, id_col, text_col, capacity, **more), "pieces"), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces that were cut with their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
