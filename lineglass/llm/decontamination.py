"""Benchmark decontamination: BM25 over an inverted index of test items with block-max pruning.

Test items are cut into parts of at most 32 words, the parts are the index. Every window of
64 words of every training text is a query. A posting's impact is divided by the score of
its part as a query for itself, so one threshold serves all parts. Parts lie in blocks; a
window and a block whose bounds, the greatest impact of each term there, stay below the
threshold can't hold a result and are skipped. What is left is scored in full, and what
passes is verified by five-word shingles of question and answer.
"""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
PART = 32
WINDOW, STRIDE = 64, 32
BLOCK = 4
# A text that holds four fifths of an item's shingles has more than this of a part's score.
THRESHOLD = 0.6
# Share of the threshold that terms in many blocks may have together.
SLACK = 0.2
SHINGLE = 5
OVERLAP = 0.8
# Words of test items in one index; more items are searched in several rounds.
INDEX_WORDS = 2_000_000
# Bounds held at once while a text is read.
CELLS = 1 << 21

WORD = re.compile(r"\w+")
SENTENCE_END = re.compile(r"[.!?]\s+(?=\S)|\n+(?=\S)")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingles(of: list[str]) -> list[str]:
    """Five-word shingles; the whole of a shorter text."""
    if len(of) < SHINGLE:
        return [" ".join(of)] if of else []
    return [" ".join(of[k : k + SHINGLE]) for k in range(len(of) - SHINGLE + 1)]


def halves(text: str) -> tuple[str, str]:
    """Question and answer: an item's last sentence or line is the answer, if it has several."""
    ends = [m.end() for m in SENTENCE_END.finditer(text)]
    return (text[: ends[-1]], text[ends[-1] :]) if ends else (text, "")


class Index:
    """The inverted index of some test items; made on the driver, sent to the tasks."""

    def __init__(self, items: list[tuple[int, str]]):
        kept = [(i, t, w) for i, t in items if (w := words(t))]
        self.items = [i for i, _, _ in kept]
        self.checks = []
        parts: list[tuple[int, list[str]]] = []
        for k, (_, text, w) in enumerate(kept):
            question, answer = halves(text)
            self.checks.append((frozenset(shingles(w)), frozenset(shingles(words(question))), frozenset(shingles(words(answer)))))
            n = -(-len(w) // PART)
            parts += [(k, w[len(w) * j // n : len(w) * (j + 1) // n]) for j in range(n)]
        self.part_item = [k for k, _ in parts]
        n = len(parts)
        held = Counter(t for _, w in parts for t in set(w))
        self.ids = {t: k for k, t in enumerate(held)}
        idf = {t: math.log(1 + (n - c + 0.5) / (c + 0.5)) for t, c in held.items()}
        mean = sum(len(w) for _, w in parts) / n if n else 1
        postings = defaultdict(list)
        for p, (_, w) in enumerate(parts):
            times = Counter(w)
            raw = {t: idf[t] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(w) / mean)) for t, c in times.items()}
            whole = sum(raw.values())
            for t, x in raw.items():
                postings[self.ids[t]].append((p, x / whole))
        self.blocks = -(-n // BLOCK)
        every = [postings[t] for t in range(len(self.ids))]
        self.posting = np.cumsum([0, *map(len, every)])
        self.part = np.array([p for row in every for p, _ in row], dtype=np.int64)
        self.impact = np.array([x for row in every for _, x in row])
        highest: dict[int, dict[int, float]] = {}
        for t, rows in postings.items():
            most: dict[int, float] = {}
            for p, x in rows:
                most[p // BLOCK] = max(most.get(p // BLOCK, 0), x)
            highest[t] = most
        # Terms in many blocks are not looked up: all that they could add is part of every bound.
        self.slack = np.zeros(max(self.blocks, 1))
        common = set()
        for t in sorted(highest, key=lambda t: -len(highest[t])):
            more = self.slack.copy()
            for b, x in highest[t].items():
                more[b] += x
            if more.max() > THRESHOLD * SLACK:
                break
            self.slack, common = more, common | {t}
        rare = [sorted(highest[t].items()) if t not in common else [] for t in range(len(self.ids))]
        self.first = np.cumsum([0, *map(len, rare)])
        self.block = np.array([b for row in rare for b, _ in row], dtype=np.int64)
        self.bound = np.array([x for row in rare for _, x in row])

    @staticmethod
    def _rows(first: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the lists of some terms lie, one after the other, and how long each is."""
        n = first[ids + 1] - first[ids]
        return np.repeat(first[ids] - np.cumsum(n) + n, n) + np.arange(n.sum()), n

    def candidates(self, ids: np.ndarray) -> list[int]:
        """Windows that have a block whose bound reaches the threshold."""
        windows = max(1, -(-(len(ids) - WINDOW) // STRIDE) + 1)
        at = np.flatnonzero(ids >= 0)
        found = []
        each = max(1, CELLS // self.blocks)
        for low in range(0, windows, each):
            high = min(low + each, windows)
            p = at[slice(*np.searchsorted(at, [low * STRIDE, (high - 1) * STRIDE + WINDOW]))]
            offset, n = self._rows(self.first, ids[p])
            bound = self.bound[offset]
            # A word lies in two windows; one spare row at each end takes what is outside.
            cell = (np.repeat(p // STRIDE - low + 1, n) * self.blocks) + self.block[offset]
            size = (high - low + 2) * self.blocks
            once = np.bincount(cell, bound, size)
            total = (once[self.blocks : -self.blocks] + once[2 * self.blocks :]).reshape(-1, self.blocks)
            found += (np.flatnonzero((total + self.slack).max(axis=1) >= THRESHOLD) + low).tolist()
        return found

    def scores(self, ids: np.ndarray) -> list[tuple[int, float]]:
        """Parts with a score above the threshold for one window, each term counted once."""
        terms = np.unique(ids)
        offset, _ = self._rows(self.posting, terms[terms >= 0])
        parts, place = np.unique(self.part[offset], return_inverse=True)
        total = np.bincount(place, self.impact[offset], len(parts))
        return [(int(parts[k]), float(total[k])) for k in np.flatnonzero(total >= THRESHOLD)]

    def search(self, text: str | None) -> list[tuple[int, float, float, float, float]]:
        """Verified items of a whole text: item, best score, overlap of all, question and answer."""
        w = words(text)
        if not w or not self.blocks:
            return []
        get = self.ids.get
        ids = np.array([get(x, -1) for x in w], dtype=np.int64)
        best: dict[int, float] = {}
        passages: dict[int, set[int]] = defaultdict(set)
        for window in self.candidates(ids):
            for p, x in self.scores(ids[window * STRIDE : window * STRIDE + WINDOW]):
                item = self.part_item[p]
                best[item] = max(best.get(item, 0), x)
                passages[item].add(window)
        rows = []
        for item, x in best.items():
            near = [w[max(0, k * STRIDE - SHINGLE) : k * STRIDE + WINDOW + SHINGLE] for k in passages[item]]
            there = {s for own in near for s in shingles(own)}
            # What has less than five words is looked for as a whole.
            short = [f" {' '.join(own)} " for own in near]
            every, question, answer = (
                sum(g in there or g.count(" ") < SHINGLE - 1 and any(f" {g} " in t for t in short) for g in s) / len(s) if s else 0.0
                for s in self.checks[item]
            )
            if every >= OVERLAP:
                rows.append((self.items[item], x, every, question, answer))
        return rows


FOUND = "array<struct<item_id:bigint,score:double,overlap:double,question:double,answer:double>>"
_NAMES = ["item_id", "score", "overlap", "question", "answer"]
_FOUND = pa.list_(pa.struct([(n, pa.int64() if n == "item_id" else pa.float64()) for n in _NAMES]))


def indexes(benchmark: DataFrame, limit: int = INDEX_WORDS) -> list[Index]:
    """One index for every ``limit`` words of test items or so, so that none outgrows a task.

    Statistics of terms are those of the index's own items. Repeated items are kept once
    and items without words or id left out.
    """
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), "text").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    rounds = int(chars // (limit * 6)) + 1
    made = []
    for k in range(rounds):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == k)
        made.append(Index(sorted((r["item_id"], r["text"]) for r in own.collect())))
    return made


def leaks(text: Column, index: Index, spark) -> Column:
    """The verified test items of one index in a text, as an array."""
    sent = spark.sparkContext.broadcast(index)

    @F.arrow_udf(FOUND)
    def run(texts: pa.Array) -> pa.Array:
        own = sent.value
        return pa.array([[dict(zip(_NAMES, row)) for row in own.search(t.as_py())] for t in texts], _FOUND)

    return run(text)


def leaked(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document and test item that it holds, with score and overlaps.

    Whole texts are searched and no text is shuffled. Null and empty texts, and an empty
    benchmark, give no rows; repeated rows give their items once; a null id is carried;
    other columns play no part.
    """
    found = None
    for index in indexes(benchmark):
        here = docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.inline(leaks(F.col(text_col), index, docs.sparkSession)),
        )
        found = here if found is None else found.unionByName(here)
    return found.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in _NAMES[1:]])


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows without a verified test item, as they are; no shuffle."""
    kept = docs
    for index in indexes(benchmark):
        kept = kept.where(F.size(leaks(F.col("text"), index, docs.sparkSession)) == 0)
    return kept
