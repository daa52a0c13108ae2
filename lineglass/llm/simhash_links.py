"""SimHash near-duplicates: pigeonring filtering of 64-bit fingerprints.

Two fingerprints that differ in at most three of eight bytes on a ring have a start from
which the first ``l`` consecutive bytes differ in at most ``3 * l / 8`` bits, for every
``l`` up to 8. So the first two bytes of such a chain are equal, and the three after them
hold one differing bit at most, so that two of those three are equal as well. That is a
join key of 32 bits: 8 starts times 3 choices. What shares a key is held against the
budgets of its chain before it counts as a link.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineglass.llm.common import hex64, stored
from lineglass.llm.components import components

SHINGLE = 3
SEED = 42
BITS = 3
BYTES = 8
# Bits that may differ in the first l bytes of a chain: 0 0 1 1 1 2 2 3.
BUDGETS = [BITS * length // BYTES for length in range(1, BYTES + 1)]
# Which two of the third, fourth and fifth byte of a chain are equal.
CHOICES = [(2, 3), (2, 4), (3, 4)]
# Shingles counted at once.
CHUNK = 1 << 15


def fingerprint(text: str | None) -> int:
    """The fingerprint of one text as an unsigned number; zero without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(SHINGLE, len(words))
    starts, ends = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    total = np.zeros(64, dtype=np.int64)
    of = xxhash.xxh64_intdigest
    for k in range(0, len(starts), CHUNK):
        part = zip(starts[k : k + CHUNK], ends[k : k + CHUNK])
        hashes = np.fromiter((of(joined[a:b], SEED) for a, b in part), dtype=np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int32)
    set_bits = (total * 2 > len(starts)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``fp``, the fingerprint's 64 bits as a signed long, for every row."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return source.mapInArrow(run, "doc_id long, fp long")


def _from(value: Column, start: int) -> Column:
    """The 64 bits turned so that the byte ``start`` of the ring comes lowest."""
    if not start:
        return value
    return F.shiftrightunsigned(value, 8 * start).bitwiseOR(F.shiftleft(value, 64 - 8 * start))


def _byte(value: Column, k: int) -> Column:
    return F.shiftrightunsigned(value, 8 * k).bitwiseAND(F.lit(255))


def _keys(fp: Column) -> Column:
    """The 24 join keys: 32 bits of the chain, and above them the start and the choice."""
    keys = []
    for start in range(BYTES):
        turned = _from(fp, start)
        for c, (x, y) in enumerate(CHOICES):
            low = turned.bitwiseAND(F.lit(0xFFFF))
            bits = low.bitwiseOR(F.shiftleft(_byte(turned, x), 16)).bitwiseOR(F.shiftleft(_byte(turned, y), 24))
            keys.append(bits.bitwiseOR(F.lit((start * len(CHOICES) + c) << 32)))
    return F.array(*keys)


def _chain_holds(differing: Column, start: Column) -> Column:
    """Whether the chain from ``start`` keeps every budget."""
    ring = F.shiftrightunsigned(differing, 0)
    cases = None
    for s in range(BYTES):
        turned = _from(ring, s)
        holds = F.lit(True)
        for length, budget in enumerate(BUDGETS, 1):
            if length < BYTES and BUDGETS[length] == budget:
                continue  # the longer chain has the same budget
            mask = (1 << (8 * length)) - 1 if length < BYTES else -1
            holds = holds & (F.bit_count(turned.bitwiseAND(F.lit(mask))) <= budget)
        cases = F.when(start == s, holds) if cases is None else cases.when(start == s, holds)
    return cases


def links(fps: DataFrame) -> DataFrame:
    """All pairs ``a < b`` of different fingerprints in ``fp`` with at most three differing bits.

    Works on distinct fingerprints, so copies never meet each other here.
    """
    keyed = fps.select("fp").distinct().select("fp", F.explode(_keys(F.col("fp"))).alias("key"))
    a, b = keyed.alias("a"), keyed.alias("b")
    start = F.floor(F.shiftright(F.col("a.key"), 32) / len(CHOICES)).cast("int")
    near = _chain_holds(F.col("a.fp").bitwiseXOR(F.col("b.fp")), start)
    # Spark takes the keys to be as few as the fingerprints; they must never be broadcast.
    met = a.join(b.hint("merge"), (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & near)
    return met.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` and ``component_id`` for every row.

    ``component_id`` is the least id that is reached over links, itself included. Null and
    empty texts have fingerprint zero and are linked like any other; repeated rows stay
    repeated; a null id is no component's least id, and a component of null ids alone has
    a null ``component_id``; an empty table gives no rows; other columns play no part.
    """
    fps = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes)).withColumnRenamed("node", "fp")
    rooted = classes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.join(lowest, "root").select("fp", "component_id")
    return fps.join(found, "fp").select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """Keep the rows with the least id of every near-duplicate group, with all their columns.

    Rows with one id go together: if any of them is in a group with a smaller id, all do.
    Rows that repeat the kept id stay as often as they come, and so do rows without an id,
    which can't be told apart.
    """
    groups = near_duplicates(docs)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    return kept.select(*docs.columns)
