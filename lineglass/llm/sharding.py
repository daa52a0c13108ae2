"""Sharding by balanced label propagation.

Rows with the same link value hang on one hub and are dealt into at most 64 cells of it; a
cell, a single row mostly, is what moves. In each round every hub counts its cells' rows by
shard, and cells want to where most of their hub is. Wishes are granted best gain first,
as far as the linked rows of a shard stay within its share. After each round shards above
their share give away unlinked cells and whole small hubs until sizes are near equal.

The driver sees sums by shard and bucket, a fixed number of rows whatever the corpus.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineglass.llm.common import numbered, stored

SHARDS = 8
CELLS = 64
ROUNDS = 6
# Flows may miss a limit by this share of it.
NEAR = 1e-4
# How far linked rows may exceed a shard's share while labels spread, and the share of it
# from which large hubs look for another shard.
SPARE, FULL = 0.05, 0.85
BUCKETS = 1024
BALANCING = 6
# Sizes within this share of each other are even; a hub above SMALL of a share moves by
# cells, and only for more than COARSE.
EVEN, SMALL, COARSE = 0.0005, 0.002, 0.005
SLICES = 1024

HUB = ["hub", "hub_check"]


def _pick(numbers: list, index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, numbers)), (index + 1).cast("int"))


def _loads(cells: DataFrame, shards: int, counted: Column | bool = True) -> list[int]:
    sums = cells.where(F.lit(True) if counted is True else counted).groupBy("shard").agg(F.sum("bytes").alias("b"))
    found = {r["shard"]: r["b"] for r in sums.collect()}
    return [int(found.get(s, 0)) for s in range(shards)]


def _large(share: float) -> Column:
    """Cells of a hub that may be more than a shard should take at once."""
    return F.col("linked") & (F.col("hub_rows") > CELLS) & (F.col("hub_bytes") > SMALL * share)


def granted(wishes: list[list[int]], loads: list[int], limit: float) -> list[list[float]]:
    """How much of the wishes from shard to shard keeps every shard within its limit.

    What comes into a shard above the limit is cut in proportion until none is, counting
    what leaves it; cutting never adds, so this ends.
    """
    n = len(loads)
    flow = [[float(x) for x in row] for row in wishes]
    for _ in range(2000):
        over = False
        for j in range(n):
            arriving = sum(flow[i][j] for i in range(n))
            after = loads[j] + arriving - sum(flow[j])
            if arriving and after > limit * (1 + NEAR):
                keep = max(0.0, arriving - (after - limit)) / arriving
                for i in range(n):
                    flow[i][j] *= keep
                over = True
        if not over:
            break
    else:
        flow = [[0.0] * n for _ in range(n)]
    return flow


def _propagate(cells: DataFrame, shards: int, share: float, turn: int) -> DataFrame | None:
    """One round: cells move to the shard of most of their hub's rows, as far as there is room.

    None when no cell wants to move or none may.
    """
    large = _large(share)
    loads, heavy = _loads(cells, shards, F.col("linked")), _loads(cells, shards, F.col("linked") & large)
    limit = share * (1 + SPARE)
    small_open = [load < share * (1 + SPARE / 2) for load in loads]
    large_open = [load < share * FULL for load in heavy]
    sums = [F.sum(F.when(F.col("shard") == s, F.col("rows")).otherwise(0)) for s in range(shards)]
    hubs = cells.where("linked").groupBy(*HUB).agg(F.array(*sums).alias("here"))
    joined = cells.join(hubs, HUB, "left")
    mine = F.element_at("here", F.col("shard") + 1)
    # Full shards attract nobody; equal ones stand in an order of the hub's own, so that ties
    # do not all drift one way.
    drawn = F.array(
        *[
            F.struct(
                F.when(
                    F.when(large, F.lit(large_open[s])).otherwise(F.lit(small_open[s])) | (F.col("shard") == s), F.col("here")[s]
                ).otherwise(F.lit(-1)).alias("rows"),
                F.xxhash64(*HUB, F.lit(s)).alias("tie"),
                F.lit(s).alias("shard"),
            )
            for s in range(shards)
        ]
    )
    best = F.array_max(drawn)
    wish = best["shard"]
    gain = best["rows"] - mine
    better = F.col("linked") & (wish != F.col("shard"))
    level = F.lit(15) - F.least(F.lit(15), F.floor(F.log2(gain + 1)))
    bucket = level * (BUCKETS // 16) + F.pmod(F.xxhash64(*HUB, "cell", F.lit(turn)), F.lit(BUCKETS // 16))
    wishes = joined.withColumns({"wish": F.when(better, wish), "bucket": F.when(better, bucket.cast("int"))})
    sums = (
        wishes.where("wish IS NOT NULL").groupBy("shard", "wish", "bucket").agg(F.sum("bytes").alias("b")).collect()
    )
    wanted = [[0] * shards for _ in range(shards)]
    parts: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r in sums:
        wanted[r["shard"]][r["wish"]] += r["b"]
        parts.setdefault((r["shard"], r["wish"]), []).append((r["bucket"], r["b"]))
    flow = granted(wanted, loads, limit)
    up_to = [0] * (shards * shards)
    for (i, j), own in parts.items():
        moved = 0
        for b, size in sorted(own):
            moved += size
            if moved > flow[i][j] * (1 + 1e-9):
                break
            up_to[i * shards + j] = b + 1
    if not any(up_to):
        return None
    goes = F.col("bucket") < _pick(up_to, F.col("shard") * shards + F.col("wish"))
    return wishes.withColumn("shard", F.when(F.coalesce(goes, F.lit(False)), F.col("wish")).otherwise(F.col("shard"))).select(*cells.columns)


def _even(cells: DataFrame, shards: int, loads: list[int], turn: int) -> DataFrame | None:
    """One round of evening out; None when nothing fits any more."""
    share = sum(loads) / shards
    excess = [load - share for load in loads]
    if max(excess) - min(excess) <= EVEN * share:
        return None
    # So many of a shard's cells are looked at that its buckets are small against its excess.
    looked = [min(1.0, 4 * max(e, 0) / load) if load else 0.0 for e, load in zip(excess, loads)]
    large = _large(share)
    together = F.when(F.col("linked") & ~large, F.lit(-1)).otherwise(F.col("cell"))
    chance = F.pmod(F.xxhash64(*HUB, together, F.lit(turn)), F.lit(1 << 40)) / float(1 << 40)
    bucket = large.cast("int") * BUCKETS + F.pmod(F.xxhash64(*HUB, together, F.lit(-1 - turn)), F.lit(BUCKETS)).cast("int")
    looked_at = chance < _pick(looked, F.col("shard"))
    marked = cells.withColumn("bucket", F.when(looked_at, bucket))
    sums = marked.where("bucket IS NOT NULL").groupBy("shard", "bucket").agg(F.sum("bytes").alias("b")).collect()
    moves = []
    for r in sorted(sums, key=lambda r: (r["bucket"] // BUCKETS, -r["b"], r["shard"], r["bucket"])):
        if r["bucket"] >= BUCKETS and excess[r["shard"]] <= COARSE * share:
            continue
        to = min(range(shards), key=lambda s: excess[s])
        if r["b"] <= excess[r["shard"]] and r["b"] <= -excess[to] or r["b"] < (excess[r["shard"]] - excess[to]) / 2:
            moves.append((r["shard"], r["bucket"], to))
            excess[r["shard"]] -= r["b"]
            excess[to] += r["b"]
    if not moves:
        return None
    table = cells.sparkSession.createDataFrame(moves, "shard int, bucket int, to int")
    met = marked.join(F.broadcast(table), ["shard", "bucket"], "left")  # shards * 2 * BUCKETS rows at most
    return met.withColumn("shard", F.coalesce("to", "shard")).select(*cells.columns)


def sharded(
    docs: DataFrame,
    shards: int = SHARDS,
    rounds: int = ROUNDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    link_col: str | None = None,
    slices: int = SLICES,
) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard`` and ``slot`` for every row.

    ``link_col`` links rows of equal value, the text if not given. A size is the text's
    UTF-8 bytes and one; a null text is empty and linked with empty ones. A linked group
    lies in one shard unless capacity divides it. Repeated rows are rows of their own; null
    ids are dealt like others; an empty table gives no rows; other columns play no part.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    link = text if link_col is None else F.coalesce(F.col(link_col).cast("string"), F.lit(""))
    rows = stored(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(link).alias("hub"),
            F.crc32(link.cast("binary")).alias("hub_check"),
            F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(CELLS)).cast("int").alias("cell"),
        ),
        "rows",
    )
    cells = rows.groupBy(*HUB, "cell").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))
    hubs = cells.groupBy(*HUB).agg(F.sum("rows").alias("hub_rows"), F.sum("bytes").alias("hub_bytes"))
    cells = cells.join(hubs, HUB).withColumn("linked", F.col("hub_rows") > 1).withColumn("shard", F.pmod(F.xxhash64(*HUB, "cell"), F.lit(shards)).cast("int"))
    cells = stored(cells, "cells")
    share = sum(_loads(cells, shards)) / shards
    # Evening out between the rounds gives shards room again that long texts have filled.
    for turn in range(rounds + BALANCING):
        spread = _propagate(cells, shards, share, turn) if turn < rounds else None
        if spread is not None:
            cells = stored(spread, "cells")
        evened = _even(cells, shards, _loads(cells, shards), turn)
        if evened is not None:
            cells = stored(evened, "cells")
        elif spread is None:
            break
    placed = rows.join(cells.select(*HUB, "cell", "shard"), [*HUB, "cell"])
    return numbered(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot", slices).select(
        "doc_id", "size", "text_crc32", "shard", "slot"
    )
