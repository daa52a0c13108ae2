"""Similarity join of word-shingle sets by Jaccard, exact, by the pigeonhole on rare shingles.

A document's set is its distinct shingles of ``width`` words (A-Z lower-cased, words are
runs of characters other than space and tab to carriage return); with fewer words the
whole sequence is one shingle, without words the set is empty and linked with nothing.
Two sets link when ``100 * |r & s| >= percent * |r | s|``. The result gives every row its
set size, the least doc_id of its component and the number of other sets it links with.

Method. Equal sets are one node, named by the set's signature, so copies are never paired.
Linked sets share at least ``ceil(percent * n / 100)`` shingles of either, so by pigeonhole
any ``n - that + 1`` shingles of one hold a shingle of the other; taken first in one order
of all shingles, those of both sets share one. Only these are keys, a fifth of the set at 80
percent. Any order is exact; hashes are the order, but shingles that fall in a slot with one
that a sample of about ``SAMPLE`` shingles shows often (``FREQUENT`` at most, a constant of
``SLOTS`` bytes) come last, so that a passage of many documents is no key.

Links are met in three steps and always verified exactly on the 64-bit shingle hashes.
First every node is tied to the least node of each of its keys, if they share enough of them
(a star). What this ties together is a family: near copies, linked or not. All sets of a
family that has more than two are compared: they are dealt by size band (whose ends grow by
``100 / percent``, so that linked sets are at most one band apart) into blocks of about
``BLOCK`` shingles, a task compares two blocks, and only links that tie sets not yet tied
leave it. Then nodes of different families that share enough keys are met; a key's largest
family is never paired with itself. Linked sets of like size share many keys, so a set
that shares too few of its own with any other meets none, and the keys of a set that most
others hold need not be met. That settles the components. Since every link lies in a
component, last all sets of a component that has more than two are compared likewise, and
only counts leave a task. So no link is left out, and a group of near copies, whether they
link or fall short of it, makes no table of pairs.

The sets are stored once and never shuffled as a whole: a bitmap of a fixed size picks the
sets of the nodes that a step needs, and only these move. Shingles are compared by 64-bit
hashes, which no two real shingles of a corpus share.

Odd rows: a null text is empty; a null doc_id links like others, but never names a component
(null if no other doc_id does); repeated rows and equal texts share a node and a component;
rows of one doc_id and different texts are separate nodes; an empty table gives an empty
table; other input columns are ignored, whatever their names.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lineglass.llm.common import stored
from lineglass.llm.components import components

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HEAVY_ROWS = 100_000  # bound of every broadcast table of hot keys
SAMPLE = 3_000_000  # shingles counted to order the frequent ones
FREQUENT, SLOTS = 6_000, 1 << 16  # frequent shingles that come last, and the slots that tell them
TIED = 2  # one in so many of the keys that a linked pair shares at least ties two sets into a family
MET = 4  # one in so many of the keys that a linked pair shares, the coldest, is met
BLOCK = 1_000_000  # shingles of a block of sets that one task compares with another
BITS, WORD_BITS = 1 << 24, 1 << 15  # bits of the map of needed sets, and of one of its rows


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; a null text has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def shingle_set(words: Column, width: int) -> Column:
    """Distinct 64-bit hashes of the ``width``-word shingles of an array of words' hashes, sorted.

    ``words`` should be a column, not an expression: the lambda reads it once a shingle.
    """
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: F.xxhash64(F.slice(words, i, width)))
    whole = F.when(n == 0, F.array().cast("array<bigint>")).when(n < width, F.array(F.xxhash64(words)))
    return F.sort_array(F.array_distinct(whole.otherwise(windows)))


def bands(percent: int, largest: int) -> list[tuple[int, int, int, int]]:
    """(band, first size, first size of the next band, segments) up to the largest set."""
    out, low, k = [], 1, 0
    while low <= max(largest, 1):
        high = low * 100 // percent + 1
        tau = (high - 1) * (100 - percent) // percent
        out.append((k, low, high, tau + 1))
        low, k = high, k + 1
    return out


def _lookup(left: DataFrame, right: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Join ``right`` (one row a key, ``count`` rows behind it) to ``left`` on ``keys``.

    Keys behind more than ``1 / HEAVY_ROWS`` of all rows are broadcast, a table of at most
    ``HEAVY_ROWS`` rows; the rest is a shuffle join whose keys are all small.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    floor = max(1, total // HEAVY_ROWS)
    heavy = right.where(F.col(count) > floor)
    marked = left.join(F.broadcast(heavy.select(*keys).withColumn("_heavy", F.lit(True))), keys, "left")
    hot = marked.where("_heavy").drop("_heavy").join(F.broadcast(heavy), keys)
    cold = marked.where("_heavy IS NULL").drop("_heavy").join(right.where(F.col(count) <= floor), keys)
    return hot.unionByName(cold)


def _rows(docs: DataFrame, width: int) -> DataFrame:
    """Every row with its set, its size and the set's signature, stored."""
    words = F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w))
    worded = docs.select("doc_id", words.alias("_words"))
    rows = worded.select("doc_id", shingle_set(F.col("_words"), width).alias("set"))
    sized = rows.withColumn("size", F.size("set").cast("long")).withColumn("sig", F.xxhash64("set"))
    return stored(sized, "jaccard_sets")


def _nodes(rows: DataFrame) -> DataFrame:
    """One node a distinct set that is not empty: ``sig, size``, its least doc_id and its rows."""
    sets = rows.where("size > 0").groupBy("sig", "size")
    return stored(sets.agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("rows")), "jaccard_nodes")


def _sets_of(rows: DataFrame, needed: DataFrame) -> DataFrame:
    """``sig, set`` of the needed signatures, stored; sets of others are not shuffled.

    A bitmap of ``BITS`` bits, a broadcast of that size at most, lets few others through.
    """
    place = F.pmod(F.col("sig"), F.lit(BITS))
    bucket, bit = F.floor(place / WORD_BITS).cast("int"), (place % WORD_BITS).cast("int")
    maps = needed.select(bucket.alias("_bucket"), bit.cast("long").alias("_bit")).groupBy("_bucket")
    maps = maps.agg(F.bitmap_construct_agg("_bit").alias("_map"))
    byte = F.conv(F.hex(F.expr("substring(_map, _bit div 8 + 1, 1)")), 16, 10).cast("int")
    held = byte.bitwiseAND(F.expr("shiftleft(1, _bit % 8)")) != 0
    marked = rows.select("sig", "set", bucket.alias("_bucket"), bit.alias("_bit"))
    kept = marked.join(F.broadcast(maps), "_bucket").where(held)
    once = kept.groupBy("sig").agg(F.first("set").alias("set"))
    return stored(once.join(needed.select("sig").distinct(), "sig", "left_semi"), "jaccard_needed")


def _frequent(rows: DataFrame) -> bytearray:
    """A byte for every slot of shingles: 1 if several sampled sets hold a shingle of the slot."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    one_in = max(1, -(-total // SAMPLE))
    sampled = rows.where(F.pmod(F.xxhash64("sig", F.lit("sample")), F.lit(one_in)) == 0)
    counts = sampled.dropDuplicates(["sig"]).select(F.explode("set").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    top = counts.where("n > 2").orderBy(F.desc("n"), "h").limit(FREQUENT).select(F.pmod("h", F.lit(SLOTS)).alias("slot"))
    slots = bytearray(SLOTS)
    for r in top.collect():
        slots[r["slot"]] = 1
    return slots


def _keys(frequent: bytearray, percent: int) -> Column:
    """The first shingles of a set, so many that linked sets share one: those of frequent slots last."""
    wanted = F.col("size") - F.floor((percent * F.col("size") + 99) / 100) + 1
    if not any(frequent):
        return F.slice("set", F.lit(1), wanted.cast("int"))
    late = lambda h: F.substring(F.lit(bytes(frequent)), (F.pmod(h, F.lit(SLOTS)) + 1).cast("int"), F.lit(1)) == F.lit(b"\x01")
    return F.slice(F.concat(F.filter("set", lambda h: ~late(h)), F.filter("set", late)), F.lit(1), wanted.cast("int"))


def _index(rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """``key, sig, size`` for every key that two nodes or more hold, with the key's least node.

    ``held`` counts these keys of the set, ``later`` those of them that more rows hold. Of sets with many copies only rows of the least doc_id give keys.
    """
    total = nodes.agg(F.sum("rows")).first()[0] or 0
    copied = nodes.where(F.col("rows") > max(1, total // HEAVY_ROWS)).select("sig", "node", F.lit(True).alias("_copied"))
    given = rows.where("size > 0").join(F.broadcast(copied), "sig", "left").where("_copied IS NULL OR doc_id <=> node")
    entries = given.select("sig", F.explode(_keys(_frequent(rows), percent)).alias("key"))
    of_key = W.partitionBy("key")
    spread = {"low": F.min("sig").over(of_key), "high": F.max("sig").over(of_key), "heat": F.count(F.lit(1)).over(of_key)}
    kept = stored(entries.withColumns(spread).where("low <> high").select("key", "sig", "low", "heat").distinct(), "jaccard_shared")
    of_set = W.partitionBy("sig")
    kept = kept.withColumns({"held": F.count(F.lit(1)).over(of_set), "_rank": F.row_number().over(of_set.orderBy("heat", "key"))})
    kept = kept.withColumn("later", F.col("held") - F.col("_rank")).drop("heat", "_rank")
    sizes = nodes.select("sig", "size")
    sized = kept.join(sizes, "sig").join(sizes.select(F.col("sig").alias("low"), F.col("size").alias("low_size")), "low")
    return stored(sized, "jaccard_index")


def _least_keys(percent: int) -> str:
    """SQL for the keys that linked sets of ``na`` and ``nb`` shingles share at least.

    What two sets share beyond the keys of the one whose keys end first is at most what
    that one has left, so sets of like size share many keys.
    """
    both = f"({percent} * (na + nb) + {99 + percent}) div {100 + percent}"
    return f"greatest(1, {both} - ({percent} * greatest(na, nb) + 99) div 100 + 1)"


def _sized(met: DataFrame, percent: int, wanted: str) -> DataFrame:
    """Pairs ``a, b`` with ``wanted`` common ``keys``; ``met`` has a row a common key, sizes ``na`` and ``nb``."""
    fit = met.where((F.col("a") != F.col("b")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))
    counted = fit.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(
        F.count(F.lit(1)).alias("keys"), F.max(F.expr(wanted)).alias("wanted")
    )
    return stored(counted.where("keys >= wanted").select(F.col("x").alias("a"), F.col("y").alias("b"), "keys"), "jaccard_met")


def _verified(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` whose sets link, stored."""
    sigs = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig")))
    sets = _sets_of(rows, sigs)
    left = pairs.join(sets.select(F.col("sig").alias("a"), F.col("set").alias("sa")), "a")
    both = left.join(sets.select(F.col("sig").alias("b"), F.col("set").alias("sb")), "b")
    sized = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("i"), (F.size("sa") + F.size("sb")).alias("n"))
    return stored(sized.where(F.expr(f"100 * i >= {percent} * (n - i)")).select("a", "b"), "jaccard_links")


def _spanning(rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Verified links that connect every component; they are not all links within one."""
    index = _index(rows, nodes, percent)
    star = index.select(F.col("sig").alias("a"), F.col("size").alias("na"), F.col("low").alias("b"), F.col("low_size").alias("nb"))
    least = _least_keys(percent)
    near = _sized(star, percent, f"(({least}) + {TIED - 1}) div {TIED}")
    families = stored(components(near).withColumnRenamed("node", "sig"), "jaccard_families")
    inside = _within(rows, nodes, families, percent, "forest")

    # Pairs across families only; a key's largest family is never paired with itself.
    placed = index.select("key", "sig", "size", "held", "later").join(families, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    counts = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    major = counts.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.count(F.lit(1)).alias("roots"))
    major = major.where("roots > 1").select("key", F.col("top.root").alias("major"))
    open_keys = stored(placed.join(major, "key"), "jaccard_open")
    side = lambda x: open_keys.select(
        "key",
        F.col("sig").alias(x),
        F.col("size").alias(f"n{x}"),
        F.col("held").alias(f"h{x}"),
        F.col("later").alias(f"l{x}"),
        F.col("root").alias(f"r{x}"),
        (F.col("root") == F.col("major")).alias(f"m{x}"),
    )
    # Each pair is met once a key, so that its common keys can be counted. A linked pair has
    # ``least`` of them or more, so the ``wanted`` coldest have ``least - wanted`` common ones
    # after them in the order of heat: hot keys need not meet, nor sets with too few keys.
    wanted = f"(({least}) + {MET - 1}) div {MET}"
    able = f"least(ha, hb) >= {least} AND least(la, lb) >= {least} - {wanted}"
    across = side("a").where("NOT ma").join(side("b"), "key").where(f"ra <> rb AND (mb OR a < b) AND {able}")
    # A family of two nodes is its pair.
    few = families.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select(F.col("root").alias("a"))
    pairs = _sized(across, percent, wanted).unionByName(near.join(few, "a", "left_semi")).select("a", "b")
    found = inside.unionByName(_verified(stored(pairs, "jaccard_pairs"), rows, percent))
    return stored(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "jaccard_spanning")


def _compared(percent: int, what: str):
    """Compares the sets of one or two blocks: all ``links``, a ``forest`` of them that ties
    the same sets together, or each set's ``degrees``, the number of its links."""

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        sides, sigs = group["side"].to_numpy(), group["sig"].to_numpy("int64")
        left, right = np.flatnonzero(sides != 2), np.flatnonzero(sides != 1)
        sets = group["set"].to_list()
        sizes = np.array([len(s) for s in sets], "int64")
        tokens = np.concatenate([sets[k] for k in right])
        order = np.argsort(tokens, kind="stable")
        tokens, owners = tokens[order], np.repeat(np.arange(len(right)), sizes[right])[order]
        found, degree, tied = [], np.zeros(len(sets), "int64"), np.arange(len(sets))
        for k in left:
            if what == "forest" and (tied[right] == tied[k]).all():
                continue
            start, end = np.searchsorted(tokens, sets[k], "left"), np.searchsorted(tokens, sets[k], "right")
            held = end - start
            places = np.arange(held.sum()) + np.repeat(start - np.cumsum(held) + held, held)
            shared = np.bincount(owners[places], minlength=len(right))
            linked = right[100 * shared >= percent * (sizes[k] + sizes[right] - shared)]
            # Within a block (side 0) each pair is met from both ends.
            linked = linked[(sides[linked] != 0) | (linked > k)]
            if what == "degrees":
                degree[k] += len(linked)
                degree[linked] += 1
                continue
            if what == "forest":
                trees, first = np.unique(tied[linked], return_index=True)
                linked = linked[first[trees != tied[k]]]
                tied[np.isin(tied, tied[linked])] = tied[k]
            found += [(sigs[k], sigs[x]) for x in linked]
        if what != "degrees":
            return pd.DataFrame(found, columns=["a", "b"], dtype="int64")
        return pd.DataFrame({"sig": sigs[degree > 0], "n": degree[degree > 0]})

    return compare


def _within(rows: DataFrame, nodes: DataFrame, roots: DataFrame, percent: int, what: str) -> DataFrame:
    """``links`` or a ``forest`` of links ``a, b`` inside the groups of three nodes or more, or ``degrees``, ``sig, n``."""
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    largest = nodes.agg(F.max("size")).first()[0] or 0
    table = nodes.sparkSession.createDataFrame(bands(percent, largest), "band int, low long, high long, segments int")
    members = _lookup(roots, sizes, ["root"], "n").select("sig", "root").join(nodes.select("sig", "size"), "sig")
    inside = (F.col("size") >= F.col("low")) & (F.col("size") < F.col("high"))
    members = stored(members.join(F.broadcast(table), inside).select("sig", "root", "size", "band"), "jaccard_members")
    blocks = members.groupBy("root", "band").agg(F.ceil(F.sum("size") / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n"))
    blocks = stored(blocks, "jaccard_blocks")
    beside = lambda d, name: blocks.select("root", (F.col("band") - d).alias("band"), F.col("blocks").alias(name))
    around = blocks.join(beside(-1, "below"), ["root", "band"], "left").join(beside(1, "above"), ["root", "band"], "left")
    dealt = _lookup(members, around, ["root", "band"], "n").withColumn("i", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
    # A task compares two blocks of one band, a block with itself, or blocks of bands side by side.
    tasks = """concat(
        transform(sequence(0, blocks - 1), j -> struct(band as lo, band as hi, least(i, j) as i, greatest(i, j) as j,
            if(i = j, 0, if(i < j, 1, 2)) as side)),
        if(above is null, array(), transform(sequence(0, above - 1), j -> struct(band as lo, band + 1 as hi, i as i, j as j, 1 as side))),
        if(below is null, array(), transform(sequence(0, below - 1), j -> struct(band - 1 as lo, band as hi, j as i, i as j, 2 as side))))"""
    sent = dealt.select("sig", "root", F.explode(F.expr(tasks)).alias("t")).select("sig", "root", "t.*")
    sets = _sets_of(rows, members.select("sig"))
    grouped = sent.join(sets, "sig").groupBy("root", "lo", "hi", "i", "j")
    found = grouped.applyInPandas(_compared(percent, what), "sig long, n long" if what == "degrees" else "a long, b long")
    return found.groupBy("sig").agg(F.sum("n").alias("n")) if what == "degrees" else found


def links(docs: DataFrame, width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with signature and size, the nodes, and every link between two nodes, by signature."""
    rows = _rows(docs, width)
    nodes = _nodes(rows)
    found = _spanning(rows, nodes, percent)
    roots = stored(components(found).withColumnRenamed("node", "sig"), "jaccard_roots")
    pairs = _within(rows, nodes, roots, percent, "links")
    few = roots.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select(F.col("root").alias("a"))
    least = pairs.unionByName(found.join(few, "a", "left_semi")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return rows.drop("set"), nodes, least


def joined(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Every row: ``doc_id, n_shingles, component_id, n_links``.

    ``n_links`` counts all other distinct sets that the row's set links with; equal copies
    are one set and not counted.
    """
    rows = _rows(docs, width)
    nodes = _nodes(rows)
    found = _spanning(rows, nodes, percent)
    roots = stored(components(found).withColumnRenamed("node", "sig"), "jaccard_roots")
    degree = stored(_within(rows, nodes, roots, percent, "degrees"), "jaccard_degrees")
    of_root = roots.join(nodes.select("sig", "node"), "sig").groupBy("root")
    named = of_root.agg(F.min("node").alias("component_id"), F.count(F.lit(1)).alias("n"))
    linked = _lookup(roots, named, ["root"], "n").join(degree.withColumnRenamed("n", "met"), "sig", "left")
    # In a component of two nodes each has one link.
    linked = linked.select("sig", "component_id", F.coalesce("met", F.lit(1)).cast("long").alias("n_links"))
    of_node = nodes.join(linked, "sig", "left").select(
        "sig",
        "size",
        F.when(F.col("n_links").isNull(), F.col("node")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        "rows",
    )
    placed = _lookup(rows.where("size > 0").drop("set"), of_node, ["sig", "size"], "rows").select(
        "doc_id", F.col("size").alias("n_shingles"), "component_id", F.col("n_links").cast("long")
    )
    alone = rows.where("size = 0").select(
        "doc_id",
        F.col("size").alias("n_shingles"),
        F.col("doc_id").alias("component_id"),
        F.lit(0).cast("long").alias("n_links"),
    )
    return placed.unionByName(alone)
