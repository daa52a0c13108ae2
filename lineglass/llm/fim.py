"""Fill-in-the-middle: every text cut at two ranks of its units and put together again.

A text is read as a sequence of units (one code point each by default, or any pattern
that covers the text). The two cut ranks are found in an indexable skip list whose
express lanes carry, for each link, the units and the code points that it jumps; a search
descends lane by lane, adding both widths, and stops at the rank asked for with the
code-point offset of that cut in hand. Only these numbers leave Python; the pieces, the
rearranged text and its parsing back are built by Spark on the executor that read the
text, so no text is shuffled.

Cut ranks, form and rates come from the sha256 of ``<seed>:<doc_id>``: h1 to h4 are its
first four groups of eight hex digits read as unsigned integers. The prefix ends after
``min(h1, h2) % (n + 1)`` units, the middle after the larger; the text stays plain if it is
empty, holds a marker, or ``h3 % 100 >= fim_percent``; otherwise it is SPM when
``h4 % 100 < spm_percent``, else PSM.

Odd rows: a null text counts as empty and stays plain; a null ``doc_id`` gives null hashes
and a plain text; a text of any length is cut whole (the skip list has logarithmic depth);
repeated rows give equal rows; an empty table gives an empty table; the result keeps the
input's columns, and columns of its own names (``fim_*``) are replaced.
"""

import re
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Fixed values of the format: the three sentinels and the two layouts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

# Executors need not have the package: the helpers below travel with the function.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FAN = 8  # units a link of the next lane spans, as a power of this


class SkipList:
    """An indexable skip list over units that have a width in units and in code points.

    Lane 0 links every unit to the next; lane ``k`` links every ``FAN**k``-th unit and
    carries the sums of both widths over the units it jumps.
    """

    def __init__(self, unit_widths: np.ndarray, point_widths: np.ndarray):
        self.lanes = [(unit_widths.astype(np.int64), point_widths.astype(np.int64))]
        while len(self.lanes[-1][0]) > FAN:
            units, points = self.lanes[-1]
            starts = np.arange(0, len(units), FAN)
            self.lanes.append((np.add.reduceat(units, starts), np.add.reduceat(points, starts)))

    @property
    def units(self) -> int:
        return int(self.lanes[-1][0].sum())

    def offset(self, rank: int) -> int:
        """Code points before the unit of this rank: the widths added while descending."""
        at, units, points = 0, 0, 0
        for level in range(len(self.lanes) - 1, -1, -1):
            unit_lane, point_lane = self.lanes[level]
            at *= FAN if level < len(self.lanes) - 1 else 1
            while at < len(unit_lane) and units + unit_lane[at] <= rank:
                units += int(unit_lane[at])
                points += int(point_lane[at])
                at += 1
        return points


def skip_list(text: str, unit: str) -> SkipList:
    """The skip list of a text split into units of the pattern (code points between them count as units)."""
    if unit == "(?s).":
        return SkipList(np.ones(len(text), np.int64), np.ones(len(text), np.int64))
    spans, last = [], 0
    for m in re.finditer(unit, text):
        if m.start() > last:
            spans.extend([1] * (m.start() - last))
        if m.end() > m.start():
            spans.append(m.end() - m.start())
        last = max(last, m.end())
    spans.extend([1] * (len(text) - last))
    points = np.array(spans, np.int64)
    return SkipList(np.ones(len(points), np.int64), points)


def _cuts(unit: str):
    @pandas_udf("n long, low long, high long")
    def cuts(texts: pd.Series, first: pd.Series, second: pd.Series) -> pd.DataFrame:
        rows = []
        for text, a, b in zip(texts, first, second):
            lanes = skip_list(text if isinstance(text, str) else "", unit)
            n = lanes.units
            if pd.isna(a) or pd.isna(b):
                rows.append((n, None, None))
                continue
            ranks = sorted((int(a) % (n + 1), int(b) % (n + 1)))
            rows.append((n, lanes.offset(ranks[0]), lanes.offset(ranks[1])))
        return pd.DataFrame(rows, columns=["n", "low", "high"])

    return cuts


def _group(digest: Column, k: int) -> Column:
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def transform(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    seed: int = 1,
    fim_percent: int = 90,
    spm_percent: int = 20,
    unit: str = "(?s).",
) -> DataFrame:
    """Add ``fim_text``, ``fim_form`` ('plain', 'psm', 'spm'), ``fim_units``, ``fim_prefix_chars``, ``fim_middle_chars``.

    The char columns count code points and are null for plain texts.
    """
    own = [c for c in docs.columns if c.startswith("fim_")]
    base = docs.drop(*own).withColumn("_fim_text", F.coalesce(F.col(text), F.lit("")))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    hashed = base.withColumn("_fim_digest", digest)
    h = [_group(F.col("_fim_digest"), k) for k in range(4)]
    cut = hashed.withColumn("_fim_cut", _cuts(unit)("_fim_text", h[0], h[1]))
    t, low, high = F.col("_fim_text"), F.col("_fim_cut.low"), F.col("_fim_cut.high")
    prefix = F.substring(t, F.lit(1), low.cast("int"))
    middle = F.expr("substring(_fim_text, int(_fim_cut.low) + 1, int(_fim_cut.high - _fim_cut.low))")
    suffix = F.expr("substring(_fim_text, int(_fim_cut.high) + 1)")
    marked = t.contains(PREFIX) | t.contains(SUFFIX) | t.contains(MIDDLE)
    form = (
        F.when((t == "") | marked | low.isNull() | (h[2] % 100 >= fim_percent), "plain")
        .when(h[3] % 100 < spm_percent, "spm")
        .otherwise("psm")
    )
    formed = cut.withColumn("fim_form", form)
    out = (
        F.when(F.col("fim_form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("fim_form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(t)
    )
    plain = F.col("fim_form") == "plain"
    return formed.select(
        *[c for c in docs.columns if c not in own],
        out.alias("fim_text"),
        "fim_form",
        F.col("_fim_cut.n").alias("fim_units"),
        F.when(~plain, low).alias("fim_prefix_chars"),
        F.when(~plain, high - low).alias("fim_middle_chars"),
    )


def restored(text: Column, form: Column) -> Column:
    """The original text, parsed back from a rearranged text and its form."""
    after = lambda s, m: F.substring_index(s, m, -1)  # noqa: E731  text after the only marker
    before = lambda s, m: F.substring_index(s, m, 1)
    psm = F.concat(before(after(text, PREFIX), SUFFIX), after(text, MIDDLE), before(after(text, SUFFIX), MIDDLE))
    spm = F.concat(before(after(text, PREFIX), MIDDLE), after(text, MIDDLE), before(after(text, SUFFIX), PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)


def digests(docs: DataFrame) -> DataFrame:
    """The contract's digest columns of every document."""
    fim = transform(docs.select("doc_id", "text"))
    return fim.select(
        "doc_id",
        F.col("fim_units").alias("n"),
        F.col("fim_form").alias("form"),
        F.col("fim_prefix_chars").alias("prefix_chars"),
        F.col("fim_middle_chars").alias("middle_chars"),
        F.sha2("fim_text", 256).alias("output_sha256"),
        F.sha2(restored(F.col("fim_text"), F.col("fim_form")), 256).alias("restored_sha256"),
    )


DIGESTS_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id::VARCHAR) AS s FROM documents
),
h AS (
    SELECT doc_id, t, length(t)::BIGINT AS n,
        ('0x' || substr(s, 1, 8))::UBIGINT AS h1, ('0x' || substr(s, 9, 8))::UBIGINT AS h2,
        ('0x' || substr(s, 17, 8))::UBIGINT AS h3, ('0x' || substr(s, 25, 8))::UBIGINT AS h4
    FROM d
),
c AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS lo, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS hi,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
             WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM h
),
o AS (
    SELECT *, substr(t, 1, lo) AS p, substr(t, lo + 1, hi - lo) AS m, substr(t, hi + 1) AS x FROM c
)
SELECT doc_id, n, form,
    CASE WHEN form = 'plain' THEN NULL ELSE lo END AS prefix_chars,
    CASE WHEN form = 'plain' THEN NULL ELSE hi - lo END AS middle_chars,
    sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m
                     WHEN 'spm' THEN '<S>' || x || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM o
"""
