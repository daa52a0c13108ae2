"""Token counts as a rollup that batches of signed changes maintain.

A change says that a counted document came (+1) or went (-1); a revised count is both, the
old one and the new. A batch is added up by source, language and tokenizer version before
it is written, and its totals count once its commit is written. Both are overwritten by
name, so a batch that is written again, after a failure or by mistake, counts once.
"""

from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineglass.llm.common import stored
from lineglass.llm.packing import encoder
from lineglass.session import fresh_path

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["documents", "tokens", "bytes"]
COMMIT = "batch string, folder string, replaces array<string>"

# The tokenizer versions of the registered query.
VERSIONS = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]


def tokens(text: Column, vocabulary: str) -> Column:
    """Ids of a whole text; null and empty texts have none."""

    def run(texts: pa.Array) -> pa.Array:
        own = encoder(vocabulary)
        return pa.array([len(own.whole(t.as_py() or "")) // 4 for t in texts], pa.int64())

    return F.arrow_udf(run, "bigint")(text)


def _revised_counts(text: str, squeezed: str, first: str, second: str) -> tuple[int, int, int]:
    """Ids of a text, of its revision, and of that under the second vocabulary."""
    before = len(encoder(first).whole(text)) // 4
    after = before if squeezed == text else len(encoder(first).whole(squeezed)) // 4
    return before, after, len(encoder(second).whole(squeezed)) // 4


def revised_tokens(text: Column, squeezed: Column, first: str, second: str) -> Column:
    """``old``, ``new`` and ``other``: ids of a whole text and of its revision, text by text.

    The words of a revision are still remembered from its text, so they are encoded once.
    """

    @F.arrow_udf("struct<old:bigint,new:bigint,other:bigint>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, revisions in batches:
            rows = [_revised_counts(t.as_py() or "", r.as_py() or "", first, second) for t, r in zip(texts, revisions)]
            columns = zip(*rows) if rows else [()] * 3
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["old", "new", "other"])
        for vocabulary in (first, second):
            encoder(vocabulary).forget()

    return run(text, squeezed)


class Rollup:
    """Additive totals in a folder: one Parquet table for each batch, and the commits."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> "Rollup":
        """An empty rollup; creating it again changes nothing."""
        made = cls(spark, path)
        made._commit("", "", [])
        return made

    def _commit(self, batch: str, folder: str, replaces: list[str]) -> None:
        row = self.spark.createDataFrame([(batch, folder, replaces)], COMMIT)
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/batch={quote(batch, safe='')}.")

    def _commits(self) -> dict[str, tuple[str, list[str]]]:
        rows = self.spark.read.schema(COMMIT).parquet(f"{self.path}/commits/*").collect()
        return {r["batch"]: (r["folder"], r["replaces"]) for r in rows if r["batch"]}

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of changes with ``source``, ``lang``, ``tokenizer``, ``sign``, ``tokens`` and ``bytes``.

        False if the batch counts already. Null sources, languages and versions are groups
        of their own; a null sign, or null tokens or bytes, change nothing in their sums;
        repeated rows are changes of their own.
        """
        if not batch:
            raise ValueError("a batch needs a name")
        if batch in self._commits():
            return False
        sign = F.coalesce(F.col("sign"), F.lit(0)).cast("long")
        added = changes.groupBy(*KEYS).agg(
            F.sum(sign).alias("documents"),
            *[F.coalesce(F.sum(sign * F.col(c)), F.lit(0)).cast("long").alias(c) for c in SUMS[1:]],
        )
        folder = f"batches/{quote(batch, safe='')}."
        added.write.mode("overwrite").parquet(f"{self.path}/{folder}")
        self._commit(batch, folder, [])
        return True

    def _live(self) -> dict[str, str]:
        commits = self._commits()
        gone = {b for _, replaced in commits.values() for b in replaced}
        return {b: folder for b, (folder, _) in commits.items() if b not in gone}

    def totals(self) -> DataFrame:
        """The sums of all committed batches; groups that are empty again are left out."""
        folders = [f"{self.path}/{folder}" for folder in self._live().values()]
        schema = "source string, lang string, tokenizer string, documents long, tokens long, bytes long"
        rows = self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        sums = rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
        return sums.where(" OR ".join(f"{c} <> 0" for c in SUMS))

    def compact(self, name: str) -> None:
        """Replace all batches so far by one with their sums; they stay known as committed."""
        live = self._live()
        if live and name not in self._commits():
            folder = f"batches/{quote(name, safe='')}."
            self.totals().write.mode("overwrite").parquet(f"{self.path}/{folder}")
            self._commit(name, folder, sorted(live))


def changes(rows: DataFrame, sign: int, tokenizer: str, count: str) -> DataFrame:
    return rows.select(
        "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(sign).alias("sign"), F.col(count).alias("tokens"), "bytes"
    )


def revised(text: Column) -> Column:
    """A text with each run of white space squeezed to one space."""
    return F.regexp_replace(text, r"\s+", " ")


def maintained(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Totals after a corpus came, lost its exact copies, was revised and counted anew.

    All documents are inserted under the first version; all but one of each group of equal
    texts (the least source, language and id) are deleted; what is left has its white space
    squeezed and its counts revised; last, it is counted under the second version. The first
    batch is sent twice, and counts once. Null texts are empty, null sources and languages
    are groups of their own, repeated rows are copies, an empty table gives no rows, other
    columns play no part.
    """
    spark = docs.sparkSession
    first, second = VERSIONS
    text = F.coalesce("text", F.lit(""))
    squeezed = revised(text)
    counted = stored(
        docs.select(
            "source",
            "lang",
            F.struct("source", "lang", "doc_id").alias("place"),
            F.xxhash64(text).alias("hash"),
            F.crc32(text.cast("binary")).alias("check"),
            F.octet_length(text).cast("long").alias("bytes"),
            F.octet_length(squeezed).cast("long").alias("new_bytes"),
            revised_tokens(text, squeezed, first, second).alias("ids"),
        ).select("*", "ids.*").drop("ids"),
        "counts",
    )
    # Equal texts have equal counts, so one row stands for each place of them.
    key = ["hash", "check", "bytes"]
    kept = counted.groupBy(*key).agg(F.min_by(F.struct("source", "lang", "new_bytes", "old", "new", "other"), "place").alias("k"))
    kept = stored(kept.select("bytes", "k.*"), "kept")
    rollup = Rollup.create(spark, path or fresh_path(spark, "rollup"))
    load = changes(counted, 1, first, "old")
    rollup.commit("load", load)
    rollup.commit("copies", changes(counted, -1, first, "old").unionByName(changes(kept, 1, first, "old")))
    fresh = kept.withColumn("bytes", F.col("new_bytes"))
    rollup.commit("revision", changes(kept, -1, first, "old").unionByName(changes(fresh, 1, first, "new")))
    rollup.commit("load", load)
    rollup.compact("base")
    rollup.commit("recount", changes(fresh, 1, second, "other"))
    return rollup.totals()
