"""Rows that every operator has to bear, and invented prose."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length long, shard int, fp long, ids string"


def prose(seed: int, words: int, mark: str = "") -> str:
    r = random.Random(seed)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt"]
    out = []
    for k in range(words):
        word = "".join(r.choice(parts) for _ in range(r.randint(1, 4)))
        out.append(word + ("." if r.random() < 0.08 else "," if r.random() < 0.06 else ""))
    return " ".join(out) + mark


def documents(spark, texts, ids=None):
    """A documents table with columns whose names the operators use themselves."""
    rows = [
        (i, t, "en", f"src{n % 3}", len(t or ""), 1, 2, 3, "x")
        for n, (i, t) in enumerate(zip(ids if ids is not None else range(len(texts)), texts))
    ]
    return spark.createDataFrame(rows, SCHEMA)


def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, one id for two texts."""
    long = prose(1, 30_000)
    rows = [
        (1, None, None, None, None, None, None, None, None),
        (2, "", "en", "a", 0, 1, 1, 1, ""),
        (None, "no id, " + prose(2, 40), "en", "a", 9, 1, 1, 1, ""),
        (3, long, "de", "b", 9, 1, 1, 1, ""),
        (4, prose(3, 80), "en", "a", 9, 1, 1, 1, ""),
        (4, prose(3, 80), "en", "a", 9, 1, 1, 1, ""),
        (4, prose(4, 80), "en", "a", 9, 1, 1, 1, ""),
        (5, " \n\t   ", "fr", "c", 9, 1, 1, 1, ""),
        (6, "\U0001f600 <|endoftext|> café  two  spaces\n\n end ", "fr", "c", 9, 1, 1, 1, ""),
        (-7, "word " * 300, "fr", "c", 9, 1, 1, 1, ""),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")
