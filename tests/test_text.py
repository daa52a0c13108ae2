import os
import random

from pyspark.sql import functions as F

from lineglass.functions.text import BLANK_CHARS, count_substring, extension, fixed_decimals, fold_case, strip
from lineglass.operators.corpus import decode_text


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", expr(F.col("v"))).orderBy("i").collect()]


def test_blank_characters_are_python_whitespace():
    assert set(BLANK_CHARS) == {chr(i) for i in range(0x11000) if chr(i).isspace()}


def test_strip_matches_python(spark):
    values = ["", " a ", "\x1c\x85a b\u3000", "\u2028x\u00a0", "\t\n", "\u200bz"]
    assert column(spark, values, "string", strip) == [v.strip() for v in values]


def test_extension_matches_splitext(spark):
    names = ["a.py", "a.b.PY", ".py", "..py", ".a.py", "a", "a.", "d.x/a", "d/.b.c", "a..js", "x\n.py", ""]
    assert column(spark, names, "string", extension) == [os.path.splitext(n)[1].lower() for n in names]


def test_fold_case_covers_every_case_insensitive_ascii_match(spark):
    import re

    odd = [chr(c) for c in range(0x80, 0x3000) if re.match("[a-z]", chr(c), re.I)]
    assert sorted(odd) == sorted("\u0130\u0131\u017f\u212a")
    folded = column(spark, [f"A{c}é" for c in odd], "string", fold_case)
    assert all(any(f"a{x}" in f for x in "iks") for f in folded)


def test_count_substring_matches_python(spark):
    values = ["", "if if  if", "|||", "&&&&", "é??é?"]
    for needle in ("if ", "||", "&&", "?"):
        assert column(spark, values, "string", lambda c: count_substring(c, needle)) == [v.count(needle) for v in values]


def test_fixed_decimals_round_half_even_like_python(spark):
    values = [2.25, 2.35, 0.5, 1.5, 2.5, 1234.55, 0.0, 99.95]
    for digits in (0, 1):
        got = column(spark, values, "double", lambda c: fixed_decimals(c, digits))
        assert got == [f"{v:.{digits}f}" for v in values]


def test_decode_matches_python_text_mode(spark):
    rng = random.Random(5)
    pool = [b"a", b"\r", b"\n", b"\xff", b"\xc3", b"\xa9", b"\xe2\x82\xac", b"\xef\xbf\xbd", b"\xef\xb7\x90", b"b",
            b"\xed\xa0\x80", b"\xf0\x9f\x98\x80", b"\xf0\x9f", b"\xc0\xaf", b"\xe2\x82"]
    values = [b"".join(rng.choice(pool) for _ in range(rng.randrange(12))) for _ in range(400)]
    want = [v.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n") for v in values]
    assert column(spark, [bytearray(v) for v in values], "binary", decode_text) == want
