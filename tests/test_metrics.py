import random
import re

from pyspark.sql import functions as F

from lineglass.operators import metrics as m


def test_javascript_counts_match_python(spark):
    rng = random.Random(3)
    parts = ["function", " ", " ", "foo", "(", ")", "{", "}", "=>", "class", "\n", "é", "_", "1", ",", "xfunction", "\u00a0", "if ", "else if ", "&&", "||", "?"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(600)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string")
    rows = df.select("i", m.js_functions(F.col("c")), m.js_classes(F.col("c")), m.js_decisions(F.col("c"))).collect()
    markers = ["if ", "else ", "for ", "while ", "case ", "catch ", "&&", "||", "?"]
    for i, functions, classes, decisions in rows:
        t = texts[i]
        assert functions == len(re.findall(m.JS_FUNCTION_PATTERN, t)), repr(t)
        assert classes == len(re.findall(m.JS_CLASS_PATTERN, t)), repr(t)
        assert decisions == sum(t.count(x) for x in markers), repr(t)


def test_every_family_gets_one_row_per_file(spark, files):
    js = "function f() {\n  if (a && b) { }\n}\n// c\n"
    rows = m.file_metrics(files([("p", "a.ts", js), ("p", "b.go", "a\n\nb\n"), ("p", "c.go", ""), ("p", "d", "TODO")])).collect()
    got = {r.filepath: tuple(r)[2:] for r in rows}
    assert got["a.ts"] == (5, 3, 1, 1, 2, 0, 1.0, 100 - 3 - 0.03)
    assert got["b.go"] == (3, 2, 0, 1, 0, 0, 0.0, 0.0)
    assert got["c.go"] == (0, 0, 0, 0, 0, 0, 0.0, 0.0)
    assert got["d"] == (1, 1, 0, 0, 0, 0, 0.0, 0.0)
