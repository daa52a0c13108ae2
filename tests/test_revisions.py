import itertools

from lineglass.operators import scan
from lineglass.operators.lines import explode_lines
from lineglass.streaming import arrivals, revisions

SCHEMA = "project string, path string, content string, version long"
KEY = ["project", "file", "line", "rule", "ord"]

VERSIONS = [
    ("p", "a.py", "x = 1\neval(y)\n", 1),
    ("p", "a.py", "password = 'hunter2hunter2'\n", 2),
    ("p", "a.py", "", 3),
    ("p", "b.py", "eval(z)\n" * 3, 1),
    ("p", "b.py", "eval(z)\n" * 3, 1),
    ("p", "b.py", None, 2),
    ("p", "c.js", "eval(q)\n", None),
    ("q", "b.py", "exec(w)\n", 5),
    (None, "d.py", "eval(1)\n", 1),
]


def last_versions():
    newest = {}
    for project, path, content, version in VERSIONS:
        if project is None:
            continue
        v = -(2**62) if version is None else version
        if (project, path) not in newest or v > newest[(project, path)][1]:
            newest[(project, path)] = (content, v)
    return [(p, f, c) for (p, f), (c, _) in newest.items()]


def test_any_order_of_arrivals_nets_to_the_last_versions(spark, tmp_path):
    want_df = scan.scan_rules(explode_lines(spark.createDataFrame(last_versions(), "project string, path string, content string")))
    want = sorted(tuple(r[k] for k in KEY) for r in want_df.collect())
    orders = [VERSIONS, VERSIONS[::-1], [VERSIONS[k] for k in (2, 5, 0, 7, 3, 1, 8, 6, 4)]]
    for n, order in enumerate(orders):
        inbox, out, marks = (str(tmp_path / f"{x}{n}") for x in ("in", "out", "marks"))
        for step, chunk in enumerate(itertools.batched(order, 2)):
            spark.createDataFrame(list(chunk), SCHEMA).write.parquet(f"{inbox}/{step}")
            stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(inbox)
            arrivals.drain(revisions.revised_findings(stream), out, marks)
        signed = spark.read.schema(revisions.SIGNED).parquet(out)
        got = sorted(tuple(r[k] for k in KEY) for r in revisions.current_findings(signed).collect())
        assert got == want, n
        again = arrivals.drain(revisions.revised_findings(stream), out, marks)
        assert again.count() == signed.count()


def test_a_table_in_one_batch(spark):
    signed = revisions.revised_findings(spark.createDataFrame(VERSIONS, SCHEMA))
    rules = {r.rule for r in revisions.current_findings(signed).collect()}
    assert rules and all(r.sign in (1, -1) for r in signed.collect())
    assert revisions.revised_findings(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_file_is_few_values_to_python(spark):
    """Findings reach the state as one text a finding and leave it as one row a file."""
    import pandas as pd

    rows = pd.DataFrame({"version": [2, 2, 1, 2, 2], "ord": [-1, 7, 9, 7, 8], "finding": [None, "a", "b", "a", "c"]})
    out, state = revisions._revised(("p", "f"), [rows], 1, "old")
    assert out.values.tolist() == [["p", "f", 2, "old", "a\nc"]] and state == (2, "a\nc")
    assert revisions._revised(("p", "f"), [rows], 2, "old") is None
    assert revisions._revised(("p", "f"), [rows[:1]], None, "") == (None, (2, ""))
    line = 'eval("\\n\u2028\t")  # \U0001f600 ' + '"' * 3
    signed = revisions.revised_findings(spark.createDataFrame([("p", "a.py", line, 1)], SCHEMA))
    want = scan.scan_rules(explode_lines(spark.createDataFrame([("p", "a.py", line)], "project string, path string, content string")))
    assert sorted(signed.drop("sign", "version").collect()) == sorted(want.select(*revisions.COLUMNS).collect())
