import contextlib
import io
import os
import time

from lineglass.sources import tree_source


def make(root, files):
    for rel, text in files.items():
        path = os.path.join(root, rel)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(text)


TREE = {
    "p/__init__.py": "",
    "p/.hidden.py": "x = 1\n",
    "p/a/b/c/d/deep.py": "deep\r\nline",
    "p/a/empty.js": "",
    "p/node_modules/lib.js": "ignored",
    "p/a/build/out.py": "ignored",
    "p/a/package-lock.json": "{}",
    "p/a/notes.txt": "not supported",
    "p/a/Main.PY": "upper",
    "q/x.ts": "q file",
    "top.py": "outside every project",
}


def test_batch_reads_hidden_and_empty_files_and_skips_ignored(spark, tmp_path):
    root = str(tmp_path / "tree")
    make(root, TREE)
    df = tree_source.read_tree_source(spark, root)
    got = sorted(tuple(r) for r in df.collect())
    assert got == [
        ("p", ".hidden.py", "x = 1\n"),
        ("p", "__init__.py", ""),
        ("p", "a/Main.PY", "upper"),
        ("p", "a/b/c/d/deep.py", "deep\nline"),
        ("p", "a/empty.js", ""),
        ("q", "x.ts", "q file"),
    ]
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        df.explain("formatted")
    assert "PushedFilters: [In(extension" in shown.getvalue()


def test_plans_of_any_spread_read_every_file_once(spark, tmp_path):
    root = str(tmp_path / "wide")
    make(root, {f"p/d{k % 7}/e{k % 3}/f{k}.py": str(k) for k in range(60)})
    tree_source.registered(spark)
    for spread in (1, 3, 8, 500):
        rows = spark.read.format("lineglass_tree").options(path=root, projects="true", spread=str(spread)).load()
        paths = [r.path for r in rows.collect()]
        assert len(paths) == len(set(paths)) == 60


def test_stream_brings_new_and_changed_files_once(spark, tmp_path):
    root, out, marks = str(tmp_path / "s"), str(tmp_path / "out"), str(tmp_path / "marks")
    make(root, TREE)

    def run():
        stream = tree_source.read_tree_source(spark, root, stream=True).writeStream.format("parquet")
        stream.option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.path, r.content) for r in spark.read.parquet(out).collect())

    first = run()
    assert ("__init__.py", "") in first and (".hidden.py", "x = 1\n") in first and len(first) == 6
    time.sleep(0.05)
    make(root, {"p/new.py": "new", "p/.hidden.py": "x = 2\n"})
    second = run()
    assert sorted(set(second) - set(first)) == [(".hidden.py", "x = 2\n"), ("new.py", "new")]
    assert run() == second


def test_odd_trees(spark, tmp_path):
    """A missing root and an empty root give no rows."""
    assert tree_source.read_tree_source(spark, str(tmp_path / "missing")).count() == 0
    os.makedirs(tmp_path / "empty")
    assert tree_source.read_tree_source(spark, str(tmp_path / "empty")).count() == 0
    one = str(tmp_path / "one")
    make(one, {"x.py": "single"})
    assert [tuple(r) for r in tree_source.read_tree_source(spark, one, project="me").collect()] == [("me", "x.py", "single")]
