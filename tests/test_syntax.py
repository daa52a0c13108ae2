import ast
import random

import pytest

from lineglass.operators import syntax
from lineglass.operators.metrics import file_metrics


def facts(spark, files, codes):
    """Complexities and findings of several modules from one run."""
    nodes = syntax.python_nodes(files([("p", str(i), code) for i, code in enumerate(codes)])).persist()
    found, functions = [[] for _ in codes], [{} for _ in codes]
    for f in syntax.tree_findings(nodes).orderBy("file", "ord").collect():
        found[int(f.file)].append((f.rule, f.line, f.column, f.message))
    for f in syntax.function_complexity(nodes).collect():
        functions[int(f.path)][f.name] = f.complexity
    nodes.unpersist()
    return functions, found


CASES = [
    ("def f(a=[]): pass", {"f": 1}, ["B012"]),
    ("def f(a=[], *, b={}): pass", {"f": 1}, ["B012"]),
    ("def f(*, b={1}): pass", {"f": 1}, ["B012"]),
    ("def f(a=list()): pass", {"f": 1}, []),
    ("def f(a,b,c,d,e,g,h,i): pass", {"f": 1}, ["C002"]),
    ("def f(a,b,c,d,e,g,h): pass", {"f": 1}, []),
    ("def f(a,b,c,d,e,g,h,i,/): pass", {"f": 1}, []),
    ("def f(a,b,c,d,*x,e,g,h,i,**y): pass", {"f": 1}, ["C002"]),
    ("def f():\n  if a: pass\n  def g():\n    for x in y: pass\n", {"f": 3, "g": 2}, []),
    ("def f(): return x and y and z", {"f": 3}, []),
    ("def f(): return [i for i in a for j in b if j]", {"f": 3}, []),
    ("async def f():\n  async with a: pass\n  async for b in c: pass\n  assert d", {"f": 4}, []),
    ("def f():\n  match a:\n    case 1: pass\n  try: pass\n  finally: pass\n  return 1 if b else (lambda: 2)", {"f": 1}, []),
    ("def f():\n" + "  if a: pass\n" * 10, {"f": 11}, ["C001"]),
    ("def f():\n" + "  if a: pass\n" * 9, {"f": 10}, []),
    ("def (", {}, ["E001"]),
    ("x = 1", {}, []),
    ("if a and b: pass", {}, []),
    ("@d(x or y)\ndef f(a=(b and c)): pass", {"f": 3}, []),
]


def test_tree_cases(spark, files):
    functions, found = facts(spark, files, [code for code, *_ in CASES])
    for (code, want, rules), got, hits in zip(CASES, functions, found):
        assert got == want, code
        assert [f[0] for f in hits] == rules, code


def test_messages_and_breadth_first_order(spark, files):
    code = "class A:\n  def m(s, a=[]): pass\ndef f(b={}):\n  pass\n"
    _, (found,) = facts(spark, files, [code])
    assert found == [
        ("B012", 3, 0, 'Mutable default argument in function "f"'),
        ("B012", 2, 2, 'Mutable default argument in function "m"'),
    ]


def by_hand(tree):
    """Complexity of every function by walking each subtree."""
    counted = (ast.If, ast.While, ast.For, ast.AsyncFor, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.Assert, ast.comprehension)
    out = {}
    for f in ast.walk(tree):
        if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)):
            inner = list(ast.walk(f))
            out[f.name] = 1 + sum(isinstance(n, counted) for n in inner) + sum(
                len(n.values) - 1 for n in inner if isinstance(n, ast.BoolOp))
    return out


def random_module(rng):
    names = iter(range(1000))

    def block(depth, pad):
        lines = []
        for _ in range(rng.randrange(1, 4)):
            kind = rng.choice(["if", "for", "with", "def", "class", "try", "bool", "comp", "assert"]) if depth else "pass"
            if kind in ("if", "for", "with", "def", "class"):
                head = {"if": "if a:", "for": "for i in a:", "with": "with a:", "class": f"class C{next(names)}:"}.get(
                    kind, f"def f{next(names)}(x=[i for i in y]):")
                lines += [pad + head, *block(depth - 1, pad + " ")]
            elif kind == "try":
                lines += [pad + "try:", *block(depth - 1, pad + " "), pad + "except E:", pad + " pass"]
            else:
                lines.append(pad + {"bool": "a = b and (c or d or e)", "comp": "a = {i for i in b if c}", "assert": "assert a"}.get(kind, "pass"))
        return lines

    return "\n".join(block(5, ""))


def test_random_modules_match_a_direct_walk(spark, files):
    rng = random.Random(11)
    codes = [random_module(rng) for _ in range(60)]
    df = files([("p", f"{i}.py", c) for i, c in enumerate(codes)])
    got = {}
    for f in syntax.function_complexity(syntax.python_nodes(df)).collect():
        got.setdefault(int(f.path[:-3]), {})[f.name] = f.complexity
    metrics = {int(m.filepath[:-3]): m for m in file_metrics(df).collect()}
    for i, code in enumerate(codes):
        want = by_hand(ast.parse(code))
        assert got.get(i, {}) == want
        mean = sum(want.values()) / len(want) if want else 0
        assert metrics[i].complexity == pytest.approx(mean)
        assert metrics[i].functions == len(want)


def test_a_sample_module(spark, files):
    code = (
        '"""Sample."""\n\n\ndef climb(n):\n    """Doc."""\n    if n <= 0:\n        return 0\n    elif n == 1:\n        return 1\n'
        "    else:\n        return climb(n - 1)\n\n\ndef twice(items):\n    seen = set()\n    for x in items:\n        if x in seen:\n"
        '            pass\n    return seen\n\n\nif __name__ == "__main__":\n    print(climb(3))\n    print(twice([1]))\n'
    )
    m = file_metrics(files([("p", "s.py", code)])).first()
    assert (m.functions, m.classes, m.complexity) == (2, 0, 3.0)
    assert m.lines_total == code.count("\n") + 1


def test_maintainability_bounds(spark, files):
    rows = [("p", "empty.py", "# only\n"), ("p", "bad.py", "def (\n"), ("p", "one.py", "x = 1"), ("p", "big.py", "x = 1\n" * 5000)]
    got = {m.filepath: (m.complexity, m.maintainability) for m in file_metrics(files(rows)).collect()}
    import math

    one = round((171 - 21.4 * math.log(2) - 0.23) * 100 / 171, 1)
    assert got == {"empty.py": (0.0, 100.0), "bad.py": (0.0, 0.0), "one.py": (0.0, one), "big.py": (0.0, 0.0)}


def test_node_rows_leave_by_the_part():
    """A batch of many files is not gathered whole before its rows leave."""
    pa = pytest.importorskip("pyarrow")
    code = "def f(a=[]):\n    if a: pass\n"
    texts = [code] * 3000 + [None, "def (\n"]
    batch = pa.RecordBatch.from_pydict(
        {"project": ["p"] * len(texts), "path": [str(k) for k in range(len(texts))], "n": list(range(len(texts))), "content": texts}
    )
    parts = list(syntax._parser(("n",))(iter([batch])))
    assert len(parts) > 3 and max(p.num_rows for p in parts) <= syntax.PART_ROWS + 3
    rows = [r for p in parts for r in p.to_pylist()]
    assert [r["kind"] for r in rows if r["path"] in ("7", "3000", "3001")] == ["module", "function", "decision", "skipped", "error"]
    assert all(str(r["n"]) == r["path"] for r in rows) and len(rows) == 9002
