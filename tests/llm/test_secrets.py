import hashlib
import re

from lineglass.llm import secrets
from tests.llm import helpers as h

ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
# Made by rule, so that no line here looks like a credential.
DIGEST = "0a1b2c3d" * 5
NAME = "AKIA" + "Q7" * 8
PARTS = [
    'token = "' + DIGEST + '"', "Secret=token: abcdefgh", "password: short", "PASSWD='abc'", "api_key==" + "x9" * 5,
    NAME, NAME[:19], "x" + NAME + "z", DIGEST, DIGEST[:23], "\U0001f600 token:" + "k" * 6, "tokens = abcdef", "apikey \t= abcdef",
    "Zz9" * 9, "--" + "aB3" * 8,
]


def brute(text):
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{kind}:{start}:{end}" for start, _, end, kind in sorted(spans)]


def test_base_spans_equal_brute_force(spark):
    import random

    r = random.Random(4)
    texts = [" ".join(r.choice([*PARTS, h.prose(k, 5), "é\n"]) for _ in range(r.randint(1, 9))) for k in range(150)]
    texts += [*PARTS, "", None, DIGEST * 400]
    for row in secrets.digests(h.documents(spark, texts)).collect():
        want = brute(texts[row.doc_id] or "")
        assert row.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [s for s in row.spans.split(",") if s and not s.startswith("owner")] == want
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(
            sum(s.startswith(k) for s in want) for k in ("assign", "access", "hex")
        )


def test_owners_tell_examples_from_live_values(spark):
    copied, own = "Copied1" * 4, "Owned2" * 5
    texts = ["see " + copied] * 6 + ["see " + own, "again " + own.lower()[:5]]
    rows = {r.doc_id: r for r in secrets.digests(h.documents(spark, texts)).collect()}
    assert all(rows[k].spans == "" for k in range(6))  # three sources have it
    assert rows[6].spans == f"owner:4:{4 + len(own)}" and rows[6].n_live == 1
    assert rows[7].spans == ""


def test_plan_is_native(spark):
    plan = secrets.digests(h.documents(spark, PARTS))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_odd_rows(spark):
    odd = h.odd(spark).unionByName(h.documents(spark, [PARTS[0]] * 3, ids=[8, 8, None]))
    rows = secrets.digests(odd).collect()
    assert len(rows) == 13
    assert sum(r.n_hex == 1 and r.n_assign == 1 for r in rows) == 3
    assert secrets.digests(h.odd(spark).limit(0)).collect() == []
