import json

import pytest
from pyspark.sql import functions as F

from lineglass.operators import answers as a
from lineglass.sources.answers import answer_text


def parsed(spark, text):
    row = a.parse_answers(spark.createDataFrame([(text,)], "text string")).first()
    return row.summary, row.suggestions


LONG = "x" * 501


@pytest.mark.parametrize(
    "text, summary, suggestions",
    [
        ("SUMMARY: fine\n\nISSUES:\n- a\n\nSUGGESTIONS:\n- b\n- c", "fine", ["b", "c"]),
        ("nothing marked", "nothing marked", []),
        ("ISSUES: a\nSUMMARY: late", "", []),
        ("SUMMARY: no list\nSUGGESTIONS:\n- b", "no list\nSUGGESTIONS:\n- b", ["b"]),
        ("SUMMARY: " + LONG + "ISSUES:", LONG[:500], []),
        (LONG, LONG[:500], []),
        ("SUGGESTIONS:\n" + "\n".join(f"- {i}" for i in range(11)), None, [str(i) for i in range(10)]),
        ("SUGGESTIONS:\n-\n\n plain \nSUMMARY x\nISSUES y\n- SUMMARY kept\n-  two", None, ["-", "plain", "SUMMARY kept", " two"]),
        ("SUGGESTIONS: same line\n- next", None, ["same line", "next"]),
        ("", "", []),
    ],
)
def test_parse(spark, text, summary, suggestions):
    got = parsed(spark, text)
    assert got[1] == suggestions
    assert got[0] == (text[:500] if summary is None else summary)


def test_first_non_empty_summary_speaks_for_the_project(spark):
    rows = [("p", 3, "c", ["z"]), ("p", 1, "", ["x"]), ("p", 2, "b", ["y"]), ("q", 1, "", [])]
    df = spark.createDataFrame(rows, "project string, ord int, summary string, suggestions array<string>")
    assert [tuple(r) for r in a.first_summary(df).collect()] == [("p", "b", ["y"])]


def test_prompt_is_cut_at_its_limit(spark):
    df = spark.createDataFrame([("x" * 12000, "f.py"), ("x" * 12001, "g.py")], "content string, path string")
    short, long = [r[0] for r in df.select(a.review_prompt(F.col("content"), F.lit("python"), F.col("path"))).collect()]
    assert "truncated" not in short and "File: f.py\n\n```python\nxxx" in short and short.endswith("improvement suggestion]")
    assert "x" * 12000 + "\n\n... [truncated]\n```" in long and "x" * 12001 not in long


@pytest.mark.parametrize(
    "provider, model, want",
    [
        ("anthropic", None, {"model": "claude-3-haiku-20240307", "max_tokens": 1500, "messages": [{"role": "user", "content": 'a"b'}]}),
        ("openai", "m", {"model": "m", "messages": [{"role": "user", "content": 'a"b'}], "max_tokens": 1500}),
        ("ollama", None, {"model": "llama3", "prompt": 'a"b', "stream": False}),
    ],
)
def test_request_bodies(spark, provider, model, want):
    body = a.request_body(F.lit(provider), F.lit(model).cast("string"), F.lit('a"b'))
    assert json.loads(spark.range(1).select(body).first()[0]) == want


def test_envelopes(spark):
    rows = [
        (1, "anthropic", json.dumps({"content": [{"text": "A\né"}]})),
        (2, "openai", json.dumps({"choices": [{"message": {"content": "B"}}]})),
        (3, "ollama", json.dumps({"response": "C"})),
        (4, "ollama", "{}"),
    ]
    got = answer_text(spark.createDataFrame(rows, "response_id int, provider string, body string"))
    assert [r.text for r in got.orderBy("response_id").collect()] == ["A\né", "B", "C", ""]
