"""Review prompts, request bodies, and the parsing of answers, as table operations."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineglass.functions import vocabulary as v
from lineglass.functions.text import strip

# The review prompt and its truncation note.
PROMPT_HEAD = (
    "Review this {language} code for bugs, security issues, and improvements.\n"
    "Be concise and specific. Focus on the most important issues.\n\n"
    "File: {filename}\n\n```{language}\n"
)
PROMPT_TAIL = (
    "\n```\n\nFormat your response as:\nSUMMARY: [1-2 sentence overview]\n\n"
    "ISSUES:\n- [Specific issue with line reference if possible]\n\n"
    "SUGGESTIONS:\n- [Actionable improvement suggestion]"
)
TRUNCATION_NOTE = "\n\n... [truncated]"


def default_model(provider: Column) -> Column:
    """Model used for a provider when none is named."""
    table = F.create_map(*[F.lit(x) for pair in v.DEFAULT_MODELS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, provider), F.lit(v.DEFAULT_MODELS["openai"]))


def review_prompt(content: Column, language: Column, path: Column) -> Column:
    shown = F.when(
        F.length(content) > v.PROMPT_CODE_LIMIT,
        F.concat(F.substring(content, 1, v.PROMPT_CODE_LIMIT), F.lit(TRUNCATION_NOTE)),
    ).otherwise(content)
    slots = {"language": language, "filename": path}
    pieces = [slots.get(p, F.lit(p)) for p in re.split(r"\{(language|filename)\}", PROMPT_HEAD)]
    return F.concat(*pieces, shown, F.lit(PROMPT_TAIL))


def request_body(provider: Column, model: Column, prompt: Column) -> Column:
    """The JSON body a caller would send for one prompt."""
    model = F.coalesce(model, default_model(provider)).alias("model")
    limit = F.lit(v.ANSWER_TOKEN_LIMIT).alias("max_tokens")
    messages = F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))).alias("messages")
    return (
        F.when(provider == "anthropic", F.to_json(F.struct(model, limit, messages)))
        .when(provider == "openai", F.to_json(F.struct(model, messages, limit)))
        .when(provider == "ollama", F.to_json(F.struct(model, prompt.alias("prompt"), F.lit(False).alias("stream"))))
    )


def answer_summary(text: Column) -> Column:
    """What stands between the first ``SUMMARY:`` and the first ``ISSUES:``, cut to its limit."""
    start = F.locate("SUMMARY:", text) + len("SUMMARY:")
    issues = F.locate("ISSUES:", text)
    end = F.when(issues > 0, issues - 1).otherwise(F.length(text))
    part = strip(F.substring(text, start, F.greatest(end - start + 1, F.lit(0))))
    return F.substring(F.when(F.contains(text, F.lit("SUMMARY:")), part).otherwise(text), 1, v.SUMMARY_LIMIT)


def answer_suggestions(text: Column) -> Column:
    """The lines after the first ``SUGGESTIONS:``, without bullets, at most the first ten."""
    after = F.substring(text, F.locate("SUGGESTIONS:", text) + len("SUGGESTIONS:"), F.length(text))
    lines = F.transform(F.split(after, "\n"), strip)
    bulleted = lambda x: F.startswith(x, F.lit("- "))
    heading = lambda x: F.startswith(x, F.lit("SUMMARY")) | F.startswith(x, F.lit("ISSUES"))
    kept = F.filter(lines, lambda x: bulleted(x) | ((x != "") & ~heading(x)))
    clean = F.transform(kept, lambda x: F.when(bulleted(x), F.substring(x, F.lit(3), F.length(x))).otherwise(x))
    none = F.array().cast("array<string>")
    return F.when(F.contains(text, F.lit("SUGGESTIONS:")), F.slice(clean, 1, v.SUGGESTION_LIMIT)).otherwise(none)


def parse_answers(answers: DataFrame) -> DataFrame:
    """Add ``summary`` and ``suggestions`` to a table with an answer ``text``."""
    return answers.withColumn("summary", answer_summary(F.col("text"))).withColumn(
        "suggestions", answer_suggestions(F.col("text"))
    )


def first_summary(answers: DataFrame) -> DataFrame:
    """Per project the answer of the first file (by ``ord``) whose summary is not empty."""
    return (
        answers.filter(F.col("summary") != "")
        .groupBy("project")
        .agg(F.min_by(F.struct("summary", "suggestions"), F.col("ord")).alias("a"))
        .select("project", F.col("a.summary").alias("ai_summary"), F.col("a.suggestions").alias("ai_suggestions"))
    )
