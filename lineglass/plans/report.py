"""Reports of many projects in one job.

Each section is a small table ``(project, section, position, text)``; a report is
its project's rows joined in order.  Only ranked and therefore bounded rows are
ever collected per project.  The JSON form holds every finding, so it is made as
ordered fragments instead of one value.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineglass.functions import vocabulary as v
from lineglass.functions.text import base_name, fixed_decimals, thousands
from lineglass.operators import rollups

HEADER, SEVERITIES, CATEGORIES, ANSWER, CRITICAL, WARNINGS, METRICS, FOOTER = range(1, 9)
LAST = 1000


def project_summary(totals: DataFrame, findings: DataFrame | None, answers: DataFrame | None = None) -> DataFrame:
    """One row per project with everything a report says outside its lists.

    Findings are read once: counted per category first, then folded per project,
    so the second step only sees a handful of rows for each.  Without findings their
    counts are zero: enough for the sections that do not speak of them.
    """
    if findings is None:
        joined = totals.selectExpr("*", *[f"0L AS {s}" for s in v.SEVERITIES], "array() AS categories")
        return _with_answers(joined, answers)
    by_category = findings.groupBy("project", "category").agg(
        F.count("*").alias("n"),
        F.min(F.struct("file", "ord")).alias("first"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in v.SEVERITIES],
    )
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "first", "category", "n")))
    counts = by_category.groupBy("project").agg(
        *[F.sum(s).alias(s) for s in v.SEVERITIES], ranked.alias("categories")
    )
    return _with_answers(totals.join(counts, "project", "left"), answers).fillna(0, v.SEVERITIES)


def _with_answers(summary: DataFrame, answers: DataFrame | None) -> DataFrame:
    if answers is not None:
        return summary.join(answers.select("project", "ai_summary", "ai_suggestions"), "project", "left")
    return summary.selectExpr("*", "'' AS ai_summary", "cast(array() AS array<string>) AS ai_suggestions")


def _text(*lines) -> Column:
    return F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines])


def _count(name: str) -> Column:
    return F.col(name).cast("string")


def header_text(timestamp: str) -> Column:
    return _text(
        "# Code Review Report", "",
        F.concat(F.lit("**Project:** `"), F.col("project"), F.lit("`")),
        f"**Date:** {timestamp}",
        F.concat(F.lit("**Files Analyzed:** "), _count("files_analyzed")),
        F.concat(F.lit("**Total Lines:** "), thousands(F.col("total_lines"))),
        "", "---", "",
    )


def severity_text() -> Column:
    rows = [F.concat(F.lit(f"| {v.SEVERITY_MARKERS[s]} {s.title()} | "), _count(s), F.lit(" |")) for s in v.SEVERITIES]
    return _text("## Summary", "", "| Severity | Count |", "|----------|-------|", *rows, "")


def category_text() -> Column:
    items = F.transform(
        "categories", lambda x: F.concat(F.lit("- **"), x["category"], F.lit("**: "), x["n"].cast("string"))
    )
    return F.when(F.size("categories") > 0, _text("### By Category", "", F.array_join(items, "\n"), ""))


def answer_text() -> Column:
    items = F.array_join(F.transform("ai_suggestions", lambda x: F.concat(F.lit("- "), x)), "\n")
    listed = F.when(F.size("ai_suggestions") > 0, _text("### Suggestions", items, ""))
    return F.when(F.col("ai_summary") != "", _text("## AI Review", "", F.col("ai_summary"), "", listed))


def warning_head() -> Column:
    found = F.concat(F.lit("Found "), _count("warning"), F.lit(" warnings:"))
    return F.when(F.col("warning") > 0, _text("## Warnings", "", found, ""))


def warning_tail() -> Column:
    more = F.concat(F.lit("- ... and "), (F.col("warning") - v.TOP_WARNINGS).cast("string"), F.lit(" more"))
    return F.when(F.col("warning") > 0, _text(F.when(F.col("warning") > v.TOP_WARNINGS, more), ""))


def overview_sections(summary: DataFrame, timestamp: str, only: int | None = None) -> DataFrame:
    """Everything but the lists, from one pass over the project rows; ``only`` asks for one section."""
    pieces = [
        (HEADER, 0, header_text(timestamp)),
        (SEVERITIES, 0, severity_text()),
        (CATEGORIES, 0, category_text()),
        (ANSWER, 0, answer_text()),
        (CRITICAL, 0, F.when(F.col("critical") + F.col("error") > 0, _text("## Critical & Error Issues", ""))),
        (WARNINGS, 0, warning_head()),
        (WARNINGS, LAST, warning_tail()),
        (METRICS, 0, _text(
            "## Code Metrics", "", "| File | Lines | Complexity | Maintainability |",
            "|------|-------|------------|-----------------|")),
        (METRICS, LAST, F.lit("")),
        (FOOTER, 0, _text("---", "*Generated by lineglass*")),
    ]
    rows = F.array(
        *[F.struct(F.lit(n).alias("section"), F.lit(at).alias("position"), t.alias("text")) for n, at, t in pieces if only in (None, n)]
    )
    return summary.select("project", F.inline(rows)).filter(F.col("text").isNotNull())


def finding_lists(findings: DataFrame) -> DataFrame:
    """The first critical/error findings and the first warnings, ranked in one pass."""
    severe = F.col("severity").isin("critical", "error")
    listed = findings.filter(severe | (F.col("severity") == "warning")).withColumn(
        "section", F.when(severe, CRITICAL).otherwise(WARNINGS)
    )
    order = Window.partitionBy("project", "section").orderBy("file", "ord")
    top = listed.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= v.TOP_CRITICAL)
    shown = (F.col("code_snippet") != "") & (F.col("code_snippet") != v.REDACTED)
    name, line = base_name(F.col("file")), _count("line")
    long = _text(
        F.concat(F.lit("### `"), name, F.lit("` line "), line),
        F.concat(F.lit("**["), F.upper("severity"), F.lit("]** "), F.col("rule"), F.lit(": "), F.col("message")),
        F.when(shown, F.concat(F.lit("```\n"), F.col("code_snippet"), F.lit("\n```"))),
        F.when(F.col("suggestion") != "", F.concat(F.lit("> 💡 "), F.col("suggestion"))),
        "",
    )
    short = F.concat(F.lit("- **"), name, F.lit(":"), line, F.lit("** - "), F.col("message"))
    return top.filter((F.col("section") == CRITICAL) | (F.col("position") <= v.TOP_WARNINGS)).select(
        "project", "section", "position", F.when(F.col("section") == CRITICAL, long).otherwise(short).alias("text")
    )


def file_list(metrics: DataFrame) -> DataFrame:
    """The most complex files as table rows."""
    text = F.concat(
        F.lit("| "), F.col("name"), F.lit(" | "), _count("lines_code"),
        F.lit(" | "), fixed_decimals(F.col("complexity"), 1),
        F.lit(" | "), fixed_decimals(F.col("maintainability"), 0), F.lit("% |"),
    )
    return rollups.top_complex_files(metrics).select(
        "project", F.lit(METRICS).alias("section"), F.col("rank").alias("position"), text.alias("text")
    )


def report_sections(totals, findings, metrics, timestamp: str, answers=None) -> DataFrame:
    summary = project_summary(totals, findings, answers)
    lists = finding_lists(findings).unionByName(file_list(metrics))
    return overview_sections(summary, timestamp).unionByName(lists)


def markdown_reports(totals, findings, metrics, timestamp: str, answers=None) -> DataFrame:
    """One row ``(project, report)`` per project."""
    sections = report_sections(totals, findings, metrics, timestamp, answers)
    ordered = F.sort_array(F.collect_list(F.struct("section", "position", "text")))
    return sections.groupBy("project").agg(
        F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("report")
    )


# The rewrites from Markdown to HTML, in order.  Inline code comes
# before fences, so a fenced snippet ends up as <code> between backticks.
HTML_REWRITES = [
    (r"(?dm)^# (.+)$", "<h1>$1</h1>"),
    (r"(?dm)^## (.+)$", "<h2>$1</h2>"),
    (r"(?dm)^### (.+)$", "<h3>$1</h3>"),
    (r"(?d)\*\*(.+?)\*\*", "<strong>$1</strong>"),
    (r"`([^`]+)`", "<code>$1</code>"),
    (r"(?dm)^- (.+)$", "<li>$1</li>"),
    (r"(?dm)^> (.+)$", "<blockquote>$1</blockquote>"),
    (r"```\n?([^`]+)```", "<pre>$1</pre>"),
    (r"(?dm)^---$", "<hr>"),
]

PAGE_HEAD = """<!DOCTYPE html>
<html>
<head>
<meta charset="UTF-8">
<title>Code Review Report</title>
<style>
body { font: 16px/1.5 sans-serif; max-width: 60rem; margin: 2rem auto; color: #222; }
h1, h2 { border-bottom: 1px solid #bbb; }
code, pre { background: #eee; font-family: monospace; }
blockquote { border-left: 3px solid #6a6; margin-left: 0; padding-left: 1rem; }
</style>
</head>
<body>
<p>"""
PAGE_TAIL = "</p>\n</body>\n</html>"


def html_reports(markdown: DataFrame) -> DataFrame:
    """Markdown reports as self-contained pages.

    Snippets are untrusted text: ``&`` and ``<`` are escaped before the rewrites,
    so nothing in a reviewed file can open a tag.
    """
    html = F.replace(F.replace(F.col("report"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    for pattern, becomes in HTML_REWRITES:
        html = F.regexp_replace(html, F.lit(pattern), F.lit(becomes))
    html = F.replace(html, F.lit("\n\n"), F.lit("</p><p>"))
    return markdown.select("project", F.concat(F.lit(PAGE_HEAD), html, F.lit(PAGE_TAIL)).alias("report"))


JSON_OPTIONS = {"writeNonAsciiCharacterAsCodePoint": "true", "ignoreNullFields": "false"}
_ISSUE = ["file", "line", "column", "severity", "category", "rule", "message", "suggestion", "code_snippet"]
_METRIC = [
    "filepath", "lines_total", "lines_code", "lines_comment", "lines_blank",
    "functions", "classes", "complexity", "maintainability",
]


def _json(*columns) -> Column:
    return F.to_json(F.struct(*columns), JSON_OPTIONS)


def _elements(rows: DataFrame, section: int, key: list[str], fields: list[str]) -> DataFrame:
    """Array elements of one project; every one but the first starts with a comma.

    Elements that are equal in all their text are one row that repeats them, so that only
    one element of a project can be the first.
    """
    order = F.col(key[1]) if len(key) > 1 else F.lit(0)
    place = ["project", "file", "ord", "text"]
    same = rows.select("project", F.col(key[0]).alias("file"), order.cast("bigint").alias("ord"), _json(*fields).alias("text"))
    once = same.groupBy(*place).agg(F.count("*").cast("int").alias("n"))
    first = once.groupBy("project").agg(F.min(F.struct("file", "ord", "text")).alias("first"))
    text = F.array_join(F.array_repeat("text", F.col("n")), ",")
    comma = F.when(F.struct("file", "ord", "text") == F.col("first"), "").otherwise(",")
    return once.join(first, "project").select(
        "project", F.lit(section).alias("section"), "file", "ord", F.concat(comma, text).alias("text")
    )


def json_fragments(totals, findings, metrics, timestamp: str, answers=None) -> DataFrame:
    """The JSON reports as rows ``(project, section, file, ord, text)``.

    A project's texts in the order of (section, file, ord) are its JSON document.
    Meant for stored findings and metrics, which are read more than once.
    """
    if answers is not None:
        joined = totals.join(answers, "project", "left")
    else:
        joined = totals.withColumn("ai_summary", F.lit("")).withColumn(
            "ai_suggestions", F.array().cast("array<string>")
        )
    summary = F.coalesce("ai_summary", F.lit("")).alias("ai_summary")
    suggestions = F.coalesce("ai_suggestions", F.array().cast("array<string>")).alias("ai_suggestions")
    head = _json(F.col("project").alias("project_path"), F.lit(timestamp).alias("timestamp"), "files_analyzed", "total_lines")
    tail = _json(summary, suggestions)
    frame = [
        (1, F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"issues":['))),
        (3, F.lit('],"metrics":[')),
        (5, F.concat(F.lit("],"), F.substring(tail, F.lit(2), F.length(tail)))),
    ]
    pieces = F.array(*[F.struct(F.lit(n).alias("section"), text.alias("text")) for n, text in frame])
    around = joined.select("project", F.inline(pieces)).select(
        "project", "section", F.lit("").alias("file"), F.lit(0).cast("bigint").alias("ord"), "text"
    )
    return (
        around.unionByName(_elements(findings, 2, ["file", "ord"], _ISSUE))
        .unionByName(_elements(metrics, 4, ["filepath"], _METRIC))
    )
