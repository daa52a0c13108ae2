"""Report, sink, follow-up and streaming queries."""

from pyspark.sql import functions as F

from checks import corpora as c
from checks import sql as s
from checks.registry import (
    FIELD_COLUMNS, FIELDS, ORACLES, QUERIES, STAMP, bigint, query, reviewed, stored,
)
from lineglass.functions import rules as r
from lineglass.functions import vocabulary as v
from lineglass.operators import lines, rollups, scan
from lineglass.plans import followup, report
from lineglass.session import fresh_path
from lineglass.sources import sinks
from lineglass.streaming import arrivals

NL = s.NL
NOTES = ["Rename the helper.", "Add a test."]


def block(*parts: str) -> str:
    return f" || {NL} || ".join(parts)


TOTALS = "SELECT project, count(*) AS files, CAST(sum(lines_total) AS BIGINT) AS total FROM metrics GROUP BY project"
SEV = "SELECT p.project, " + ", ".join(
    f"count(*) FILTER (f.severity = '{x}') AS {x}" for x in v.SEVERITIES
) + " FROM totals p LEFT JOIN findings f USING (project) GROUP BY ALL"
RANKED = """SELECT project, category, n, row_number() OVER (PARTITION BY project ORDER BY n DESC, file, ord) AS rank FROM (
    SELECT project, category, file, ord, count(*) OVER (PARTITION BY project, category) AS n,
      row_number() OVER (PARTITION BY project, category ORDER BY file, ord) AS k FROM findings) WHERE k = 1"""
CRIT = "SELECT *, row_number() OVER (PARTITION BY project ORDER BY file, ord) AS rank FROM findings WHERE severity IN ('critical', 'error') QUALIFY rank <= 30"
WARN = "SELECT *, row_number() OVER (PARTITION BY project ORDER BY file, ord) AS rank FROM findings WHERE severity = 'warning' QUALIFY rank <= 20"
OVER = "SELECT project, count(*) AS warnings, greatest(count(*) - 20, 0) AS unlisted FROM findings WHERE severity = 'warning' GROUP BY project"
FILES = f"""SELECT *, left({s.base_name('filepath')}, 30) AS name, row_number() OVER (PARTITION BY project ORDER BY complexity DESC, filepath) AS rank
    FROM metrics QUALIFY rank <= 15"""

empty = "''"
SECTIONS = {
    "report_header": f"""SELECT project, 1 AS section, 0 AS position, {block(s.q('# Code Review Report'), empty, "'**Project:** `' || project || '`'",
        s.q('**Date:** ' + STAMP), "'**Files Analyzed:** ' || files", "'**Total Lines:** ' || format('{:,}', total)", empty, "'---'", empty)} AS text FROM totals""",
    "report_severity_table": f"""SELECT project, 2 AS section, 0 AS position, {block("'## Summary'", empty, "'| Severity | Count |'", "'|----------|-------|'",
        *[f"'| {v.SEVERITY_MARKERS[x]} {x.title()} | ' || {x} || ' |'" for x in v.SEVERITIES], empty)} AS text FROM sev""",
    "report_category_list": f"""SELECT project, 3 AS section, 0 AS position, {block("'### By Category'", empty)} || {NL}
        || string_agg('- **' || category || '**: ' || n, {NL} ORDER BY rank) || {NL} AS text FROM ranked GROUP BY project""",
    "report_ai": f"""SELECT project, 4 AS section, 0 AS position, {block("'## AI Review'", empty, "project || ' is fine.'", empty, "'### Suggestions'",
        *[s.q('- ' + x) for x in NOTES], empty)} AS text FROM totals""",
    "report_critical": f"""SELECT project, 5 AS section, 0 AS position, {block("'## Critical & Error Issues'", empty)} AS text FROM crit WHERE rank = 1
        UNION ALL SELECT project, 5, rank, '### `' || {s.base_name('file')} || '` line ' || line || {NL} || '**[' || upper(severity) || ']** ' || rule || ': ' || message || {NL}
          || CASE WHEN code_snippet NOT IN ('', '[REDACTED]') THEN '```' || {NL} || code_snippet || {NL} || '```' || {NL} ELSE '' END
          || CASE WHEN suggestion <> '' THEN '> 💡 ' || suggestion || {NL} ELSE '' END FROM crit""",
    "report_warnings": f"""SELECT project, 6 AS section, 0 AS position, {block("'## Warnings'", empty, "'Found ' || warnings || ' warnings:'", empty)} AS text FROM overs
        UNION ALL SELECT project, 6, rank, '- **' || {s.base_name('file')} || ':' || line || '** - ' || message FROM warn
        UNION ALL SELECT project, 6, 1000, CASE WHEN unlisted > 0 THEN '- ... and ' || unlisted || ' more' || {NL} ELSE '' END FROM overs""",
    "report_metrics": f"""SELECT project, 7 AS section, 0 AS position, {block("'## Code Metrics'", empty, "'| File | Lines | Complexity | Maintainability |'", "'|------|-------|------------|-----------------|'")} AS text FROM totals
        UNION ALL SELECT project, 7, rank, '| ' || name || ' | ' || lines_code || ' | ' || format('{{:.1f}}', complexity) || ' | ' || format('{{:.0f}}', maintainability) || '% |' FROM tops
        UNION ALL SELECT project, 7, 1000, '' FROM totals""",
    "report_footer": f"""SELECT project, 8 AS section, 0 AS position, {block("'---'", "'*Generated by lineglass*'")} AS text FROM totals""",
}
STEPS = dict(totals=TOTALS, sev=SEV, ranked=RANKED, crit=CRIT, warn=WARN, overs=OVER, tops=FILES)
STEPS["sections"] = "\nUNION ALL\n".join(f"SELECT * FROM ({x})" for x in SECTIONS.values())
MARKDOWN = s.review("SELECT project, string_agg(text, chr(10) ORDER BY section, position, text) AS report FROM sections GROUP BY project", **STEPS)


def with_answers(x):
    """Add an answer for every project to a review."""
    x.answers = x.totals.select(
        "project", F.concat("project", F.lit(" is fine.")).alias("ai_summary"),
        F.array(*[F.lit(n) for n in NOTES]).alias("ai_suggestions"))
    return x


PARTS = {
    "report_header": report.HEADER, "report_severity_table": report.SEVERITIES, "report_category_list": report.CATEGORIES,
    "report_ai": report.ANSWER, "report_critical": report.CRITICAL, "report_warnings": report.WARNINGS, "report_metrics": report.METRICS,
}
for _name, _section in PARTS.items():
    def _part(spark, sf, section=_section):
        x = with_answers(reviewed(spark, sf))
        about_findings = section in (report.SEVERITIES, report.CATEGORIES, report.CRITICAL, report.WARNINGS)
        answers = x.answers if section == report.ANSWER else None
        summary = report.project_summary(x.totals, x.findings if about_findings else None, answers)
        parts = report.overview_sections(summary, STAMP, section)
        if section in (report.CRITICAL, report.WARNINGS):
            parts = parts.unionByName(report.finding_lists(x.findings))
        if section == report.METRICS:
            parts = parts.unionByName(report.file_list(x.metrics))
        return parts.filter(F.col("section") == section).select("project", *bigint("section", "position"), "text")

    QUERIES[_name] = _part
    ORACLES[_name] = s.review(
        f"SELECT project, CAST(section AS BIGINT) AS section, CAST(position AS BIGINT) AS position, text FROM ({SECTIONS[_name]})",
        **{k: q for k, q in STEPS.items() if k != "sections"})


@query("report_markdown", MARKDOWN)
def report_markdown(spark, sf):
    return with_answers(stored(spark, sf)).markdown(STAMP)


def html_sql() -> str:
    html = "replace(replace(report, '&', '&amp;'), '<', '&lt;')"
    for pattern, becomes in report.HTML_REWRITES:
        flag = "(?m)" if "m)" in pattern[:5] else ""
        body = pattern.split(")", 1)[1] if pattern.startswith("(?") else pattern
        html = f"regexp_replace({html}, {s.q(flag + body)}, {s.q(becomes.replace('$1', chr(92) + '1'))}, 'g')"
    return f"{s.q(report.PAGE_HEAD)} || replace({html}, {NL} || {NL}, '</p><p>') || {s.q(report.PAGE_TAIL)}"


@query("report_html", s.with_(f"SELECT project, {html_sql()} AS report FROM md", md=MARKDOWN))
def report_html(spark, sf):
    return with_answers(stored(spark, sf)).html(STAMP)


@query("report_json", s.review(
    f"""SELECT project, file, line, "column", severity, category, rule, message, suggestion, code_snippet, -1 AS lines_code, -1.0::DOUBLE AS complexity FROM findings
    UNION ALL SELECT project, filepath, -1, -1, '', '', '', '', '', '', CAST(lines_code AS INTEGER), round(complexity, 6) FROM metrics"""))
def report_json(spark, sf):
    """The JSON fragments, parsed again: one row per finding and per file."""
    rows = stored(spark, sf).json(STAMP).filter(F.col("section").isin(2, 4))
    schema = ("file:string,filepath:string,line:int,`column`:int,severity:string,category:string,rule:string,message:string,"
              "suggestion:string,code_snippet:string,lines_code:int,complexity:double")
    x = rows.select("project", F.from_json(F.concat(F.lit("["), F.regexp_replace("text", "^,", ""), F.lit("]")), f"array<struct<{schema}>>").alias("x"))
    x = x.select("project", F.inline("x"))
    text = [F.coalesce(k, F.lit("")).alias(k) for k in ("severity", "category", "rule", "message", "suggestion", "code_snippet")]
    number = [F.coalesce(k, F.lit(-1)).alias(k) for k in ("line", "column", "lines_code")]
    return x.select("project", F.coalesce("file", "filepath").alias("file"), *text, *number,
                    F.round(F.coalesce("complexity", F.lit(-1.0)), 6).alias("complexity"))


@query("report_json_frame", s.review(
    """SELECT project, CAST(files AS BIGINT) AS files_analyzed, total AS total_lines, project || ' is fine.' AS ai_summary, 2 AS suggestions FROM totals""", totals=TOTALS))
def report_json_frame(spark, sf):
    """The opening and closing fragments of each document, joined to an empty document and parsed."""
    rows = with_answers(stored(spark, sf)).json(STAMP).filter(F.col("section").isin(1, 3, 5))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section", "text"))), lambda x: x["text"]), "")
    doc = F.from_json("text", "project_path string, files_analyzed bigint, total_lines bigint, ai_summary string, ai_suggestions array<string>")
    return rows.groupBy("project").agg(text.alias("text")).select(doc.alias("d")).select(
        F.col("d.project_path").alias("project"), "d.files_analyzed", "d.total_lines", "d.ai_summary", F.size("d.ai_suggestions").alias("suggestions"))


for _name, _kind in (("sink_markdown", "markdown"), ("sink_html", "html")):
    def _sink(spark, sf, kind=_kind):
        """Written as text, one folder per project, and read back line by line."""
        path = fresh_path(spark, kind)
        x = with_answers(stored(spark, sf))
        sinks.write_reports(x.markdown(STAMP) if kind == "markdown" else x.html(STAMP), path)
        back = spark.read.text(path)
        return back.groupBy("project", F.col("value").alias("line")).agg(F.count("*").alias("n"))

    QUERIES[_name] = _sink
    _report = MARKDOWN if _kind == "markdown" else ORACLES["report_html"]
    ORACLES[_name] = s.with_(
        f"SELECT project, line, count(*) AS n FROM (SELECT project, unnest(string_split(report, {NL})) AS line FROM reports) GROUP BY ALL", reports=_report)


@query("sink_json", s.review("SELECT f.project, f.issues, m.files FROM (SELECT project, count(*) AS issues FROM findings GROUP BY 1) f JOIN (SELECT project, count(*) AS files FROM metrics GROUP BY 1) m USING (project)"))
def sink_json(spark, sf):
    """Fragments written in order; the stored rows counted by kind."""
    path = fresh_path(spark, "json")
    sinks.write_json_fragments(stored(spark, sf).json(STAMP), path)
    back = spark.read.text(path)
    return back.groupBy("project").agg(
        F.count_if(F.col("value").rlike('^,?\\{"file":')).alias("issues"), F.count_if(F.col("value").rlike('^,?\\{"filepath":')).alias("files"))


@query("sink_parquet", s.review(f"SELECT {FIELDS} FROM findings"))
def sink_parquet(spark, sf):
    stored = sinks.write_table(reviewed(spark, sf).findings, fresh_path(spark, "findings"), "severity")
    return stored.select(*FIELD_COLUMNS)


# ---- follow-ups ----------------------------------------------------------


@query("changed_files", s.with_("SELECT project, path FROM files WHERE length(content) % 3 = 0", files=s.plain_files("python")))
def changed_files(spark, sf):
    """The previous run saw another text wherever the length is a multiple of three."""
    files = c.plain_files(spark, sf, "python")
    old = F.when(F.length("content") % 3 == 0, F.concat("content", F.lit("old"))).otherwise(F.col("content"))
    before = followup.content_hashes(files.withColumn("content", old))
    return followup.changed_files(files, before).select("project", "path")


@query("release_gate", s.review(
    """SELECT path AS project, critical, CASE WHEN critical > 0 THEN 'blocked' ELSE 'passed' END AS gate FROM (
      SELECT path, count(file) AS critical FROM files LEFT JOIN (SELECT file FROM findings WHERE severity = 'critical') ON file = path GROUP BY path)"""))
def release_gate(spark, sf):
    """The gate with every file as a project of its own, so that some pass."""
    x = reviewed(spark, sf)
    each = x.files.select(F.col("path").alias("project"))
    return followup.release_gate(each, x.findings.withColumn("project", F.col("file")))


@query("quality_trend", s.with_(
    f"""SELECT run, project, n, coalesce(n - lag(n) OVER (PARTITION BY project ORDER BY run), 0) AS n_change FROM (
      SELECT 1 AS run, project, count(*) AS n FROM first_run GROUP BY ALL UNION ALL SELECT 2, project, count(*) FROM second_run GROUP BY ALL)""",
    files=s.plain_files("python"), lines=s.lines(), first_run=s.rule_findings(r.PYTHON_RULES + [r.LONG_LINE]),
    second_run=f"SELECT * FROM ({s.with_('SELECT project FROM findings', files=s.family_files('python'), lines=s.lines(), findings=s.rule_findings(r.PYTHON_RULES + [r.LONG_LINE]))})"))
def quality_trend(spark, sf):
    """Two runs over the documents: as they are, and with a probe line in each."""
    found = lambda files: rollups.total_findings(scan.scan_rules(lines.explode_lines(files), r.PYTHON_RULES + [r.LONG_LINE]))
    first, second = found(c.plain_files(spark, sf, "python")), found(c.family_files(spark, sf, "python"))
    runs = first.withColumn("run", F.lit(1)).unionByName(second.withColumn("run", F.lit(2)))
    return followup.quality_trend(runs, ["n"]).withColumn("n_change", F.coalesce("n_change", F.lit(0)))


@query("risk_bands", s.review(
    """SELECT project, CASE WHEN complexity <= 10 THEN 'simple' WHEN complexity <= 20 THEN 'moderate' WHEN complexity <= 50 THEN 'complex' ELSE 'very complex' END AS complexity_band,
      CASE WHEN maintainability >= 85 THEN 'high' WHEN maintainability >= 65 THEN 'moderate' ELSE 'low' END AS maintainability_band, count(*) AS n FROM metrics GROUP BY ALL"""))
def risk_bands(spark, sf):
    return followup.risk_bands(reviewed(spark, sf).metrics)


# ---- streaming -----------------------------------------------------------

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def arriving(spark, sf):
    """Documents as they arrive: one a minute by number."""
    docs = spark.readStream.schema(DOC_SCHEMA).parquet(f"{sf}/documents.parquet*")
    return docs.select(
        F.col("source").alias("project"), F.concat("lang", F.lit("/d"), "doc_id", F.lit(".py")).alias("path"),
        F.concat("text", F.lit("\n"), c.snippet("python")).alias("content"),
        F.timestamp_seconds(F.col("doc_id") * 60).alias("arrived"))


@query("stream_findings", s.with_(f"SELECT {FIELDS} FROM findings", files=s.family_files("python"), lines=s.lines(),
                                  findings=s.rule_findings(r.PYTHON_RULES + [r.LONG_LINE])))
def stream_findings(spark, sf):
    found = arrivals.stream_findings(arriving(spark, sf))
    return arrivals.drain(found, fresh_path(spark, "stream"), fresh_path(spark, "stream-state")).select(*FIELD_COLUMNS)


@query("stream_severity_windows", s.with_(
    """SELECT w * 3600 AS window_start, w * 3600 + 3600 AS window_end, severity, n, CAST(0 AS BIGINT) AS late,
      w * 3600 + 3600 > (SELECT max(CAST(regexp_extract(file, 'd([0-9]+)[.]', 1) AS BIGINT)) * 60 - 600 FROM findings) AS is_open
    FROM (SELECT CAST(regexp_extract(file, 'd([0-9]+)[.]', 1) AS BIGINT) // 60 AS w, severity, count(*) AS n FROM findings GROUP BY ALL)""",
    files=s.family_files("python"), lines=s.lines(), findings=s.rule_findings(r.PYTHON_RULES + [r.LONG_LINE])))
def stream_severity_windows(spark, sf):
    """Every window of the arrived findings; the stream closes those that its watermark has passed."""
    found = arrivals.stream_findings(arriving(spark, sf), keep=("arrived",))
    stored = arrivals.drain(found, fresh_path(spark, "found"), fresh_path(spark, "found-state"))
    closed = arrivals.drain(arrivals.severity_windows(found), fresh_path(spark, "windows"), fresh_path(spark, "windows-state"))
    seconds = [F.unix_seconds(x).alias(x) for x in ("window_start", "window_end")]
    return arrivals.complete_windows(stored, closed).select(*seconds, "severity", "n", "late", "is_open")
