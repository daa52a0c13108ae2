"""Every registered query next to its SQL."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import corpora as c
from checks import sql as s
from lineglass.functions import rules as r
from lineglass.functions import vocabulary as v
from lineglass.functions.text import base_name, extension, strip
from lineglass.operators import answers as a
from lineglass.operators import blocks, corpus, findings, lines, metrics, rollups, scan, syntax
from lineglass.operators.corpus import with_language
from lineglass.plans.review import Review, StoredReview, store_review
from lineglass.session import fresh_path
from lineglass.sources import answers as answer_source
from lineglass.sources import linters
from lineglass.sources import tree_source as tree_files
from lineglass.streaming import arrivals
from lineglass.streaming import revisions as revision
from lineglass.sources.sinks import write_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
STAMP = "2026-01-01 00:00:00"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def bigint(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]


def rounded(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


def reviewed(spark: SparkSession, sf: str) -> Review:
    return Review(c.review_files(spark, sf))


def stored(spark: SparkSession, sf: str) -> StoredReview:
    """The same review with its tables stored, as a job would run it."""
    return store_review(c.review_files(spark, sf), fresh_path(spark, "review"))


def tagged(files: DataFrame) -> DataFrame:
    return with_language(files)


FIELDS = 'project, file, line, "column", severity, category, rule, message, suggestion, code_snippet'
FIELD_COLUMNS = ["project", "file", "line", "column", "severity", "category", "rule", "message", "suggestion", "code_snippet"]

# ---- flagship ------------------------------------------------------------


@query(
    "secret_and_length_review",
    s.with_(
        """SELECT p.project, x.severity, x.rank, count(f.rule) AS n FROM (SELECT DISTINCT project FROM files) p
        JOIN (VALUES ('critical', 1), ('error', 2), ('warning', 3), ('info', 4)) x(severity, rank) ON true
        LEFT JOIN findings f ON f.project = p.project AND f.severity = x.severity GROUP BY ALL""",
        files=s.plain_files("python"), lines=s.lines(),
        findings=s.rule_findings([x for x in r.PYTHON_RULES if x.key == "SEC003"] + [r.LONG_LINE]),
    ),
)
def secret_and_length_review(spark, sf):
    """Leaked secrets and long lines per project, all severities listed."""
    files = tagged(c.plain_files(spark, sf, "python"))
    rules = [x for x in r.PYTHON_RULES if x.key == "SEC003"] + [r.LONG_LINE]
    found = scan.scan_rules(lines.explode_lines(files), rules)
    return rollups.severity_table(files.select("project").distinct(), found)


# ---- sources -------------------------------------------------------------

IGNORED_DIR_SQL = "list_has_any(string_split(path, '/')[:-2], [" + ", ".join(s.q(d) for d in v.IGNORED_DIRS) + "])"
IGNORED_NAME_SQL = f"{s.base_name()} IN ({', '.join(s.q(x) for x in v.IGNORED_FILES)})"
SUPPORTED_SQL = f"{s.extension()} IN ({', '.join(s.q(x) for x in v.LANGUAGES)})"


@query("scan_tree", s.with_(
    f"SELECT project, path, content FROM files WHERE {SUPPORTED_SQL} AND NOT {IGNORED_NAME_SQL} AND NOT {IGNORED_DIR_SQL}",
    files=s.tree_files()))
def scan_tree(spark, sf):
    return corpus.select_tree(c.tree_files(spark, sf))


TREE_SOURCE_SQL = s.with_(
    f"""SELECT project, path, CASE WHEN contains(content, chr(13))
        THEN replace(replace(content, chr(13) || {s.NL}, {s.NL}), chr(13), {s.NL}) ELSE content END AS content, how
      FROM files, (VALUES ('batch'), ('stream')) t(how)
      WHERE project IS NOT NULL AND path IS NOT NULL AND {SUPPORTED_SQL} AND NOT {IGNORED_NAME_SQL} AND NOT {IGNORED_DIR_SQL}""",
    files=f"SELECT project, path, coalesce(content, '') AS content FROM ({s.tree_files()})")


@query("tree_source", TREE_SOURCE_SQL)
def tree_source(spark, sf):
    """The tree written as files, then read by the tree source in batch and as a stream."""
    root = fresh_path(spark, "tree")
    tree_files.write_tree(c.tree_files(spark, sf), root)
    batch = tree_files.read_tree_source(spark, root).withColumn("how", F.lit("batch"))
    out, marks = fresh_path(spark, "tree_stream"), fresh_path(spark, "tree_marks")
    stream = tree_files.read_tree_source(spark, root, stream=True).writeStream.format("parquet")
    stream.option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    arrived = spark.read.schema("project string, path string, content string").parquet(out)
    return batch.unionByName(arrived.withColumn("how", F.lit("stream")))


REVISED = "CASE WHEN k % 7 = 0 THEN '' WHEN k % 3 = 0 THEN content || {nl} || 'password = ''revised-' || k || '''' ELSE content END"


def revisions(files: DataFrame) -> list[DataFrame]:
    """Three arrivals of the files: all of them, a seventh emptied, a third changed."""
    k = F.regexp_extract("path", "/d([0-9]+)[^/]*$", 1).cast("long")
    first = files.withColumn("version", F.lit(1))
    changed = files.where(k % 3 == 0).withColumn(
        "content", F.concat("content", F.lit("\npassword = 'revised-"), k.cast("string"), F.lit("'"))
    ).withColumn("version", F.lit(2))
    emptied = files.where(k % 7 == 0).withColumn("content", F.lit("")).withColumn("version", F.lit(3))
    return [first, emptied, changed]


@query("stream_revisions", s.with_(
    f"SELECT {FIELDS} FROM findings",
    files=f"SELECT project, path, {REVISED.format(nl=s.NL)} AS content, family FROM "
          f"(SELECT *, CAST(regexp_extract(path, '/d([0-9]+)[^/]*$', 1) AS BIGINT) AS k FROM ({s.review_files()}))",
    lines=s.lines(), findings=s.rule_findings(r.ALL_RULES)))
def stream_revisions(spark, sf):
    """Files arrive three times out of order on a stream; the signed findings add up to the last versions' review."""
    schema = "project string, path string, content string, version long"
    inbox, out, marks = fresh_path(spark, "inbox"), fresh_path(spark, "revised"), fresh_path(spark, "revised_marks")
    for k, arrival in enumerate(revisions(c.review_files(spark, sf))):
        arrival.select("project", "path", "content", "version").write.parquet(f"{inbox}/{k}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(inbox)
        arrivals.drain(revision.revised_findings(stream), out, marks)
    signed = spark.read.schema(revision.SIGNED).parquet(out)
    return revision.current_findings(signed).select(*FIELD_COLUMNS)


@query("scan_single", s.with_(
    f"SELECT project, path, content, {s.language()} AS language FROM files WHERE path = (SELECT min(path) FROM files)",
    files=s.tree_files()))
def scan_single(spark, sf):
    """A named file is taken without the tree's tests; here the file with the lowest path."""
    files = c.tree_files(spark, sf)
    target = files.agg(F.min("path")).first()[0]
    return tagged(corpus.select_single(files, target)).select("project", "path", "content", "language")


@query("decode_text", f"""SELECT doc_id, replace(text, {s.NL}, {s.NL} || {s.NL}) || {s.NL} || 'a' || {s.NL} || 'bc' || chr(65533) || 'd' || {s.NL} AS text FROM documents""")
def decode_text(spark, sf):
    """Texts with carriage returns and broken bytes put in, then decoded."""
    raw = F.concat(
        F.encode(F.replace("text", F.lit("\n"), F.lit("\r\r\n")), "UTF-8"),
        F.unhex(F.lit("0D61" + "0A" + "FF62C363" + "EFBFBD" + "64" + "E282" + "0D0A")),
    )
    return c.documents(spark, sf).select("doc_id", corpus.decode_text(raw).alias("text"))


for _name, _family in (("lines_split", "python"), ("lines_readlines", "generic")):
    def _lines(spark, sf, family=_family):
        end = F.when(F.col("path").rlike("[02468][.]"), F.lit("\n")).otherwise(F.lit(""))
        files = c.plain_files(spark, sf, family).withColumn("content", F.concat("content", end))
        return lines.explode_lines(files).select("project", "path", *bigint("line_no"), "line")

    QUERIES[_name] = _lines
    ORACLES[_name] = s.with_(
        "SELECT project, path, CAST(line_no AS BIGINT) AS line_no, line FROM lines",
        base=s.plain_files(_family),
        files=f"SELECT project, path, content || CASE WHEN regexp_matches(path, '[02468][.]') THEN {s.NL} ELSE '' END AS content, family FROM base",
        lines=s.lines(),
    )

# One linter line per text line; every third one is in another layout.
LINTER_VALUE = "CASE line_no % 3 WHEN 0 THEN 'note: ' || line WHEN 1 THEN line_no || ':' || length(line) || ':E' || (length(line) % 900) || ': ' || line ELSE line_no || ':0:W' || (length(line) % 900) || ':' || line END"


LINTER_PATTERN = r"^([0-9]+):([0-9]+):([\pL\pN_]+):(.+)"
LINTER_PARTS = ", ".join(f"regexp_extract(value, '{LINTER_PATTERN}', {i})" for i in (1, 2, 3, 4))
LINTER_SQL = s.with_(
    f"""SELECT project, path AS file, CAST(p[1] AS INTEGER) AS line, CAST(p[2] AS INTEGER) AS "column",
      CASE WHEN starts_with(p[3], 'E') THEN 'error' ELSE 'warning' END AS severity, 'flake8' AS category, p[3] AS rule,
      {s.strip('p[4]')} AS message, '' AS suggestion, '' AS code_snippet
      FROM (SELECT *, [{LINTER_PARTS}] AS p FROM (SELECT *, {LINTER_VALUE} AS value FROM lines)) WHERE p[1] <> ''""",
    files=s.plain_files("python"), lines=s.lines())


@query("ingest_flake8", LINTER_SQL)
def ingest_flake8(spark, sf):
    return linters.text_findings(linter_text(spark, sf)).select(*FIELD_COLUMNS)


def linter_text(spark, sf):
    rows = lines.explode_lines(c.plain_files(spark, sf, "python"))
    return rows.select("project", "path", (F.col("line_no") - 1).alias("position"), F.expr(LINTER_VALUE).alias("value"))


REPORT_LEVELS = ["LOW", "MEDIUM", "HIGH", "ODD"]


def linter_reports(spark, sf):
    """One JSON report per document with an entry per line; the second entry leaves everything out."""
    n = F.col("line_no")
    rows = lines.explode_lines(c.plain_files(spark, sf, "python")).withColumn(
        "entry",
        F.when(
            n % 3 != 2,
            F.struct(
                n.alias("line_number"), c.pick(REPORT_LEVELS, n).alias("issue_severity"),
                F.concat(F.lit("B"), n).alias("test_id"), F.col("line").alias("issue_text"),
                F.when(n % 2 == 0, F.col("line")).alias("code"),
            ),
        ).otherwise(F.struct(*[F.lit(None).cast(t).alias(k) for k, t in (
            ("line_number", "int"), ("issue_severity", "string"), ("test_id", "string"),
            ("issue_text", "string"), ("code", "string"))])),
    )
    # One report is one file's lines, so the list is as bounded as the file.
    return rows.groupBy("project", "path").agg(
        F.to_json(F.struct(F.transform(
            F.sort_array(F.collect_list(F.struct("line_no", "entry"))), lambda x: x["entry"]).alias("results"))).alias("json")
    )


REPORT_SQL = s.with_(
    f"""SELECT project, path AS file, CASE WHEN full_entry THEN CAST(line_no AS INTEGER) ELSE 1 END AS line, 0 AS "column",
      CASE WHEN NOT full_entry THEN 'warning' ELSE (['info', 'warning', 'error', 'warning'])[1 + line_no % 4] END AS severity,
      'bandit' AS category, CASE WHEN full_entry THEN 'B' || line_no ELSE 'B000' END AS rule,
      CASE WHEN full_entry THEN line ELSE '' END AS message, '' AS suggestion,
      CASE WHEN full_entry AND line_no % 2 = 0 THEN left(line, 80) ELSE '' END AS code_snippet
      FROM (SELECT *, line_no % 3 <> 2 AS full_entry FROM lines)""",
    files=s.plain_files("python"), lines=s.lines())


@query("ingest_bandit", REPORT_SQL)
def ingest_bandit(spark, sf):
    return linters.report_findings(linter_reports(spark, sf)).select(*FIELD_COLUMNS)


@query("bandit_severity", """SELECT line_no AS n, level, CASE level WHEN 'LOW' THEN 'info' WHEN 'HIGH' THEN 'error' ELSE 'warning' END AS severity
    FROM (SELECT doc_id AS line_no, (['LOW', 'MEDIUM', 'HIGH', 'ODD'])[1 + doc_id % 4] AS level FROM documents)""")
def bandit_severity(spark, sf):
    level = c.pick(REPORT_LEVELS, F.col("doc_id"))
    return c.documents(spark, sf).select(
        F.col("doc_id").alias("n"), level.alias("level"), linters.report_severity(level).alias("severity"))


PROVIDERS = ["anthropic", "openai", "ollama"]


@query("llm_envelope", """SELECT conv_id * 1000 + turn AS response_id, (['anthropic', 'openai', 'ollama'])[1 + turn % 3] AS provider,
    CASE WHEN turn % 6 = 5 THEN '' ELSE text END AS text FROM conversations""")
def llm_envelope(spark, sf):
    """Every turn wrapped as a response body, and unwrapped; some local answers lack the field."""
    text = F.col("text")
    body = (
        F.when(F.col("turn") % 3 == 0, F.to_json(F.struct(F.array(F.struct(text.alias("text"))).alias("content"))))
        .when(F.col("turn") % 3 == 1, F.to_json(F.struct(F.array(F.struct(F.struct(text.alias("content")).alias("message"))).alias("choices"))))
        .when(F.col("turn") % 6 == 5, F.lit('{"done": true}'))
        .otherwise(F.to_json(F.struct(text.alias("response"))))
    )
    rows = c.spread(c.table(spark, sf, "conversations")).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("response_id"), c.pick(PROVIDERS, F.col("turn")).alias("provider"), body.alias("body"))
    return answer_source.answer_text(rows)


# ---- projections and predicates ------------------------------------------


@query("language_of", s.with_(f"SELECT path, {s.extension()} AS ext, {s.language()} AS language FROM files", files=s.tree_files()))
def language_of(spark, sf):
    path = F.col("path")
    return c.tree_files(spark, sf).select("path", extension(path).alias("ext"), corpus.language_of(path).alias("language"))


@query("route_family", s.with_(f"SELECT path, {s.family_of('language')} AS family FROM (SELECT *, {s.language()} AS language FROM files)", files=s.tree_files()))
def route_family(spark, sf):
    return tagged(c.tree_files(spark, sf)).select("path", "family")


for _name, _test, _sql in (
    ("keep_supported", corpus.is_supported, SUPPORTED_SQL),
    ("drop_ignored_names", lambda p: ~corpus.is_ignored_name(p), f"NOT {IGNORED_NAME_SQL}"),
    ("prune_dirs", lambda p: ~corpus.in_ignored_dir(p), f"NOT {IGNORED_DIR_SQL}"),
):
    QUERIES[_name] = lambda spark, sf, test=_test: c.tree_files(spark, sf).filter(test(F.col("path"))).select("project", "path")
    ORACLES[_name] = s.with_(f"SELECT project, path FROM files WHERE {_sql}", files=s.tree_files())

for _name, _family in (("classify_line_py", "python"), ("classify_line_js", "javascript"), ("classify_line_generic", "generic")):
    def _classify(spark, sf, family=_family):
        files = c.block_files(spark, sf) if family == "javascript" else c.family_files(spark, sf, family)
        return lines.classify_lines(lines.explode_lines(files)).select("project", "path", *bigint("line_no"), "line_class")

    QUERIES[_name] = _classify
    ORACLES[_name] = s.with_(
        f"SELECT project, path, CAST(line_no AS BIGINT) AS line_no, {s.line_class()} AS line_class FROM lines",
        files=s.block_files() if _family == "javascript" else s.family_files(_family), lines=s.lines())


@query("js_block_state", s.with_("SELECT project, path, CAST(line_no AS BIGINT) AS line_no, line, skipped FROM lines",
                                 files=s.block_files(), lines=s.lines()))
def js_block_state(spark, sf):
    return lines.explode_lines(c.block_files(spark, sf)).select("project", "path", *bigint("line_no"), "line", "skipped")


for _name, _where in (
    ("filter_severity", "severity = 'info'"),
    ("critical_error", "severity IN ('critical', 'error')"),
    ("warnings", "severity = 'warning'"),
):
    ORACLES[_name] = s.review(f"SELECT {FIELDS} FROM findings WHERE {_where}")
QUERIES["filter_severity"] = lambda spark, sf: findings.filter_severity(reviewed(spark, sf).findings, "info").select(*FIELD_COLUMNS)
QUERIES["critical_error"] = lambda spark, sf: findings.critical_and_error(reviewed(spark, sf).findings).select(*FIELD_COLUMNS)
QUERIES["warnings"] = lambda spark, sf: findings.warnings(reviewed(spark, sf).findings).select(*FIELD_COLUMNS)


@query("findings_listing", s.review(f"SELECT project, {s.base_name('file')} AS name, line, severity, category, left(message, 80) AS message FROM findings"))
def findings_listing(spark, sf):
    return findings.listing(reviewed(spark, sf).findings)


DETAIL_SQL = f"""'File: ' || file || {s.NL} || 'Line: ' || line || ', Column: ' || "column" || {s.NL} || 'Severity: ' || upper(severity) || {s.NL}
    || 'Category: ' || category || {s.NL} || 'Rule: ' || rule || {s.NL} || {s.NL} || message
    || CASE WHEN suggestion <> '' THEN {s.q(chr(10) * 2 + '💡 Suggestion:' + chr(10))} || suggestion ELSE '' END
    || CASE WHEN code_snippet NOT IN ('', '[REDACTED]') THEN {s.q(chr(10) * 2 + 'Code:' + chr(10))} || code_snippet ELSE '' END"""


@query("finding_detail", s.review(f"SELECT project, {DETAIL_SQL} AS detail FROM findings"))
def finding_detail(spark, sf):
    return reviewed(spark, sf).findings.select("project", findings.detail_text().alias("detail"))


@query("redact", s.with_(
    "SELECT project, file, rule, code_snippet, count(*) AS n FROM findings WHERE category = 'secret' GROUP BY ALL",
    files=s.family_files("python"), lines=s.lines(), findings=s.rule_findings([x for x in r.PYTHON_RULES if x.pack == "secret"])))
def redact(spark, sf):
    found = scan.scan_rules(lines.explode_lines(c.family_files(spark, sf, "python")), [x for x in r.PYTHON_RULES if x.pack == "secret"])
    return found.groupBy("project", "file", "rule", "code_snippet").agg(F.count("*").alias("n"))


@query("snippet", s.with_(
    f"SELECT project, path, CAST(line_no AS BIGINT) AS line_no, left(stripped, 100) AS snippet_100, left(stripped, 80) AS snippet_80 FROM lines",
    files=s.family_files("python"), lines=s.lines()))
def snippet(spark, sf):
    text = strip(F.col("line"))
    return lines.explode_lines(c.family_files(spark, sf, "python")).select(
        "project", "path", *bigint("line_no"), F.substring(text, 1, 100).alias("snippet_100"), F.substring(text, 1, 80).alias("snippet_80"))


@query("line_too_long", s.with_(f"SELECT {FIELDS} FROM findings", files=s.plain_files("python"), lines=s.lines(), findings=s.rule_findings([r.LONG_LINE])))
def line_too_long(spark, sf):
    return scan.scan_rules(lines.explode_lines(c.plain_files(spark, sf, "python")), [r.LONG_LINE]).select(*FIELD_COLUMNS)


@query("default_model", """SELECT conv_id, turn, provider, CASE provider WHEN 'anthropic' THEN 'claude-3-haiku-20240307' WHEN 'ollama' THEN 'llama3'
    ELSE 'gpt-4o-mini' END AS model FROM (SELECT *, (['anthropic', 'openai', 'ollama', 'other'])[1 + turn % 4] AS provider FROM conversations)""")
def default_model(spark, sf):
    provider = c.pick([*PROVIDERS, "other"], F.col("turn"))
    return c.table(spark, sf, "conversations").select("conv_id", "turn", provider.alias("provider"), a.default_model(provider).alias("model"))


@query("summary_line", s.review(
    """SELECT project, 'Files: ' || files || '  |  Lines: ' || format('{:,}', total) || '  |  🔴 Critical: ' || critical || '  |  🟠 Error: ' || error
      || '  |  🟡 Warning: ' || warning || '  |  🔵 Info: ' || info || chr(10) || chr(10) || 'AI: ' || left(project || ' looks fine. ' || repeat('x', 300), 200) || '...' AS summary_line
    FROM totals JOIN sev USING (project)""",
    totals="SELECT project, count(*) AS files, CAST(sum(lines_total) AS BIGINT) AS total FROM metrics GROUP BY project",
    sev="SELECT project, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info FROM findings GROUP BY project"))
def summary_line(spark, sf):
    x = reviewed(spark, sf)
    notes = x.totals.select("project", F.concat("project", F.lit(" looks fine. " + "x" * 300)).alias("ai_summary"))
    return rollups.summary_line(x.totals, x.findings, notes)


# ---- rule packs and single rules -----------------------------------------

SHORT = {"python": "py", "javascript": "js", "generic": "gen"}

for _family, _all in (("python", r.PYTHON_RULES), ("javascript", r.JS_RULES), ("generic", r.GENERIC_RULES)):
    _packs = {p: [x for x in _all if x.pack == p] for p in dict.fromkeys(x.pack for x in _all)}
    _sets = {f"rules_{_family}_{p}": rules for p, rules in _packs.items()} | {
        f"{SHORT[_family]}_{x.key}": [x] for x in _all
    }
    for _name, _rules in _sets.items():
        def _scan(spark, sf, family=_family, rules=_rules):
            return scan.scan_rules(lines.explode_lines(c.family_files(spark, sf, family)), rules).select(*FIELD_COLUMNS)

        QUERIES[_name] = _scan
        ORACLES[_name] = s.with_(f"SELECT {FIELDS} FROM findings", files=s.family_files(_family), lines=s.lines(),
                                 findings=s.rule_findings(_rules))


@query("rules_on_pages", s.with_(f"SELECT {FIELDS} FROM findings", files=s.page_files(), lines=s.lines(), findings=s.rule_findings(r.JS_RULES)))
def rules_on_pages(spark, sf):
    """The JavaScript family over raw web pages."""
    return scan.scan_rules(lines.explode_lines(c.page_files(spark, sf)), r.JS_RULES).select(*FIELD_COLUMNS)


for _rule, _slot in (("C001", 1), ("C002", 2), ("B012", 3), ("E001", 4)):
    QUERIES[f"py_{_rule}"] = lambda spark, sf, rule=_rule: syntax.tree_findings(
        syntax.python_nodes(c.python_files(spark, sf))).filter(F.col("rule") == rule).select(*FIELD_COLUMNS)
    ORACLES[f"py_{_rule}"] = s.with_(f"SELECT {FIELDS} FROM found WHERE rule = '{_rule}'", files=s.python_files(),
                                              functions=s.functions(), found=s.tree_findings())

# ---- joins ---------------------------------------------------------------


@query("scan_rules", s.with_(f"SELECT {FIELDS} FROM findings", files=s.review_files(), lines=s.lines(), findings=s.rule_findings(r.ALL_RULES)))
def scan_rules(spark, sf):
    """All 66 line patterns and the length rule over files of all families in one pass."""
    return scan.scan_rules(lines.explode_lines(c.review_files(spark, sf))).select(*FIELD_COLUMNS)


def rule_table(spark):
    from lineglass.functions.text import java_regex

    rows = [(x.family, x.number, x.rule, java_regex(x.pattern).removeprefix("(?d)"), x.ignore_case, x.severity, x.category,
             x.message, x.suggestion, x.snippet_len) for x in r.LINE_RULES]
    return spark.createDataFrame(rows, "family string, number int, rule string, pattern string, ignore_case boolean, "
                                 "severity string, category string, message string, suggestion string, snippet_len int")


@query("scan_rule_table", s.with_(f"SELECT {FIELDS} FROM findings", files=s.review_files(), lines=s.lines(), findings=s.rule_findings(r.LINE_RULES)))
def scan_rule_table(spark, sf):
    """The same patterns supplied as a table of rules."""
    return scan.scan_rule_table(lines.explode_lines(c.review_files(spark, sf)), rule_table(spark)).select(*FIELD_COLUMNS)


TOKEN = "t = " + ".".join("eyJ" + x * 5 for x in ("ab1", "cd2", "ef3"))
EXTRA_LINES = [TOKEN, 'q = "SELECT a FROM t WHERE b = \'" + b', 'q = "DELETE FROM t WHERE a = \'" % a', 'q = "SELECT 1"']
EXTRA_SQL = s.with_(
    """SELECT project, file, line, rule, severity, category, message, suggestion, code_snippet FROM (
      SELECT project, path AS file, CAST(line_no AS INTEGER) AS line, 'X001' AS rule, 'critical' AS severity, 'secret' AS category,
        'JSON web token in source code' AS message, 'Move to environment variables or secrets manager' AS suggestion, '[REDACTED]' AS code_snippet
      FROM lines WHERE NOT skipped AND regexp_matches(line, 'eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}')
      UNION ALL SELECT project, path, CAST(line_no AS INTEGER), 'X002', 'error', 'security', 'SQL statement put together from text',
        'Use query parameters', left(stripped, 100)
      FROM lines WHERE NOT skipped AND regexp_matches(line, '(SELECT|INSERT|UPDATE|DELETE)\\s[^"'']*["'']\\s*([+]|%)\\s*[\\pL\\pN_]'))""",
    files=f"SELECT project, path, content || {s.NL} || {s.pick(EXTRA_LINES, 'length(content)')} AS content, family FROM ({s.plain_files('python')})",
    lines=s.lines())


@query("extra_rules", EXTRA_SQL)
def extra_rules(spark, sf):
    """Web tokens and statements from text in every document, with a probe line at its end."""
    files = c.plain_files(spark, sf, "python")
    files = files.withColumn("content", F.concat("content", F.lit("\n"), c.pick(EXTRA_LINES, F.length("content"))))
    found = scan.scan_rules(lines.explode_lines(files), r.EXTRA_RULES)
    return found.select("project", "file", "line", "rule", "severity", "category", "message", "suggestion", "code_snippet")


@query("duplicate_lines", s.with_(
    """SELECT project, path, CAST(sum(n) AS BIGINT) AS lines_filled, CAST(sum(CASE WHEN total > 1 THEN n ELSE 0 END) AS BIGINT) AS lines_repeated,
      round(sum(CASE WHEN total > 1 THEN n ELSE 0 END) / sum(n), 6) AS share
    FROM (SELECT *, sum(n) OVER (PARTITION BY project, stripped) AS total FROM (
      SELECT project, path, stripped, count(*) AS n FROM lines WHERE stripped <> '' GROUP BY ALL)) GROUP BY ALL""",
    files=s.review_files(), lines=s.lines()))
def duplicate_lines(spark, sf):
    found = lines.duplicate_lines(lines.explode_lines(c.review_files(spark, sf)))
    return found.select("project", "path", *bigint("lines_filled", "lines_repeated"), *rounded("share"))


BLOCK_SQL = s.with_(
    f"""SELECT project, path, CAST(first_line AS INTEGER) AS first_line, CAST(last_line AS INTEGER) AS last_line,
      CAST(lines AS BIGINT) AS lines, class_path, CAST(class_line AS INTEGER) AS class_line, CAST(members AS BIGINT) AS members
    FROM (SELECT *, count(*) OVER c AS members, first_value(path) OVER c AS class_path, first_value(first_line) OVER c AS class_line
      FROM blocks WINDOW c AS (PARTITION BY project, content, lines ORDER BY path, first_line
        ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))""",
    files=s.review_files(), lines=s.lines(),
    filled="SELECT project, path, line_no, stripped, row_number() OVER (PARTITION BY project, path ORDER BY line_no) - 1 AS idx "
           "FROM lines WHERE stripped <> ''",
    runs=f"""SELECT * FROM (SELECT project, path, idx, line_no AS first_line, last_value(line_no) OVER w AS last_line,
        list(stripped) OVER w AS run, count(*) OVER w AS n FROM filled
        WINDOW w AS (PARTITION BY project, path ORDER BY idx ROWS BETWEEN CURRENT ROW AND {blocks.BLOCK_LINES - 1} FOLLOWING))
      WHERE n = {blocks.BLOCK_LINES}""",
    again="SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY project, run) AS places FROM runs) WHERE places > 1",
    islands="SELECT *, idx - row_number() OVER (PARTITION BY project, path ORDER BY idx) AS island FROM again",
    blocks=f"""SELECT project, path, min(first_line) AS first_line, max(last_line) AS last_line,
      max(idx) - min(idx) + {blocks.BLOCK_LINES} AS lines, list(run ORDER BY idx) AS content FROM islands GROUP BY project, path, island""")


@query("repeated_blocks", BLOCK_SQL)
def repeated_blocks(spark, sf):
    """Maximal blocks of four or more lines that a project repeats, with their clone classes."""
    return blocks.repeated_blocks(c.review_files(spark, sf))


COPIES = 31


@query("scan_rule_table_large", s.with_(
    f"SELECT rule, severity, category, count(*) * {COPIES} AS n FROM findings GROUP BY ALL",
    files=s.review_files(), lines=s.lines(), findings=s.rule_findings(r.LINE_RULES)))
def scan_rule_table_large(spark, sf):
    """A table of over 2,000 rules, the catalogue many times over with numbers of its own each."""
    copies = spark.range(COPIES).select((F.col("id") * 1000).cast("int").alias("_more"))
    rules = rule_table(spark).join(F.broadcast(copies)).withColumn("number", F.col("number") + F.col("_more")).drop("_more")
    found = scan.scan_rule_table(lines.explode_lines(c.review_files(spark, sf)), rules)
    return found.groupBy("rule", "severity", "category").agg(F.count("*").alias("n"))


@query("rule_severity", s.with_(
    "SELECT rule, severity, category, count(*) AS n FROM findings GROUP BY ALL",
    files=s.family_files("python"), lines=s.lines(), findings=s.rule_findings(r.PYTHON_RULES)))
def rule_severity(spark, sf):
    found = scan.scan_rules(lines.explode_lines(c.family_files(spark, sf, "python")), r.PYTHON_RULES)
    return found.groupBy("rule", "severity", "category").agg(F.count("*").alias("n"))


SEVERITY_SQL = """SELECT p.project, x.severity, x.rank, count(f.rule) AS n FROM (SELECT DISTINCT project FROM metrics) p
    JOIN (VALUES ('critical', 1), ('error', 2), ('warning', 3), ('info', 4)) x(severity, rank) ON true
    LEFT JOIN findings f ON f.project = p.project AND f.severity = x.severity GROUP BY ALL"""


@query("severity_zero_fill", s.review(SEVERITY_SQL))
def severity_zero_fill(spark, sf):
    x = reviewed(spark, sf)
    return rollups.severity_table(x.totals, x.findings)


@query("finding_lookup", s.review(
    f"""SELECT project, name, line, severity, file, "column", category, rule, message, suggestion, code_snippet FROM (
      SELECT *, row_number() OVER (PARTITION BY project, name, line, severity ORDER BY file, ord) AS k
      FROM (SELECT *, {s.base_name('file')} AS name FROM findings)) WHERE k = 1"""))
def finding_lookup(spark, sf):
    return findings.finding_lookup(reviewed(spark, sf).findings).drop("ord")


@query("function_contains", s.with_(
    "SELECT project, path, name, CAST(complexity - 1 AS BIGINT) AS decisions FROM functions",
    files=s.python_files(), functions=s.functions()))
def function_contains(spark, sf):
    nodes = syntax.python_nodes(c.python_files(spark, sf))
    inside = syntax.function_contains(nodes)
    own = F.max(F.when(F.col("pre") == F.col("function_pre"), F.col("name")))
    return inside.groupBy("project", "path", "function_pre").agg(
        own.alias("name"), F.sum("weight").cast("bigint").alias("decisions")).drop("function_pre")


# ---- aggregations --------------------------------------------------------


@query("line_counts", s.with_(
    "SELECT project, path, lines_total, lines_code, lines_comment, lines_blank FROM counts",
    files=s.review_files(), lines=s.lines(), counts=s.counts()))
def line_counts(spark, sf):
    return lines.line_counts(c.review_files(spark, sf)).select(
        "project", "path", *bigint("lines_total", "lines_code", "lines_comment", "lines_blank"))


@query("issue_counts", s.review("SELECT project, severity, count(*) AS n FROM findings GROUP BY ALL"))
def issue_counts(spark, sf):
    return rollups.issue_counts(reviewed(spark, sf).findings)


@query("category_counts", s.review("SELECT project, category, count(*) AS n FROM findings GROUP BY ALL"))
def category_counts(spark, sf):
    return rollups.category_counts(reviewed(spark, sf).findings)


@query("project_totals", s.with_(
    "SELECT project, count(*) AS files_analyzed, CAST(sum(total) AS BIGINT) AS total_lines FROM (SELECT f.project, f.path, count(l.line_no) AS total FROM files f LEFT JOIN lines l USING (project, path) GROUP BY ALL) GROUP BY project",
    files=s.review_files(), lines=s.lines()))
def project_totals(spark, sf):
    return rollups.project_totals(lines.line_counts(c.review_files(spark, sf)))


@query("python_ast_nodes", s.with_(
    """SELECT project, path, kind, CAST(sum(n) AS BIGINT) AS nodes, CAST(sum(w) AS BIGINT) AS weight FROM (
      SELECT project, path, CASE WHEN n % 17 = 0 THEN 'error' ELSE 'module' END AS kind, 1 AS n, 0 AS w FROM files
      UNION ALL SELECT project, path, 'function', 1, 0 FROM functions
      UNION ALL SELECT project, path, 'class', 1, 0 FROM files WHERE n % 5 = 0 AND n % 17 <> 0
      UNION ALL SELECT project, path, 'decision', complexity - 1, complexity - 1 FROM functions WHERE name LIKE 'f%') GROUP BY ALL HAVING sum(n) > 0""",
    files=s.python_files(), functions=s.functions()))
def python_ast_nodes(spark, sf):
    nodes = syntax.python_nodes(c.python_files(spark, sf))
    return nodes.groupBy("project", "path", "kind").agg(F.count("*").alias("nodes"), F.sum("weight").alias("weight"))


@query("py_def_counts", s.with_(
    "SELECT project, path, CASE WHEN n % 17 = 0 THEN 0 WHEN n % 3 = 0 THEN 2 ELSE 1 END AS functions, CASE WHEN n % 17 <> 0 AND n % 5 = 0 THEN 1 ELSE 0 END AS classes FROM files",
    files=s.python_files()))
def py_def_counts(spark, sf):
    return syntax.definition_counts(syntax.python_nodes(c.python_files(spark, sf))).select("project", "path", *[F.col(x).cast("int").alias(x) for x in ("functions", "classes")])


@query("function_complexity", s.with_(
    "SELECT project, path, name, CAST(line AS BIGINT) AS line, CAST(complexity AS BIGINT) AS complexity, CAST(n_args AS BIGINT) AS n_args FROM functions",
    files=s.python_files(), functions=s.functions()))
def function_complexity(spark, sf):
    return syntax.function_complexity(syntax.python_nodes(c.python_files(spark, sf))).select(
        "project", "path", "name", *bigint("line", "complexity", "n_args"))


@query("file_complexity_py", s.with_(
    "SELECT f.project, f.path, round(CAST(coalesce(avg(g.complexity), 0) AS DOUBLE), 6) AS complexity FROM files f LEFT JOIN functions g USING (project, path) GROUP BY ALL",
    files=s.python_files(), functions=s.functions()))
def file_complexity_py(spark, sf):
    return syntax.file_complexity(syntax.python_nodes(c.python_files(spark, sf))).select("project", "path", *rounded("complexity"))


@query("maintainability_py", s.with_(
    f"SELECT project, path, {s.maintainability('lines_code', 'cc')} AS maintainability FROM (SELECT project, path, lines_code, lines_total % 60 / 2.0 AS cc FROM counts)",
    files=s.plain_files("python"), lines=s.lines(), counts=s.counts()))
def maintainability_py(spark, sf):
    counts = lines.line_counts(c.plain_files(spark, sf, "python"))
    return counts.select("project", "path", syntax.maintainability(F.col("lines_code"), F.col("lines_total") % 60 / 2.0).alias("maintainability"))


JS_STEPS = {"files": s.block_files(), "lines": s.lines(), "counts": s.counts(), "js": s.js_facts()}


@query("js_def_counts", s.with_("SELECT project, path, CAST(functions AS BIGINT) AS functions, CAST(classes AS BIGINT) AS classes FROM js",
                                files=s.block_files(), js=s.js_facts()))
def js_def_counts(spark, sf):
    return metrics.js_file_facts(c.block_files(spark, sf)).select("project", "path", *bigint("functions", "classes"))


@query("js_decisions", s.with_("SELECT project, path, CAST(decisions AS BIGINT) AS decisions FROM js", files=s.plain_files("javascript"), js=s.js_facts()))
def js_decisions(spark, sf):
    return metrics.js_file_facts(c.plain_files(spark, sf, "javascript")).select("project", "path", *bigint("decisions"))


@query("file_complexity_js", s.with_("SELECT project, path, round(complexity, 6) AS complexity FROM js", files=s.page_files(), js=s.js_facts()))
def file_complexity_js(spark, sf):
    return metrics.js_file_facts(c.page_files(spark, sf)).select("project", "path", *rounded("complexity"))


@query("maintainability_js", s.with_(
    "SELECT project, path, round(greatest(0.0, least(100.0, 100.0 - complexity * 3 - lines_code / 100)), 6) AS maintainability FROM js JOIN counts USING (project, path)", **JS_STEPS))
def maintainability_js(spark, sf):
    counted = lines.line_counts(tagged(c.block_files(spark, sf)), keep=("content",))
    return metrics.text_file_metrics(counted).select("project", F.col("filepath").alias("path"), *rounded("maintainability"))


METRICS_SQL = """project, filepath, CAST(lines_total AS BIGINT) AS lines_total, CAST(lines_code AS BIGINT) AS lines_code,
    CAST(lines_comment AS BIGINT) AS lines_comment, CAST(lines_blank AS BIGINT) AS lines_blank, CAST(functions AS BIGINT) AS functions,
    CAST(classes AS BIGINT) AS classes, round(complexity, 6) AS complexity, round(maintainability, 6) AS maintainability"""


@query("file_metrics", s.with_(
    f"SELECT {METRICS_SQL} FROM metrics", files=s.review_files(), lines=s.lines(), functions=s.functions(), counts=s.counts(), js=s.js_facts(), metrics=s.file_metrics()))
def file_metrics(spark, sf):
    return metrics.file_metrics(c.review_files(spark, sf)).select(
        "project", "filepath", *bigint("lines_total", "lines_code", "lines_comment", "lines_blank", "functions", "classes"),
        *rounded("complexity", "maintainability"))


MERGED_SQL = "(SELECT * REPLACE (left(project, 4) AS project) FROM findings)"


def merged(findings: DataFrame) -> DataFrame:
    """Findings of fewer and larger projects, so that the lists' limits are reached."""
    return findings.withColumn("project", F.substring("project", 1, 4))


@query("warning_overflow", s.review(f"SELECT project, count(*) AS warnings, greatest(count(*) - 20, 0) AS unlisted FROM {MERGED_SQL} WHERE severity = 'warning' GROUP BY project"))
def warning_overflow(spark, sf):
    return rollups.warning_overflow(merged(reviewed(spark, sf).findings))


@query("total_findings", s.review("SELECT project, count(*) AS n FROM findings GROUP BY project"))
def total_findings(spark, sf):
    return rollups.total_findings(reviewed(spark, sf).findings)


# ---- windows, ranking, top-k ---------------------------------------------


@query("finding_ordinal", s.review(
    f"SELECT {FIELDS}, row_number() OVER (PARTITION BY project ORDER BY file, ord) AS ordinal FROM findings"))
def finding_ordinal(spark, sf):
    found = write_table(reviewed(spark, sf).findings, fresh_path(spark, "findings"))
    return findings.finding_ordinal(found).select(*FIELD_COLUMNS, *bigint("ordinal"))


@query("categories_ranked", s.review(
    """SELECT project, category, n, row_number() OVER (PARTITION BY project ORDER BY n DESC, file, ord) AS rank FROM (
      SELECT project, category, file, ord, count(*) OVER (PARTITION BY project, category) AS n,
        row_number() OVER (PARTITION BY project, category ORDER BY file, ord) AS k FROM findings) WHERE k = 1"""))
def categories_ranked(spark, sf):
    return rollups.categories_ranked(reviewed(spark, sf).findings).withColumn("rank", F.col("rank").cast("bigint"))


for _name, _where, _limit, _top in (
    ("top_critical", "severity IN ('critical', 'error')", 30, rollups.top_critical),
    ("top_warnings", "severity = 'warning'", 20, rollups.top_warnings),
):
    QUERIES[_name] = lambda spark, sf, top=_top: top(merged(reviewed(spark, sf).findings)).select(*FIELD_COLUMNS, *bigint("rank"))
    ORACLES[_name] = s.review(
        f"SELECT * FROM (SELECT {FIELDS}, row_number() OVER (PARTITION BY project ORDER BY file, ord) AS rank FROM {MERGED_SQL} WHERE {_where}) WHERE rank <= {_limit}")


@query("top_complex_files", s.review(
    f"""SELECT project, left({s.base_name('filepath')}, 30) AS name, round(complexity, 6) AS complexity, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY project ORDER BY complexity DESC, filepath) AS rank FROM metrics) WHERE rank <= 15"""))
def top_complex_files(spark, sf):
    return rollups.top_complex_files(reviewed(spark, sf).metrics).select("project", "name", *rounded("complexity"), *bigint("rank"))


# ---- set operation -------------------------------------------------------


@query("union_findings", s.with_(
    f"SELECT {FIELDS} FROM lined UNION ALL SELECT {FIELDS} FROM treed UNION ALL SELECT * FROM linted UNION ALL SELECT * FROM reported",
    files=s.python_files(), lines=s.lines(), functions=s.functions(),
    lined=s.rule_findings(r.PYTHON_RULES + [r.LONG_LINE]), treed=s.tree_findings(),
    linted=LINTER_SQL, reported=REPORT_SQL))
def union_findings(spark, sf):
    """Rule, tree and linter findings of the same files in one table, nothing removed."""
    files = c.python_files(spark, sf)
    return findings.union_findings(
        scan.scan_rules(lines.explode_lines(files), r.PYTHON_RULES + [r.LONG_LINE]),
        syntax.tree_findings(syntax.python_nodes(files)),
        linters.text_findings(linter_text(spark, sf)),
        linters.report_findings(linter_reports(spark, sf)),
    ).select(*FIELD_COLUMNS)


# ---- prompts and answers -------------------------------------------------

_head = "'Review this python code for bugs, security issues, and improvements.' || chr(10) || 'Be concise and specific. Focus on the most important issues.' || chr(10) || chr(10) || 'File: '"
PROMPT_SQL = f"""{_head} || path || {s.q(chr(10) * 2 + '```python' + chr(10))} ||
    CASE WHEN length(content) > 12000 THEN left(content, 12000) || {s.q(a.TRUNCATION_NOTE)} ELSE content END || {s.q(a.PROMPT_TAIL)}"""


@query("build_prompts", s.with_(f"SELECT project, path, {PROMPT_SQL} AS prompt FROM files", files=s.plain_files("python")))
def build_prompts(spark, sf):
    files = tagged(c.plain_files(spark, sf, "python"))
    return files.select("project", "path", a.review_prompt(F.col("content"), F.col("language"), F.col("path")).alias("prompt"))


@query("review_request_rows", s.with_(
    f"""SELECT project, path, provider, coalesce(json_extract_string(body, '$.prompt'), json_extract_string(body, '$.messages[0].content')) AS prompt,
      json_extract_string(body, '$.model') AS model, coalesce(json_extract_string(body, '$.max_tokens'), '') AS max_tokens FROM (
      SELECT project, path, provider, CASE provider WHEN 'ollama' THEN json_object('model', model, 'prompt', prompt, 'stream', false)
        ELSE json_object('model', model, 'max_tokens', 1500, 'messages', [json_object('role', 'user', 'content', prompt)]) END AS body FROM (
      SELECT *, {PROMPT_SQL} AS prompt, (['anthropic', 'openai', 'ollama'])[1 + length(path) % 3] AS provider,
        (['claude-3-haiku-20240307', 'gpt-4o-mini', 'llama3'])[1 + length(path) % 3] AS model FROM files))""",
    files=s.plain_files("python")))
def review_request_rows(spark, sf):
    """Request bodies, read back field by field."""
    provider = c.pick(PROVIDERS, F.length("path"))
    prompt = a.review_prompt(F.col("content"), F.col("language"), F.col("path"))
    rows = tagged(c.plain_files(spark, sf, "python")).select(
        "project", "path", provider.alias("provider"), a.request_body(provider, F.lit(None).cast("string"), prompt).alias("body"))
    field = lambda p: F.get_json_object("body", p)
    return rows.select("project", "path", "provider", F.coalesce(field("$.prompt"), field("$.messages[0].content")).alias("prompt"),
                       field("$.model").alias("model"), F.coalesce(field("$.max_tokens"), F.lit("")).alias("max_tokens"))


SUMMARY_SQL = f"""SELECT conv_id, turn, left(CASE WHEN NOT contains(text, 'SUMMARY:') THEN text ELSE {s.strip('''substr(text, strpos(text, 'SUMMARY:') + 8,
      greatest(CASE WHEN contains(text, 'ISSUES:') THEN strpos(text, 'ISSUES:') - 1 ELSE length(text) END - strpos(text, 'SUMMARY:') - 7, 0))''')} END, 500) AS summary FROM answers"""


@query("parse_summary", s.with_(SUMMARY_SQL, answers=s.answers()))
def parse_summary(spark, sf):
    return c.answers(spark, sf).select("conv_id", "turn", a.answer_summary(F.col("text")).alias("summary"))


@query("first_ai_summary", s.with_(
    f"SELECT 'c' || conv_id AS project, arg_min(summary, turn) AS ai_summary FROM ({SUMMARY_SQL}) WHERE summary <> '' GROUP BY conv_id",
    answers=s.answers()))
def first_ai_summary(spark, sf):
    """A conversation as a project, its assistant turns as the answers for its files."""
    rows = c.answers(spark, sf).select(F.concat(F.lit("c"), "conv_id").alias("project"), F.col("turn").alias("ord"), "text")
    return a.first_summary(a.parse_answers(rows)).select("project", "ai_summary")


SUGGESTIONS_SQL = f"""SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS position,
      CASE WHEN starts_with(x, '- ') THEN substr(x, 3) ELSE x END AS suggestion FROM (
      SELECT conv_id, turn, {s.strip('unnest(p)')} AS x, generate_subscripts(p, 1) AS i FROM (
        SELECT *, string_split(substr(text, strpos(text, 'SUGGESTIONS:') + 12), {s.NL}) AS p FROM answers WHERE contains(text, 'SUGGESTIONS:')))
      WHERE starts_with(x, '- ') OR (x <> '' AND NOT starts_with(x, 'SUMMARY') AND NOT starts_with(x, 'ISSUES'))"""

for _name in ("parse_suggestions", "cap_suggestions"):
    def _suggestions(spark, sf, count=_name == "cap_suggestions"):
        parsed = c.answers(spark, sf).select("conv_id", "turn", a.answer_suggestions(F.col("text")).alias("x"))
        if count:
            return parsed.select("conv_id", "turn", F.size("x").cast("bigint").alias("kept"))
        return parsed.select("conv_id", "turn", F.posexplode("x").alias("position", "suggestion")).withColumn("position", (F.col("position") + 1).cast("bigint"))

    QUERIES[_name] = _suggestions
ORACLES["parse_suggestions"] = s.with_(f"SELECT * FROM ({SUGGESTIONS_SQL}) WHERE position <= 10", answers=s.answers())
ORACLES["cap_suggestions"] = s.with_(
    f"SELECT a.conv_id, a.turn, count(x.position) AS kept FROM answers a LEFT JOIN (SELECT * FROM ({SUGGESTIONS_SQL}) WHERE position <= 10) x USING (conv_id, turn) GROUP BY ALL",
    answers=s.answers())
