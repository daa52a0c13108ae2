"""The registered queries in DuckDB SQL: derived corpora and shared sub-queries.

Each function returns the text of one sub-query; ``with_`` strings them together.
"""

import re

from checks import corpora as c
from checks.probes import snippets
from lineglass.functions import rules as r
from lineglass.functions import vocabulary as v
from lineglass.functions.text import BLANKS
from lineglass.operators.metrics import JS_CLASS_PATTERN, JS_FUNCTION_PATTERN

NL = "chr(10)"


def q(text: str) -> str:
    """A SQL string literal; line ends as chr(10)."""
    parts = ["'" + p.replace("'", "''") + "'" for p in text.split("\n")]
    return parts[0] if len(parts) == 1 else "(" + f" || {NL} || ".join(parts) + ")"


def pick(values: list[str], number: str) -> str:
    return f"([{', '.join(q(x) for x in values)}])[1 + CAST({number} AS BIGINT) % {len(values)}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{BLANKS}]+|[{BLANKS}]+$', '', 'g')"


def re2(pattern: str) -> str:
    """A rule pattern for RE2, with Unicode classes spelled out."""
    out = pattern.replace(r":\s]", ":" + BLANKS + "]")
    out = out.replace(r"\s", f"[{BLANKS}]").replace(r"\S", f"[^{BLANKS}]").replace(r"\w", r"[\pL\pN_]")
    return re.sub(r"\{$", r"\\{", out)


def matches(rule: r.Rule, line: str = "line") -> str:
    """The rule as a condition.  RE2 has no look-ahead, so four rules are taken apart."""
    flag = "(?i)" if rule.ignore_case else ""
    has = lambda p, x=line: f"regexp_matches({x}, {q(flag + re2(p))})"
    if rule.key in ("S007b", "S012") and rule.family == "python":
        base, word = rule.pattern.split("(?!.*")
        rest = f"regexp_replace({line}, {q(flag + '^.*' + re2(base))}, '')"
        return f"({has(base)} AND NOT {has(word.rstrip(')'), rest)})"
    if rule.key == "W001" and rule.family == "python":
        base = rule.pattern.split("(?!")[0]
        return f"({has(base)} AND NOT {has(base + r'.*#\s*debug')})"
    if rule.key == "B001" and rule.family == "python":
        return has(r"if\s+\w+\s*=[^=]")
    if rule.key == "E501":
        return f"length({line}) > {v.MAX_LINE_LENGTH}"
    return has(rule.pattern)


# ---- corpora -------------------------------------------------------------

def family_files(family: str, table: str = "documents") -> str:
    return f"""SELECT source AS project, lang || '/d' || doc_id || '{c.FAMILY_EXTENSION[family]}' AS path,
      text || {NL} || {pick(snippets(family), 'doc_id')} AS content, '{family}' AS family FROM {table}"""


def plain_files(family: str) -> str:
    return f"""SELECT source AS project, lang || '/d' || doc_id || '{c.FAMILY_EXTENSION[family]}' AS path,
      text AS content, '{family}' AS family FROM documents"""


def page_files() -> str:
    return """SELECT split_part(url, ':', 1) AS project, 'p' || page_id || '.js' AS path, html AS content,
      'javascript' AS family FROM pages"""


def block_files() -> str:
    text = "text"
    for word, becomes in c.BLOCK_WORDS:
        text = f"replace({text}, {q(word)}, {q(becomes)})"
    return f"""SELECT source AS project, lang || '/d' || doc_id || '.js' AS path,
      {text} || {NL} || {pick(snippets('javascript'), 'doc_id')} AS content, 'javascript' AS family FROM documents"""


def tree_files() -> str:
    n = "doc_id"
    return f"""SELECT source AS project, lang || '/' || {pick(c.TREE_DIRS, n)} || {n} || '/' ||
      CASE WHEN {n} % 13 < {len(c.TREE_NAMES)} THEN {pick(c.TREE_NAMES, f'({n} % 13)')}
      ELSE 'd' || {n} || {pick(c.TREE_EXTENSIONS, n)} END AS path, text AS content FROM documents"""


def base_name(path: str = "path") -> str:
    return f"regexp_extract({path}, '[^/]*$')"


def extension(path: str = "path") -> str:
    return f"lower(regexp_extract({base_name(path)}, '^\\.*[^.].*(\\.[^.]*)$', 1))"


def language(path: str = "path") -> str:
    cases = " ".join(f"WHEN '{e}' THEN '{lang}'" for e, lang in v.LANGUAGES.items())
    return f"CASE {extension(path)} {cases} ELSE 'generic' END"


def family_of(lang: str) -> str:
    return f"CASE WHEN {lang} = 'python' THEN 'python' WHEN {lang} IN ('javascript', 'typescript') THEN 'javascript' ELSE 'generic' END"


def python_source(text: str, n: str) -> str:
    return f"""'# ' || replace({text}, {NL}, {NL} || '# ') || {NL} || '# ' || {pick(snippets('python'), n)} || {NL} ||
      'def f' || {n} || '(' || array_to_string(list_concat(['a' || i FOR i IN range({n} % 10)],
        CASE WHEN {n} % 4 = 0 THEN ['z=[]'] ELSE [] END), ', ') || '):' || {NL} || '    print(0)' || {NL} ||
      repeat('    if x: pass' || {NL}, {n} % 13) ||
      CASE WHEN {n} % 3 = 0 THEN '    def g(y=[]):' || {NL} || '        for i in y: pass' || {NL} ELSE '' END ||
      '    return 0' || {NL} || CASE WHEN {n} % 5 = 0 THEN 'class C:' || {NL} || '    pass' || {NL} ELSE '' END ||
      CASE WHEN {n} % 17 = 0 THEN 'def (' || {NL} ELSE '' END"""


def review_files() -> str:
    n = "doc_id // 21"
    ext = pick(c.REVIEW_EXTENSIONS, "doc_id")
    js = "ext IN ('.js', '.ts', '.jsx', '.tsx', '.Ts')"
    return f"""SELECT source AS project, lang || '/d' || doc_id || ext AS path,
      CASE WHEN ext IN ('.py', '.PY') THEN {python_source('text', 'n')}
        WHEN {js} THEN text || {NL} || {pick(snippets('javascript'), 'n')}
        ELSE text || {NL} || {pick(snippets('generic'), 'n')} END AS content,
      CASE WHEN ext IN ('.py', '.PY') THEN 'python' WHEN {js} THEN 'javascript' ELSE 'generic' END AS family, n, text
      FROM (SELECT *, {ext} AS ext, {n} AS n FROM documents)"""


def python_files() -> str:
    return f"""SELECT source AS project, lang || '/d' || doc_id || '.py' AS path, {python_source('text', 'doc_id')} AS content,
      'python' AS family, doc_id AS n, text FROM documents"""


def answers() -> str:
    bullets = f"'- ' || replace(text, '. ', {NL} || '- ')"
    return f"""SELECT conv_id, turn, CASE (conv_id * 3 + turn) % 6
      WHEN 0 THEN 'SUMMARY: ' || text || {q(chr(10) * 2 + 'ISSUES:' + chr(10) + '- one' + chr(10) * 2 + 'SUGGESTIONS:' + chr(10))} || {bullets}
      WHEN 1 THEN text
      WHEN 2 THEN 'ISSUES:' || {NL} || {bullets} || {NL} || 'SUMMARY: late'
      WHEN 3 THEN 'SUMMARY:' || text || {NL} || 'SUGGESTIONS:' || {NL} || text || {q(chr(10) + '-' + chr(10) + 'SUMMARY x' + chr(10) + '- y')}
      WHEN 4 THEN ''
      ELSE {q('SUMMARY:  ' + chr(10) + 'ISSUES: none' + chr(10) + 'SUGGESTIONS:' + chr(10))} || replace(text, ', ', {NL} || '  -  ') END AS text
      FROM conversations WHERE role = 'assistant'"""


# ---- shared steps --------------------------------------------------------

def lines(files: str = "files") -> str:
    """Lines with the block-comment state as a running window."""
    return f"""SELECT project, path, family, line_no, line, {strip('line')} AS stripped,
      family = 'javascript' AND (contains(line, '*/') OR coalesce(state, false)) AS skipped
    FROM (
      SELECT *, last_value(CASE WHEN contains(line, '*/') THEN false WHEN contains(line, '/*') THEN true END IGNORE NULLS)
        OVER (PARTITION BY project, path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state
      FROM (
        SELECT project, path, family, unnest(pieces) AS line, generate_subscripts(pieces, 1) AS line_no
        FROM (SELECT *, CASE WHEN family <> 'generic' THEN string_split(content, {NL})
            WHEN content = '' THEN [] WHEN ends_with(content, {NL})
            THEN string_split(left(content, length(content) - 1), {NL}) ELSE string_split(content, {NL}) END AS pieces
          FROM {files})))"""


def line_class() -> str:
    return """CASE WHEN skipped THEN 'comment' WHEN stripped = '' THEN 'blank'
      WHEN family = 'python' AND starts_with(stripped, '#') THEN 'comment'
      WHEN family = 'javascript' AND starts_with(stripped, '//') THEN 'comment' ELSE 'code' END"""


def rule_findings(rules: list[r.Rule]) -> str:
    parts = []
    for x in rules:
        snippet = "'[REDACTED]'" if x.snippet_len < 0 else f"left(stripped, {x.snippet_len})" if x.snippet_len else "''"
        message = "'Line too long (' || length(line) || ' > 120 characters)'" if x.key == "E501" else q(x.message)
        parts.append(
            f"""SELECT project, path AS file, CAST(line_no AS INTEGER) AS line, {120 if x.key == 'E501' else 0} AS "column",
      '{x.severity}' AS severity, '{x.category}' AS category, '{x.rule}' AS rule, {message} AS message,
      {q(x.suggestion)} AS suggestion, {snippet} AS code_snippet, CAST(line_no AS BIGINT) * 1000000000 + {x.number} AS ord
      FROM lines WHERE family = '{x.family}' AND NOT skipped AND {matches(x)}"""
        )
    return "\nUNION ALL\n".join(parts)


def counts() -> str:
    return f"""SELECT project, path, family, count(*) AS lines_total,
      count(*) FILTER (k = 'code') AS lines_code, count(*) FILTER (k = 'comment') AS lines_comment,
      count(*) FILTER (k = 'blank') AS lines_blank
      FROM (SELECT *, {line_class()} AS k FROM lines) GROUP BY ALL"""


def js_facts(files: str = "files") -> str:
    decisions = " + ".join(
        f"CAST((length(content) - length(replace(content, {q(m)}, ''))) / {len(m)} AS BIGINT)" for m in v.JS_DECISION_MARKERS
    )
    return f"""SELECT *, decisions / greatest(functions, 1) AS complexity FROM (
      SELECT project, path, len(regexp_extract_all(content, {q(re2(JS_FUNCTION_PATTERN))})) AS functions,
        len(regexp_extract_all(content, {q(re2(JS_CLASS_PATTERN))})) AS classes, {decisions} AS decisions
      FROM {files} WHERE family = 'javascript')"""


def functions(files: str = "files") -> str:
    """The functions of the derived Python files, from how they were made."""
    start = f"length(text) - length(replace(text, {NL}, '')) + 3"
    return f"""SELECT project, path, 'f' || n AS name, {start} AS line, 0 AS col, n % 10 + CASE WHEN n % 4 = 0 THEN 1 ELSE 0 END AS n_args,
        n % 4 = 0 AS mutable_default, 1 + n % 13 + CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END AS complexity, 1 AS place
      FROM {files} WHERE family = 'python' AND n % 17 <> 0
      UNION ALL
      SELECT project, path, 'g', {start} + 2 + n % 13, 4, 1, true, 2, 2
      FROM {files} WHERE family = 'python' AND n % 17 <> 0 AND n % 3 = 0"""


def tree_findings() -> str:
    head = "SELECT project, path AS file, CAST(line AS INTEGER) AS line, CAST(col AS INTEGER) AS \"column\""
    order = "CAST(2000000000000000000 AS BIGINT) + place * 1000000000"
    last = f"length(content) - length(replace(content, {NL}, ''))"
    return f"""{head}, 'warning' AS severity, 'complexity' AS category, 'C001' AS rule,
        'Function "' || name || '" has high complexity (' || complexity || ')' AS message,
        'Consider breaking into smaller functions' AS suggestion, '' AS code_snippet, {order} + 1 AS ord
      FROM functions WHERE complexity > 10
      UNION ALL {head}, 'warning', 'complexity', 'C002', 'Function "' || name || '" has too many arguments (' || n_args || ')',
        'Consider using a config object or dataclass', '', {order} + 2 FROM functions WHERE n_args > 7
      UNION ALL {head}, 'error', 'bug', 'B012', 'Mutable default argument in function "' || name || '"',
        'Use None as default and initialize inside function', '', {order} + 3 FROM functions WHERE mutable_default
      UNION ALL SELECT project, path, CAST({last} AS INTEGER), 5, 'critical', 'syntax', 'E001', 'Syntax error: invalid syntax', '', '',
        CAST(2000000000000000000 AS BIGINT) FROM files WHERE family = 'python' AND n % 17 = 0"""


def maintainability(code: str, cc: str) -> str:
    return f"""CASE WHEN {code} = 0 THEN 100.0 ELSE round(greatest(0.0, least(100.0,
      (171 - 21.4 * ln({code} + 1) - 0.23 * greatest({cc}, 1.0)) * 100 / 171)), 1) END"""


def file_metrics() -> str:
    """Needs files, counts, functions, js."""
    js_index = "greatest(0.0, least(100.0, 100.0 - j.complexity * 3 - lines_code / 100))"
    return f"""SELECT c.project, c.path AS filepath, lines_total, lines_code, lines_comment, lines_blank,
        coalesce(f.functions, j.functions, 0) AS functions,
        CASE WHEN c.family = 'python' THEN CASE WHEN x.n % 17 <> 0 AND x.n % 5 = 0 THEN 1 ELSE 0 END ELSE coalesce(j.classes, 0) END AS classes,
        CAST(coalesce(f.complexity, j.complexity, 0) AS DOUBLE) AS complexity,
        CAST(CASE c.family WHEN 'python' THEN CASE WHEN x.n % 17 = 0 THEN 0 ELSE {maintainability('lines_code', 'f.complexity')} END
          WHEN 'javascript' THEN {js_index} ELSE 0 END AS DOUBLE) AS maintainability
      FROM counts c JOIN files x USING (project, path)
      LEFT JOIN js j USING (project, path)
      LEFT JOIN (SELECT project, path, count(*) AS functions, avg(complexity) AS complexity FROM functions GROUP BY ALL) f
        USING (project, path)"""


def with_(final: str, **steps: str) -> str:
    """A query with named steps, each computed once."""
    return "WITH " + ",\n".join(f"{k} AS MATERIALIZED ({s})" for k, s in steps.items()) + "\n" + final


def review(final: str, **more: str) -> str:
    """A query over the findings and metrics of ``review_files``."""
    steps = {
        "files": review_files(), "lines": lines(), "functions": functions(),
        "findings": rule_findings(r.ALL_RULES) + "\nUNION ALL\n" + tree_findings(),
        "counts": counts(), "js": js_facts(), "metrics": file_metrics(), **more,
    }
    return with_(final, **steps)
