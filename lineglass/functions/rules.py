"""The rule catalogue.  A rule is a row; packs are lists of rows in report order."""

from dataclasses import dataclass, replace

from lineglass.functions.text import java_regex, sql_text
from lineglass.functions.vocabulary import REDACTED

# Rule ids, patterns, severities and messages of each pack.
PYTHON_SECURITY = [
    ("S001", "critical", r"\beval\s*\(", "Use of eval() is dangerous - can execute arbitrary code"),
    ("S002", "critical", r"\bexec\s*\(", "Use of exec() is dangerous - can execute arbitrary code"),
    ("S003", "warning", r"__import__\s*\(", "Dynamic import can be dangerous"),
    ("S004", "error", r"subprocess\.call\s*\([^)]*shell\s*=\s*True", "shell=True in subprocess is dangerous"),
    ("S005", "error", r"os\.system\s*\(", "os.system() is vulnerable to shell injection"),
    ("S006", "error", r"pickle\.loads?\s*\(", "Pickle can execute arbitrary code during deserialization"),
    ("S007a", "error", r"yaml\.load\s*\([^)]*Loader\s*=\s*None", "Use yaml.safe_load() instead"),
    ("S007b", "warning", r"yaml\.load\s*\([^)]*\)(?!.*Loader)", "Use yaml.safe_load() or specify Loader"),
    ("S009", "warning", r"assert\s+\w+.*#.*security", "Assert statements removed with -O flag"),
    ("S010", "warning", r"hashlib\.md5\s*\(", "MD5 is cryptographically weak"),
    ("S011", "warning", r"hashlib\.sha1\s*\(", "SHA1 is cryptographically weak"),
    ("S012", "info", r"random\.[^(]+\([^)]*\)(?!.*secrets)", "Use secrets module for security-sensitive randomness"),
]
PYTHON_SECRET = [
    ("SEC001", True, r"(password|passwd|pwd)\s*=\s*[\"'][^\"']{4,}[\"']", "Hardcoded password detected"),
    ("SEC002", True, r"(api_key|apikey|api-key)\s*=\s*[\"'][^\"']{8,}[\"']", "Hardcoded API key detected"),
    ("SEC003", True, r"(secret|token)\s*=\s*[\"'][a-zA-Z0-9_\-]{16,}[\"']", "Hardcoded secret/token detected"),
    ("SEC004", True, r"aws_access_key_id\s*=\s*[\"']AKIA[A-Z0-9]{16}[\"']", "AWS access key detected"),
    ("SEC005", False, r"-----BEGIN\s+(RSA\s+)?PRIVATE\s+KEY-----", "Private key in source code"),
    ("SEC006", False, r"ghp_[a-zA-Z0-9]{36}", "GitHub personal access token detected"),
    ("SEC007", False, r"sk-[a-zA-Z0-9]{32,}", "Potential OpenAI API key detected"),
    ("SEC008", False, r"xox[baprs]-[0-9]{10,}", "Slack token detected"),
]
PYTHON_STYLE = [
    ("W001", r"^\s*print\s*\((?!.*#\s*debug)", "Debug print statement found"),
    ("W002", r"#\s*TODO[:\s]", "TODO comment found"),
    ("W003", r"#\s*FIXME[:\s]", "FIXME comment found"),
    ("W004", r"#\s*HACK[:\s]", "HACK comment found"),
    ("W005", r"#\s*XXX[:\s]", "XXX comment found"),
    ("W006", r"except\s*:", "Bare except clause - specify exception type"),
    ("W007", r"from\s+\S+\s+import\s+\*", "Star import pollutes namespace"),
    ("W008", r"^\s{200,}", "Extremely long line"),
]
PYTHON_BUG = [
    ("B001", r"if\s+\w+\s*=(?!=)\s*[^=]", "Assignment in if condition - use == for comparison"),
    ("B002", r"except\s+\w+\s*,\s*\w+", "Old-style except syntax (Python 2)"),
    ("B003", r"==\s*None", 'Use "is None" instead of "== None"'),
    ("B004", r"!=\s*None", 'Use "is not None" instead of "!= None"'),
    ("B005", r"==\s*True\b", 'Use "if x:" instead of "if x == True"'),
    ("B006", r"==\s*False\b", 'Use "if not x:" instead of "if x == False"'),
    ("B007", r"\btype\s*\(\s*\w+\s*\)\s*==", "Use isinstance() instead of type() comparison"),
    ("B008", r"len\s*\(\s*\w+\s*\)\s*==\s*0", 'Use "if not x:" instead of "if len(x) == 0"'),
    ("B009", r"except\s+BaseException\b", "Catching BaseException catches SystemExit/KeyboardInterrupt"),
    ("B010", r"\.append\s*\(\s*\)\.", "append() returns None, chaining will fail"),
    ("B011", r"return\s+\[\s*\]\.append", "append() returns None"),
]
JS_SECURITY = [
    ("S001", "critical", r"\beval\s*\(", "Use of eval() is dangerous"),
    ("S002", "error", r"innerHTML\s*=", "innerHTML can lead to XSS vulnerabilities"),
    ("S003", "error", r"document\.write\s*\(", "document.write can lead to XSS"),
    ("S004", "warning", r"\.html\s*\([^)]+\)", "jQuery .html() can lead to XSS"),
    ("S005", "warning", r"dangerouslySetInnerHTML", "dangerouslySetInnerHTML can lead to XSS"),
    ("S006", "error", r"new\s+Function\s*\(", "new Function() is similar to eval()"),
    ("S007", "error", r"setTimeout\s*\(\s*[\"']", "setTimeout with string argument is like eval()"),
    ("S008", "error", r"setInterval\s*\(\s*[\"']", "setInterval with string argument is like eval()"),
]
JS_SECRET = [
    ("SEC001", True, r"(password|passwd|pwd)\s*[=:]\s*[\"'][^\"']{4,}[\"']", "Hardcoded password"),
    ("SEC002", True, r"(api[_-]?key|apikey)\s*[=:]\s*[\"'][^\"']{8,}[\"']", "Hardcoded API key"),
    ("SEC003", True, r"(secret|token)\s*[=:]\s*[\"'][a-zA-Z0-9_\-]{16,}[\"']", "Hardcoded secret"),
]
JS_STYLE = [
    ("W001", r"console\.log\s*\(", "console.log statement found"),
    ("W002", r"\bdebugger\s*;?", "debugger statement found"),
    ("W003", r"//\s*TODO", "TODO comment found"),
    ("W004", r"//\s*FIXME", "FIXME comment found"),
    ("W005", r"\bvar\s+\w+", "Use let or const instead of var"),
]
JS_BUG = [
    ("B001", r"if\s*\([^)]*=[^=][^)]*\)", "Possible assignment in condition"),
    ("B002", r"==\s*null\b", "Use === for strict null comparison"),
    ("B003", r"!=\s*null\b", "Use !== for strict null comparison"),
    ("B004", r"\btypeof\s+\w+\s*==\s*", "Use === with typeof"),
]
GENERIC_SECRET = [
    ("SEC001", True, r"(password|passwd|pwd)\s*[=:]\s*[\"'][^\"']{4,}[\"']", "Possible hardcoded password"),
    ("SEC002", True, r"(api[_-]?key|apikey)\s*[=:]\s*[\"'][^\"']{8,}[\"']", "Possible hardcoded API key"),
    ("SEC003", True, r"(secret|token)\s*[=:]\s*[\"'][a-zA-Z0-9_\-]{16,}[\"']", "Possible hardcoded secret"),
    ("SEC004", True, r"-----BEGIN\s+(RSA\s+)?PRIVATE\s+KEY-----", "Private key in code"),
]
GENERIC_STYLE = [
    ("W001", r"TODO", "TODO comment"),
    ("W002", r"FIXME", "FIXME comment"),
    ("W003", r"HACK", "HACK comment"),
]
SECRET_SUGGESTION = "Move to environment variables or secrets manager"

# Literals a line must contain for a pattern to match at all ('|' separates
# alternatives, every entry of the tuple is needed).  They let the scan skip the
# regular expression on nearly every line.  Single characters are tested once
# per line and shared by all rules that need them.  Some literals are cut short
# ("xec", "bugger"): the rest of the word adds little to the test.
NEEDS = {
    "python": {
        "S001": ("(", "val"), "S002": ("(", "xec"), "S003": ("(", "__import__"),
        "S004": ("(", "=", ".call"), "S005": ("(", ".system"), "S006": ("(", ".load"),
        "S007a": ("(", "=", ".load"), "S007b": ("(", ".load"), "S009": ("#", "assert"),
        "S010": ("(", ".md5"), "S011": ("(", ".sha1"), "S012": ("(", "random."),
        "SEC001": ("=", "password|passwd|pwd"), "SEC002": ("=", "api_key|apikey|api-key"),
        "SEC003": ("=", "secret|token"), "SEC004": ("=", "aws_access_key_id"),
        "SEC005": ("-", "-----BEGIN"), "SEC006": ("ghp_",), "SEC007": ("-", "sk-"), "SEC008": ("-", "xox"),
        "W001": ("(", "print"), "W002": ("#", "TODO"), "W003": ("#", "FIXME"), "W004": ("#", "HACK"),
        "W005": ("#", "XXX"), "W006": (":", "xcept"), "W007": ("*", "import"), "W008": (),
        "B001": ("=", "if"), "B002": (",", "xcept"), "B003": ("=", "None"), "B004": ("=", "None"),
        "B005": ("=", "True"), "B006": ("=", "False"), "B007": ("(", "=", "type"), "B008": ("(", "=", "len"),
        "B009": ("BaseException",), "B010": ("(", ".append"), "B011": ("[", ".append"),
    },
    "javascript": {
        "S001": ("(", "eval"), "S002": ("=", "innerhtml"), "S003": ("(", "document.write"),
        "S004": ("(", ".html"), "S005": ("ysetinnerhtml",), "S006": ("(", "function"),
        "S007": ("(", "settimeout"), "S008": ("(", "setinterval"),
        "SEC001": ("=|:", "password|passwd|pwd"), "SEC002": ("=|:", "api"), "SEC003": ("=|:", "secret|token"),
        "W001": ("(", "console.log"), "W002": ("bugger",), "W003": ("/", "TODO"), "W004": ("/", "FIXME"),
        "W005": ("var",),
        "B001": ("(", "=", "if"), "B002": ("=", "null"), "B003": ("=", "null"), "B004": ("=", "typeof"),
    },
    "generic": {
        "SEC001": ("=|:", "password|passwd|pwd"), "SEC002": ("=|:", "api"), "SEC003": ("=|:", "secret|token"),
        "SEC004": ("-", "-----begin"), "W001": ("todo",), "W002": ("xme",), "W003": ("hack",),
    },
}


# The line cut at its closing brackets, and the parts that one or two of them follow.
_PARTS = "split(line, '[)]', -1)"
_CLOSED, _CLOSED_TWICE = (f"slice({_PARTS}, 1, greatest(0, size({_PARTS}) - {n}))" for n in (1, 2))


def _like(text: str, pattern: str, ignore_case: bool = True) -> str:
    return f"{text} RLIKE {sql_text(java_regex(pattern, ignore_case))}"


def _last(parts: str, test: str) -> str:
    """The place of the last part that passes, or -1."""
    return f"coalesce(array_max(transform({parts}, (part, n) -> if({test}, n, -1))), -1)"


def _in_call(start: str, inside: str) -> str:
    """``start``, then ``inside`` before the first closing bracket, in linear time.

    As one pattern this tries every start against every end. Cut at the brackets, each
    part is searched from its first start only, since what follows a later start also
    follows the first.
    """
    first = f"regexp_instr(part, {sql_text(java_regex(start, True))})"
    return f"exists({_PARTS}, part -> {first} > 0 AND {_like(f'substring(part, {first})', inside)})"


IF_OPEN = r"if\s*\("


def _assigning_call() -> str:
    """A condition with a single equals sign; right before its bracket, only if another follows."""
    first = f"regexp_instr(part, {sql_text(java_regex(IF_OPEN))})"
    rest = f"substring(part, {first})"
    within = f"exists({_CLOSED}, part -> {first} > 0 AND {_like(rest, '=[^=]', False)})"
    return f"{within} OR exists({_CLOSED_TWICE}, part -> {first} > 0 AND endswith({rest}, '='))"


def _closed_call_without(start: str, word: str) -> str:
    """A closed call after whose bracket the word does not come; the last call decides."""
    opened = _last(_CLOSED, _like("part", start))
    return f"{opened} >= 0 AND {_last(_PARTS, _like('part', word))} <= {opened}"


def _random_without_secrets() -> str:
    """The same for calls whose name may hold closing brackets: cut at the opening ones."""
    head = "left(line, length(line) - length(substring_index(line, ')', -1)))"
    opening = f"split({head}, '[(]', -1)"
    opened = _last(f"slice({opening}, 1, greatest(0, size({opening}) - 1))", _like("part", r"random\.[^(]"))
    tail = f"array_join(slice(split(line, '[(]', -1), {opened} + 2, 1000000000), '(')"
    return f"{opened} >= 0 AND NOT {_like(f'substring({tail}, locate({sql_text(chr(41))}, {tail}) + 1)', 'secrets')}"


def _security_comment() -> str:
    """An assertion, then a comment that names security, searched from the first of each."""
    start = sql_text(java_regex(r"assert\s+\w", True))
    rest = f"substring(line, regexp_instr(line, {start}) + length(regexp_substr(line, {start})))"
    named = sql_text(java_regex("security", True))
    return f"locate('#', {rest}) > 0 AND substring({rest}, locate('#', {rest}) + 1) RLIKE {named}"


# Patterns that would take quadratic or cubic time on long lines, taken apart.
TESTS = {
    ("python", "S004"): _in_call(r"subprocess\.call\s*\(", r"shell\s*=\s*True"),
    ("python", "S007a"): _in_call(r"yaml\.load\s*\(", r"Loader\s*=\s*None"),
    ("python", "S007b"): _closed_call_without(r"yaml\.load\s*\(", "Loader"),
    ("python", "S009"): _security_comment(),
    ("python", "S012"): _random_without_secrets(),
    ("javascript", "S004"): f"exists({_CLOSED}, part -> {_like('part', r'\.html\s*\([^)]')})",
    ("javascript", "B001"): _assigning_call(),
}


# Cheap necessary conditions that are not literals: a line that starts with a blank
# starts below "!" or outside ASCII.
PRECHECKS = {"python": {"W008": "(line < '!' OR line >= '\\u0080')"}}


@dataclass(frozen=True)
class Rule:
    """One line rule.  ``number`` is its place in the family's evaluation order."""

    family: str
    pack: str
    key: str
    rule: str
    pattern: str
    ignore_case: bool
    severity: str
    category: str
    message: str
    suggestion: str
    snippet_len: int
    needs: tuple = ()
    number: int = 0
    precheck: str = ""
    # SQL on ``line`` in place of the pattern, with the same hits in linear time.
    test: str = ""
    # The pattern is in Java syntax and is not rewritten.
    java: bool = False


def _family(name, security, secret, style, bug, *, secret_hint, secret_ic, style_ic, cuts):
    rows = []
    for key, severity, pattern, message in security:
        rows.append(Rule(name, "security", key, key[:4], pattern, True, severity, "security", message, "", cuts[0]))
    for key, ic, pattern, message in secret:
        rows.append(
            Rule(name, "secret", key, key, pattern, ic or secret_ic, "critical", "secret", message, secret_hint, -1)
        )
    for key, pattern, message in style:
        rows.append(Rule(name, "style", key, key, pattern, style_ic, "info", "style", message, "", cuts[1]))
    for key, pattern, message in bug:
        rows.append(Rule(name, "bug", key, key, pattern, False, "warning", "bug", message, "", cuts[1]))
    return [replace(r, needs=NEEDS[name][r.key], number=i, precheck=PRECHECKS.get(name, {}).get(r.key, ""), test=TESTS.get((name, r.key), "")) for i, r in enumerate(rows, 1)]


PYTHON_RULES = _family(
    "python", PYTHON_SECURITY, PYTHON_SECRET, PYTHON_STYLE, PYTHON_BUG,
    secret_hint=SECRET_SUGGESTION, secret_ic=False, style_ic=False, cuts=(100, 80),
)
JS_RULES = _family(
    "javascript", JS_SECURITY, JS_SECRET, JS_STYLE, JS_BUG,
    secret_hint="", secret_ic=False, style_ic=False, cuts=(100, 0),
)
GENERIC_RULES = _family(
    "generic", [], GENERIC_SECRET, GENERIC_STYLE, [],
    secret_hint="", secret_ic=True, style_ic=True, cuts=(0, 0),
)
LINE_RULES = PYTHON_RULES + JS_RULES + GENERIC_RULES

# The length rule is a plain comparison, evaluated after the Python patterns.
LONG_LINE = Rule(
    "python", "length", "E501", "E501", "", False, "info", "style",
    "Line too long ({n} > 120 characters)", "", 0, (), len(PYTHON_RULES) + 1,
)
ALL_RULES = LINE_RULES + [LONG_LINE]

# Further rules, not part of the catalogue: web tokens, and statements put together from
# text.  To be given to the scan beside it.
EXTRA_RULES = [
    Rule(family, "extra", key, key, pattern, False, severity, category, message, suggestion, cut, needs, number)
    for family in ("python", "javascript", "generic")
    for key, pattern, severity, category, message, suggestion, cut, needs, number in [
        ("X001", r"eyJ[A-Za-z0-9_\-]{8,}[.]eyJ[A-Za-z0-9_\-]{8,}[.][A-Za-z0-9_\-]{8,}", "critical", "secret",
         "JSON web token in source code", SECRET_SUGGESTION, -1, ("eyJ",), 901),
        ("X002", r"(SELECT|INSERT|UPDATE|DELETE)\s[^\"']*[\"']\s*(\+|%)\s*\w", "error", "security",
         "SQL statement put together from text", "Use query parameters", 100, ("+|%",), 902),
    ]
]

__all__ = ["EXTRA_RULES", "ALL_RULES", "GENERIC_RULES", "JS_RULES", "LINE_RULES", "LONG_LINE", "PYTHON_RULES", "REDACTED", "Rule"]
