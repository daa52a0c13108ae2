"""Lines x rules -> findings.

The theta join of lines with the rule catalogue is written as one projection per
line: every rule is a literal predicate, the numbers of the rules that hold are
collected in an array and exploded.  No join, no shuffle, and patterns compile
once per task.
"""

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lineglass.functions import vocabulary as v
from lineglass.functions import anchors
from lineglass.functions.anchors import Waker
from lineglass.functions.rules import ALL_RULES, LONG_LINE, Rule
from lineglass.functions.text import fold_case, java_regex, sql_text, strip

# Findings of one file are ordered by stage, then position, then rule.
# A rule's number and a line's have nine digits each at least.
STAGE = 2 * 10**18
SLOT = 10**9
STAGES = {"lines": 0, "tree": 1, "flake8": 2, "bandit": 3}

FINDING_COLUMNS = [
    "project", "file", "line", "column", "severity", "category", "rule",
    "message", "suggestion", "code_snippet", "ord",
]


def finding_order(stage: str, position: Column, slot) -> Column:
    """Append order within a file as one sortable number."""
    slot = slot if isinstance(slot, Column) else F.lit(slot)
    return F.lit(STAGES[stage] * STAGE) + position.cast("bigint") * SLOT + slot.cast("bigint")


def _gates(rules: list[Rule]) -> dict[str, str]:
    """Single characters shared by many rules -> name of the column that holds the test."""
    singles = sorted({alt for r in rules for need in r.needs for alt in need.split("|") if len(alt) == 1})
    return {c: f"_has_{ord(c)}" for c in singles}


def rule_condition(rule: Rule, gates: dict[str, str]) -> str:
    """Does the rule hold on ``line``?  Cheap necessary literals first, then the pattern.

    Conditions are SQL text: a catalogue is hundreds of expressions, and one parse
    is far quicker than as many calls into the JVM.
    """
    if rule.key == LONG_LINE.key and not rule.pattern:
        return f"length(line) > {v.MAX_LINE_LENGTH}"

    def has(literal: str) -> str:
        if literal in gates:
            return gates[literal]
        text, needle = ("_folded", literal.lower()) if rule.ignore_case else ("line", literal)
        return f"contains({text}, {sql_text(needle)})"

    needed = ["(" + " OR ".join(has(x) for x in need.split("|")) + ")" for need in rule.needs]
    if rule.java:
        pattern = ("(?diu)" if rule.ignore_case else "(?d)") + rule.pattern
    else:
        pattern = java_regex(rule.pattern, rule.ignore_case)
    test = f"({rule.test})" if rule.test else f"line RLIKE {sql_text(pattern)}"
    return " AND ".join([*filter(None, [rule.precheck]), *needed, test])


def _rule_hits(rules: list[Rule], gates: dict[str, str]) -> dict[str, str]:
    """Per family the slots (places in ``rules``) of the rules that hold on a line."""
    hits = {}
    for family in dict.fromkeys(r.family for r in rules):
        slots = [
            f"IF({rule_condition(r, gates)}, {slot}, 0)" for slot, r in enumerate(rules, 1) if r.family == family
        ]
        hits[family] = f"array_remove(array({', '.join(slots)}), 0)"
    return hits


def _rule_rows(rules: list[Rule]) -> str:
    """The catalogue as one constant array, looked up by slot."""
    rows = [
        f"named_struct('number', {r.number}, 'severity', {sql_text(r.severity)}, 'category', {sql_text(r.category)}, "
        f"'rule', {sql_text(r.rule)}, 'message', {sql_text(r.message)}, 'suggestion', {sql_text(r.suggestion)}, "
        f"'snippet_len', {r.snippet_len})"
        for r in rules
    ]
    return f"array({', '.join(rows)})"


def _rendered(lines: DataFrame, keep: tuple = ()) -> DataFrame:
    """Attach a matched rule ``r`` to its line and shape the finding; secrets never leave."""
    line = F.col("line")
    return lines.select(
        "project",
        F.col("path").alias("file"),
        F.col("line_no").cast("int").alias("line"),
        F.when(F.col("r.rule") == LONG_LINE.rule, v.MAX_LINE_LENGTH).otherwise(0).alias("column"),
        F.col("r.severity").alias("severity"),
        F.col("r.category").alias("category"),
        F.col("r.rule").alias("rule"),
        F.when(
            F.col("r.rule") == LONG_LINE.rule,
            F.replace(F.col("r.message"), F.lit("{n}"), F.length(line).cast("string")),
        ).otherwise(F.col("r.message")).alias("message"),
        F.col("r.suggestion").alias("suggestion"),
        F.when(F.col("r.category") == "secret", F.lit(v.REDACTED))
        .when(F.col("r.snippet_len") > 0, F.substring(strip(line), F.lit(1), F.col("r.snippet_len")))
        .otherwise("").alias("code_snippet"),
        finding_order("lines", F.col("line_no"), F.col("r.number")).alias("ord"),
        *keep,
    )


def scan_rules(lines: DataFrame, rules: list[Rule] = ALL_RULES, keep: tuple = ()) -> DataFrame:
    """All findings of the line rules.  ``lines`` as made by ``explode_lines``.

    Works on streams too; ``keep`` names further columns to pass on.
    """
    gates = _gates(rules)
    prepared = lines.filter(~F.col("skipped")).select(
        "project", "path", "family", "line_no", "line", *keep,
        fold_case(F.col("line")).alias("_folded"),
        *[F.contains(F.col("line"), F.lit(c)).alias(name) for c, name in gates.items()],
    )
    hits = _rule_hits(rules, gates)
    # The largest family is evaluated one operator earlier than the others: together
    # they would make a method too large for the JVM to compile.
    largest = max(hits, key=lambda x: len(hits[x]))
    tried = prepared.select(
        "*", F.expr(f"IF(family = {sql_text(largest)}, {hits[largest]}, NULL)").alias("_first_hits")
    )
    others = "".join(f" WHEN {sql_text(f)} THEN {h}" for f, h in hits.items() if f != largest)
    slots = F.expr(f"CASE family WHEN {sql_text(largest)} THEN _first_hits{others} END")
    matched = tried.select("project", "path", "line_no", "line", *keep, F.explode(slots).alias("slot"))
    return _rendered(matched.withColumn("r", F.expr(f"element_at({_rule_rows(rules)}, slot)")), keep)


# The automata travel with the function; executors need not import them.
cloudpickle.register_pickle_by_value(anchors)


def _woken(wakers: dict):
    """Numbers of the patterns of a line's family whose literals the line holds."""

    @pandas_udf("array<int>")
    def woken(family: pd.Series, line: pd.Series) -> pd.Series:
        out = []
        for f, text in zip(family, line):
            waker = wakers.get(f)
            out.append(waker.met(text or "") if waker is not None else [])
        return pd.Series(out)

    return woken


def scan_rule_table(lines: DataFrame, rules: DataFrame, wake: bool = True) -> DataFrame:
    """Findings for a rule table ``(family, number, rule, pattern, ignore_case, severity,
    category, message, suggestion, snippet_len)``.

    Patterns are in Java syntax and taken as they are. The table is configuration. Each
    pattern is read for literals that all its matches hold, and one Aho-Corasick
    automaton a family over all of them wakes, for each line, the rules that it may
    match; only those are tried, by Java's own matcher, a pattern that several rules share
    once. Patterns without such literals are tried on every line. A table of any size is one pass over the lines, with no join
    and no shuffle. ``wake=False`` tries every rule on every line, the plain path with the
    same findings. Rows without a family, number or pattern are left out; an empty table
    gives no rows.
    """
    rows = rules.where("family IS NOT NULL AND number IS NOT NULL AND pattern IS NOT NULL").collect()
    made = [
        Rule(r.family, "custom", r.rule or "", r.rule or "", r.pattern, bool(r.ignore_case), r.severity or "", r.category or "",
             r.message or "", r.suggestion or "", r.snippet_len or 0, (), r.number, java=True)
        for r in sorted(rows, key=lambda r: (r.family, r.number, r.rule or "", r.pattern))
    ]
    if not made:
        return scan_rules(lines, [LONG_LINE]).where(F.lit(False))
    # Rules of one family and pattern are tried together, once a line.
    same: dict[tuple, list[int]] = {}
    for slot, r in enumerate(made, 1):
        same.setdefault((r.family, ("(?diu)" if r.ignore_case else "(?d)") + r.pattern, r.pattern), []).append(slot)
    by_family: dict[str, dict[int, str]] = {}
    for number, (family, _, pattern) in enumerate(same, 1):
        by_family.setdefault(family, {})[number] = pattern
    java = [p for _, p, _ in same]
    patterns = f"array({', '.join(map(sql_text, java))})"
    slots = f"array({', '.join(f"array({', '.join(map(str, x))})" for x in same.values())})"
    per_family = lambda of: "CASE family " + " ".join(
        f"WHEN {sql_text(f)} THEN {of(numbers)}" for f, numbers in by_family.items()
    ) + " ELSE CAST(array() AS array<int>) END"
    prepared = lines.filter(~F.col("skipped")).select("project", "path", "family", "line_no", "line")
    always: dict[str, list[int]] = {}
    if wake:
        wakers = {family: Waker(p) for family, p in by_family.items()}
        always = {family: w.always for family, w in wakers.items() if w.always}
        candidates = _woken(wakers)(F.col("family"), F.col("line"))
    else:
        candidates = F.expr(per_family(lambda numbers: f"array({', '.join(map(str, numbers))})"))
    # Patterns that no literal wakes are constants of the plan, compiled once a task.
    tested = " ".join(
        f"WHEN {sql_text(f)} THEN array_remove(array({', '.join(f'IF(line RLIKE {sql_text(java[n - 1])}, {n}, 0)' for n in numbers)}), 0)"
        for f, numbers in always.items()
    )
    found = f"filter(_woken, n -> line RLIKE element_at({patterns}, n))"
    if tested:
        found = f"concat({found}, CASE family {tested} ELSE CAST(array() AS array<int>) END)"
    tried = prepared.withColumn("_woken", candidates).withColumn(
        "_hits", F.expr(f"flatten(transform({found}, n -> element_at({slots}, n)))")
    )
    matched = tried.select("project", "path", "line_no", "line", F.explode("_hits").alias("slot"))
    return _rendered(matched.withColumn("r", F.expr(f"element_at({_rule_rows(made)}, slot)")))
