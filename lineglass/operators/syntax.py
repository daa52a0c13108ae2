"""Python syntax: files -> node rows -> function and file facts.

Parsing is the only step that leaves the JVM.  It sends out plain node rows; each
row carries the list of functions that contain it, so counting a function's
decision points is an explode and a grouped sum with map-side combining instead
of a range join of nodes with functions.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineglass.functions import vocabulary as v
from lineglass.operators.scan import FINDING_COLUMNS, finding_order

NODE_SCHEMA = (
    "project string, path string, {keep} kind string, pre int, post int, bfs int, owners array<int>, "
    "name string, line int, col int, weight int, n_args int, mutable_default boolean, parse_error_msg string"
)


PART_ROWS = 2_000  # node rows that a parser gathers before it hands them out


def _parser(keep: tuple):
    """Build the batch function; it only uses what it imports itself, so executors need no package."""

    def node_rows(source: str) -> list:
        import ast
        import warnings

        # Node types that add one decision point.
        decisions = (
            ast.If, ast.While, ast.For, ast.AsyncFor, ast.ExceptHandler,
            ast.With, ast.AsyncWith, ast.Assert, ast.comprehension,
        )
        functions = (ast.FunctionDef, ast.AsyncFunctionDef)
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                tree = ast.parse(source)
        except SyntaxError as e:
            return [("error", 0, 0, 0, [0], "", e.lineno or 1, e.offset or 0, 0, 0, False, str(e.msg))]
        except Exception:
            return [("skipped", 0, 0, 0, [], "", 0, 0, 0, 0, False, None)]
        order = {id(n): i for i, n in enumerate(ast.walk(tree))}
        rows = [["module", 0, 0, 0, [], "", 0, 0, 0, 0, False, None]]
        slots, counter = {}, 0
        stack = [(tree, [], False)]
        while stack:
            node, owners, done = stack.pop()
            if done:
                rows[slots[id(node)]][2] = counter - 1
                continue
            pre, counter = counter, counter + 1
            if isinstance(node, functions):
                owners = owners + [pre]
                a = node.args
                mutable = any(isinstance(d, (ast.List, ast.Dict, ast.Set)) for d in [*a.defaults, *a.kw_defaults])
                rows.append(
                    ["function", pre, pre, order[id(node)], owners, node.name, node.lineno, node.col_offset,
                     0, len(a.args) + len(a.kwonlyargs), mutable, None]
                )
                slots[id(node)] = len(rows) - 1
                stack.append((node, owners, True))
            elif isinstance(node, ast.ClassDef):
                rows.append(["class", pre, pre, order[id(node)], owners, node.name, node.lineno, node.col_offset,
                             0, 0, False, None])
            else:
                weight = 1 if isinstance(node, decisions) else 0
                if isinstance(node, ast.BoolOp):
                    weight = len(node.values) - 1
                if weight and owners:
                    rows.append(["decision", pre, pre, order[id(node)], owners, type(node).__name__,
                                 getattr(node, "lineno", 0), getattr(node, "col_offset", 0), weight, 0, False, None])
            for child in reversed(list(ast.iter_child_nodes(node))):
                stack.append((child, owners, False))
        return rows

    def parse(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.string(), pa.int32(),
                 pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string()]
        names = ["project", "path", *keep, "kind", "pre", "post", "bfs", "owners", "name", "line", "col", "weight",
                 "n_args", "mutable_default", "parse_error_msg"]

        def made(batch, files, rows):
            files = pa.array(files, pa.int64())
            held = [batch.column(c).take(files).cast(t) for c, t in (("project", pa.string()), ("path", pa.string()))]
            held += [batch.column(c).take(files).cast(pa.int32()) for c in keep]
            cells = zip(*rows)
            return pa.RecordBatch.from_arrays([*held, *(pa.array(list(c), t) for c, t in zip(cells, kinds))], names)

        # Texts become Python objects one at a time and rows leave by the part, so memory
        # holds a part's rows however many files a batch has.
        for batch in batches:
            content, files, rows = batch.column("content"), [], []
            for k in range(batch.num_rows):
                parsed = node_rows(content[k].as_py())
                rows += parsed
                files += [k] * len(parsed)
                if len(rows) >= PART_ROWS:
                    yield made(batch, files, rows)
                    files, rows = [], []
            if rows:
                yield made(batch, files, rows)

    return parse


def python_nodes(files: DataFrame, keep: tuple = ()) -> DataFrame:
    """Node rows of Python files: one ``module`` row per parsed file, its functions, classes and
    decision points; one ``error`` row when the file does not parse, one ``skipped`` row when the
    parser gives up for another reason.

    ``keep`` names integer input columns repeated on every row of the file.
    """
    schema = NODE_SCHEMA.format(keep="".join(f"{k} int, " for k in keep))
    return files.select("project", "path", *keep, "content").mapInArrow(_parser(keep), schema)


def _owned(nodes: DataFrame, *kinds: str) -> DataFrame:
    return nodes.filter(F.col("kind").isin(*kinds)).select(
        "project", "path", F.explode("owners").alias("function_pre"), "kind", "pre", "weight",
        "bfs", "name", "line", "col", "n_args", "mutable_default", "parse_error_msg",
    )


def function_contains(nodes: DataFrame) -> DataFrame:
    """One row per (function, node inside it); nested functions' nodes count for every outer one."""
    return _owned(nodes, "function", "decision").drop("parse_error_msg")


def _per_function(owned: DataFrame, *more: Column) -> DataFrame:
    own = lambda c: F.max(F.when(F.col("pre") == F.col("function_pre"), F.col(c))).alias(c)
    return owned.groupBy("project", "path", "function_pre").agg(
        (F.sum("weight") + 1).alias("complexity"),
        own("bfs"), own("line"), own("col"), own("n_args"), own("name"), own("mutable_default"), *more,
    )


def function_complexity(nodes: DataFrame) -> DataFrame:
    """Per function: complexity and the attributes the function checks need."""
    return _per_function(function_contains(nodes))


def definition_counts(nodes: DataFrame) -> DataFrame:
    """Functions and classes per file."""
    return nodes.groupBy("project", "path").agg(
        F.count_if(F.col("kind") == "function").alias("functions"),
        F.count_if(F.col("kind") == "class").alias("classes"),
    )


def _mean_complexity() -> Column:
    """Mean complexity over a file's functions, in one pass.

    A node adds its weight once for each function around it, so the sum over
    functions is their number plus weight times nesting depth.
    """
    functions = F.count_if(F.col("kind") == "function")
    total = functions + F.sum(F.col("weight") * F.size("owners"))
    return F.when(functions > 0, total / functions).otherwise(F.lit(0.0))


def file_complexity(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("project", "path").agg(_mean_complexity().alias("complexity"))


def maintainability(lines_code: Column, complexity: Column) -> Column:
    """Maintainability index 0-100 of a parsed Python file."""
    # Coefficients of the index; both log terms take the same argument.
    loc = F.log(lines_code + F.lit(1))
    index = F.lit(171) - loc * 5.2 - F.greatest(complexity, F.lit(1.0)) * 0.23 - loc * 16.2
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(100.0), index * 100 / 171))
    return F.when(lines_code == 0, F.lit(100.0)).otherwise(F.round(bounded, 1))


COUNT_COLUMNS = ("lines_total", "lines_code", "lines_comment", "lines_blank")


def counted_nodes(counted: DataFrame) -> DataFrame:
    """Node rows that also carry the line counts of their file."""
    return python_nodes(counted, keep=COUNT_COLUMNS)


def python_metrics(nodes: DataFrame) -> DataFrame:
    """File metrics from ``counted_nodes``: one grouping by file, combined map-side.

    Files that do not parse keep their line counts and zero tree metrics.
    """
    parsed = F.max(F.when(F.col("kind") == "module", 1).otherwise(0)) == 1
    grouped = nodes.groupBy("project", "path").agg(
        *[F.max(c).alias(c) for c in COUNT_COLUMNS],
        F.count_if(F.col("kind") == "function").cast("int").alias("functions"),
        F.count_if(F.col("kind") == "class").cast("int").alias("classes"),
        _mean_complexity().alias("complexity"),
        parsed.alias("_parsed"),
    )
    index = maintainability(F.col("lines_code"), F.col("complexity"))
    return grouped.select(
        "project", F.col("path").alias("filepath"), *COUNT_COLUMNS, "functions", "classes", "complexity",
        F.when(F.col("_parsed"), index).otherwise(F.lit(0.0)).alias("maintainability"),
    )


def tree_findings(nodes: DataFrame) -> DataFrame:
    """Function checks and syntax errors as findings, from one pass over the node rows.

    A file that does not parse has a single row that owns itself, so it comes
    through the same grouping as a function would.
    """
    f = _per_function(_owned(nodes, "function", "decision", "error"), F.max("parse_error_msg").alias("error"))
    name = F.concat(F.lit('"'), F.col("name"), F.lit('"'))
    number = lambda c: F.concat(F.lit("("), F.col(c).cast("string"), F.lit(")"))
    # Rule, severity, category, message and suggestion of each check.
    checks = [
        ("C001", F.col("complexity") > v.MAX_FUNCTION_COMPLEXITY, "warning", "complexity",
         F.concat_ws(" ", F.lit("Function"), name, F.lit("has high complexity"), number("complexity")),
         "Consider breaking into smaller functions"),
        ("C002", F.col("n_args") > v.MAX_FUNCTION_ARGUMENTS, "warning", "complexity",
         F.concat_ws(" ", F.lit("Function"), name, F.lit("has too many arguments"), number("n_args")),
         "Consider using a config object or dataclass"),
        ("B012", F.col("mutable_default"), "error", "bug",
         F.concat_ws(" ", F.lit("Mutable default argument in function"), name),
         "Use None as default and initialize inside function"),
        ("E001", F.col("error").isNotNull(), "critical", "syntax",
         F.concat(F.lit("Syntax error: "), F.col("error")), ""),
    ]
    rows = [
        F.when(
            hit,
            F.struct(
                F.lit(slot).alias("slot"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"),
                F.lit(category).alias("category"), message.alias("message"), F.lit(suggestion).alias("suggestion"),
            ),
        )
        for slot, (rule, hit, severity, category, message, suggestion) in enumerate(checks, 1)
    ]
    found = f.select("project", "path", "line", "col", "bfs", F.explode(F.array_compact(F.array(*rows))).alias("c"))
    return found.select(
        "project", F.col("path").alias("file"), "line", F.col("col").alias("column"),
        "c.severity", "c.category", "c.rule", "c.message", "c.suggestion", F.lit("").alias("code_snippet"),
        finding_order("tree", F.col("bfs"), F.col("c.slot")).alias("ord"),
    ).select(*FINDING_COLUMNS)
