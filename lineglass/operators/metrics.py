"""Per-file metrics of every family."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineglass.functions.text import count_substrings, java_regex
from lineglass.functions.vocabulary import JS_DECISION_MARKERS
from lineglass.operators.corpus import with_language
from lineglass.operators.lines import line_counts
from lineglass.operators.syntax import counted_nodes, python_metrics

METRIC_COLUMNS = [
    "project", "filepath", "lines_total", "lines_code", "lines_comment", "lines_blank",
    "functions", "classes", "complexity", "maintainability",
]

# What counts as a function and as a class in JavaScript/TypeScript text.
JS_FUNCTION_PATTERN = r"function\s+\w+|=>\s*[{(]|\w+\s*\([^)]*\)\s*{"
JS_CLASS_PATTERN = r"class\s+\w+"
# The first of them as it is searched: a call-like match starts at a word start,
# and no part of it can match in another way, so nothing needs to be tried again.
_JS_FUNCTION_SEARCH = r"function\s++\w++|=>\s*[{(]|(?<!\w)\w++\s*+\([^)]*+\)\s*+\{"


def js_functions(content: Column) -> Column:
    return F.regexp_count(content, F.lit(java_regex(_JS_FUNCTION_SEARCH)))


def js_classes(content: Column) -> Column:
    return F.regexp_count(content, F.lit(java_regex(JS_CLASS_PATTERN)))


def js_decisions(content: Column) -> Column:
    return count_substrings(content, JS_DECISION_MARKERS)


def js_complexity(decisions: Column, functions: Column) -> Column:
    return decisions / F.greatest(functions, F.lit(1))


def js_maintainability(complexity: Column, lines_code: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - complexity * 3 - lines_code / 100))


def js_file_facts(files: DataFrame) -> DataFrame:
    """Definition and decision counts of JavaScript/TypeScript files, over whole contents."""
    content = F.col("content")
    return files.select(
        "project", "path",
        js_functions(content).alias("functions"),
        js_classes(content).alias("classes"),
        js_decisions(content).alias("decisions"),
    ).withColumn("complexity", js_complexity(F.col("decisions"), F.col("functions")))


def text_file_metrics(counted: DataFrame) -> DataFrame:
    """Metrics of JavaScript/TypeScript and generic files: a projection, no shuffle."""
    content = F.col("content")
    js = (F.col("family") == "javascript") & content.isNotNull()
    facts = counted.select(
        "*",
        F.when(js, js_functions(content)).otherwise(0).alias("functions"),
        F.when(js, js_classes(content)).otherwise(0).alias("classes"),
        F.when(js, js_decisions(content)).otherwise(0).alias("_decisions"),
    ).withColumn("complexity", F.when(js, js_complexity(F.col("_decisions"), F.col("functions"))).otherwise(0.0))
    index = js_maintainability(F.col("complexity"), F.col("lines_code"))
    return facts.select(
        "project", F.col("path").alias("filepath"),
        "lines_total", "lines_code", "lines_comment", "lines_blank", "functions", "classes", "complexity",
        F.when(js, index).otherwise(0.0).alias("maintainability"),
    )


def file_metrics(files: DataFrame) -> DataFrame:
    """``(project, path, content)`` -> one metrics row per file.

    Only Python contents go through the Python workers; their node rows are the
    only thing shuffled.
    """
    tagged = with_language(files)
    python = tagged.filter(F.col("family") == "python")
    other = tagged.filter(F.col("family") != "python")
    counted = python_metrics(counted_nodes(line_counts(python, keep=("content",))))
    texts = text_file_metrics(line_counts(other, keep=("content",)))
    return counted.unionByName(texts).select(*METRIC_COLUMNS)
