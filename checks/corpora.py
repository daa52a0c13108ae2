"""Corpora derived from the given tables, for the registered queries.

Every corpus covers a whole table and whole texts; ``checks/sql.py`` derives the
same rows in SQL.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.probes import snippets
from lineglass.functions.vocabulary import LANGUAGES
from lineglass.functions.text import sql_text

# Extensions dealt out by document number: all supported ones, two in capitals.
REVIEW_EXTENSIONS = [*LANGUAGES, ".PY", ".Ts"]
TREE_EXTENSIONS = [*REVIEW_EXTENSIONS, ".txt", "", ".md", ".tar.py"]
TREE_DIRS = ["node_modules/", "src/build/", "lib.egg-info/", "src/", ".git/x/", "builder/", "a/b/"]
TREE_NAMES = ["package-lock.json", ".gitignore", ".py"]

FAMILY_EXTENSION = {"python": ".py", "javascript": ".js", "generic": ".go"}


# Beyond this many splits a scan keeps enough tasks busy, and moving its text
# would cost more than the idle cores.
SPREAD_MAX_SPLITS = 64


def spread(df: DataFrame) -> DataFrame:
    """Give every core work when a small test table has fewer splits than there are cores.

    A large input is returned as it is: its text is never shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    return df.repartition(cores) if splits < min(cores, SPREAD_MAX_SPLITS) else df


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"))


def pick(values: list[str], number: Column) -> Column:
    """The value dealt to a row by its number."""
    constants = F.expr(f"array({', '.join(sql_text(x) for x in values)})")
    return F.element_at(constants, (number % len(values) + 1).cast("int"))


def snippet(family: str, number: Column | None = None) -> Column:
    return pick(snippets(family), F.col("doc_id") if number is None else number)


def family_files(spark: SparkSession, sf: str, family: str) -> DataFrame:
    """Every document as a file of one family, with one probe line of that family after its text."""
    return documents(spark, sf).select(
        F.col("source").alias("project"),
        F.concat("lang", F.lit("/d"), "doc_id", F.lit(FAMILY_EXTENSION[family])).alias("path"),
        F.concat("text", F.lit("\n"), snippet(family)).alias("content"),
    )


def plain_files(spark: SparkSession, sf: str, family: str) -> DataFrame:
    """Every document as a file of one family, text only."""
    return documents(spark, sf).select(
        F.col("source").alias("project"),
        F.concat("lang", F.lit("/d"), "doc_id", F.lit(FAMILY_EXTENSION[family])).alias("path"),
        F.col("text").alias("content"),
    )


def page_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every page as a JavaScript file; the project is the first letter of the path part of its address."""
    pages = spread(table(spark, sf, "pages").select("page_id", "url", "html"))
    return pages.select(
        F.substring_index("url", ":", 1).alias("project"),
        F.concat(F.lit("p"), "page_id", F.lit(".js")).alias("path"),
        F.col("html").alias("content"),
    )


def block_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as JavaScript whose words open and close block comments and end lines."""
    text = F.col("text")
    for word, becomes in BLOCK_WORDS:
        text = F.replace(text, F.lit(word), F.lit(becomes))
    return documents(spark, sf).select(
        F.col("source").alias("project"),
        F.concat("lang", F.lit("/d"), "doc_id", F.lit(".js")).alias("path"),
        F.concat(text, F.lit("\n"), snippet("javascript")).alias("content"),
    )


BLOCK_WORDS = [
    (" the ", "\n/* the\n"), (" and ", "\nand */\n"), (" of ", "\n// of\n"), (" la ", "\nla /*\n"),
    (" le ", "\n*/ le /*\n"), (" und ", "\n/* und */\n"), (" die ", "\n\ndie */"), (" de ", "\n/*/\n"),
]


def tree_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every document under a path of every kind: ignored directories and names, odd extensions."""
    n = F.col("doc_id")
    name = F.when(n % 13 < len(TREE_NAMES), pick(TREE_NAMES, n % 13)).otherwise(
        F.concat(F.lit("d"), n, pick(TREE_EXTENSIONS, n))
    )
    return documents(spark, sf).select(
        F.col("source").alias("project"),
        F.concat("lang", F.lit("/"), pick(TREE_DIRS, n), n, F.lit("/"), name).alias("path"),
        F.col("text").alias("content"),
    )


def python_source(text: Column, number: Column) -> Column:
    """A Python file: the text and a probe as comments, then definitions that depend on the number.

    Every 17th file ends in a line that does not parse.
    """
    head = F.concat(
        F.lit("# "), F.replace(text, F.lit("\n"), F.lit("\n# ")),
        F.lit("\n# "), snippet("python", number), F.lit("\n"),
    )
    args = F.array_join(
        F.concat(
            F.transform(F.slice(F.sequence(F.lit(0), number % 10), 1, (number % 10).cast("int")),
                        lambda i: F.concat(F.lit("a"), i)),
            F.when(number % 4 == 0, F.array(F.lit("z=[]"))).otherwise(F.array().cast("array<string>")),
        ),
        ", ",
    )
    code = F.concat(
        F.lit("def f"), number, F.lit("("), args, F.lit("):\n    print(0)\n"),
        F.repeat(F.lit("    if x: pass\n"), (number % 13).cast("int")),
        F.when(number % 3 == 0, "    def g(y=[]):\n        for i in y: pass\n").otherwise(""),
        F.lit("    return 0\n"),
        F.when(number % 5 == 0, "class C:\n    pass\n").otherwise(""),
        F.when(number % 17 == 0, "def (\n").otherwise(""),
    )
    return F.concat(head, code)


def review_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a reviewable file of some language; Python files hold real code."""
    n, ext = F.col("doc_id"), pick(REVIEW_EXTENSIONS, F.col("doc_id"))
    rest = F.when(
        ext.isin(".js", ".ts", ".jsx", ".tsx", ".Ts"), snippet("javascript", F.floor(n / 21))
    ).otherwise(snippet("generic", F.floor(n / 21)))
    return documents(spark, sf).select(
        F.col("source").alias("project"),
        F.concat("lang", F.lit("/d"), n, ext).alias("path"),
        F.when(ext.isin(".py", ".PY"), python_source(F.col("text"), F.floor(n / 21)))
        .otherwise(F.concat("text", F.lit("\n"), rest)).alias("content"),
    )


def python_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a Python file with definitions."""
    return documents(spark, sf).select(
        F.col("source").alias("project"),
        F.concat("lang", F.lit("/d"), "doc_id", F.lit(".py")).alias("path"),
        python_source(F.col("text"), F.col("doc_id")).alias("content"),
    )


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Every assistant turn as an answer in one of six shapes."""
    turns = spread(table(spark, sf, "conversations").filter(F.col("role") == "assistant"))
    text, shape = F.col("text"), (F.col("conv_id") * 3 + F.col("turn")) % 6
    bullets = F.concat(F.lit("- "), F.replace(text, F.lit(". "), F.lit("\n- ")))
    body = (
        F.when(shape == 0, F.concat(F.lit("SUMMARY: "), text, F.lit("\n\nISSUES:\n- one\n\nSUGGESTIONS:\n"), bullets))
        .when(shape == 1, text)
        .when(shape == 2, F.concat(F.lit("ISSUES:\n"), bullets, F.lit("\nSUMMARY: late")))
        .when(shape == 3, F.concat(F.lit("SUMMARY:"), text, F.lit("\nSUGGESTIONS:\n"), text, F.lit("\n-\nSUMMARY x\n- y")))
        .when(shape == 4, "")
        .otherwise(F.concat(F.lit("SUMMARY:  \nISSUES: none\nSUGGESTIONS:\n"), F.replace(text, F.lit(", "), F.lit("\n  -  "))))
    )
    return turns.select("conv_id", "turn", body.alias("text"))
