"""The review of a corpus."""

from dataclasses import dataclass
from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineglass.operators import rollups
from lineglass.operators.corpus import with_language
from lineglass.operators.findings import union_findings
from lineglass.operators.lines import explode_lines, line_counts
from lineglass.operators.metrics import METRIC_COLUMNS, text_file_metrics
from lineglass.operators.scan import scan_rules
from lineglass.operators.syntax import counted_nodes, python_metrics, tree_findings
from lineglass.plans import report
from lineglass.plans.followup import content_hashes
from lineglass.sources.sinks import write_json_fragments, write_reports, write_table


class Reports:
    """The reports of anything that has totals, findings, metrics and answers."""

    def markdown(self, timestamp: str) -> DataFrame:
        return report.markdown_reports(self.totals, self.findings, self.metrics, timestamp, self.answers)

    def html(self, timestamp: str) -> DataFrame:
        return report.html_reports(self.markdown(timestamp))

    def json(self, timestamp: str) -> DataFrame:
        return report.json_fragments(self.totals, self.findings, self.metrics, timestamp, self.answers)


class Review(Reports):
    """The tables of a review of ``(project, path, content)``, each described on first use.

    ``linters`` are further finding tables; ``answers`` is one row per project.
    ``keep_nodes`` may store the syntax rows so both users of them read one copy.
    """

    def __init__(self, files: DataFrame, linters: tuple = (), answers: DataFrame | None = None, keep_nodes=None):
        self.files = with_language(files)
        self.linters = linters
        self.answers = answers
        self.keep_nodes = keep_nodes

    def _family(self, python: bool) -> DataFrame:
        mine = F.col("family") == "python"
        return line_counts(self.files.filter(mine if python else ~mine), keep=("content",))

    @cached_property
    def nodes(self) -> DataFrame:
        nodes = counted_nodes(self._family(python=True))
        return self.keep_nodes(nodes) if self.keep_nodes else nodes

    @cached_property
    def findings(self) -> DataFrame:
        return union_findings(scan_rules(explode_lines(self.files)), tree_findings(self.nodes), *self.linters)

    @cached_property
    def metrics(self) -> DataFrame:
        texts = text_file_metrics(self._family(python=False))
        return python_metrics(self.nodes).unionByName(texts).select(*METRIC_COLUMNS)

    @cached_property
    def totals(self) -> DataFrame:
        """From line counts alone, which need no Python."""
        return rollups.project_totals(line_counts(self.files))


@dataclass
class StoredReview(Reports):
    """A review whose tables are stored."""

    findings: DataFrame
    metrics: DataFrame
    answers: DataFrame | None = None

    @property
    def totals(self) -> DataFrame:
        return rollups.project_totals(self.metrics)


def now() -> str:
    return datetime.now().strftime("%Y-%m-%d %H:%M:%S")


def store_review(files: DataFrame, out: str, linters: tuple = (), answers: DataFrame | None = None) -> StoredReview:
    """Review and store syntax rows, findings, metrics and content hashes under ``out``.

    The hashes are what ``file_changes`` compares the next state of the files with.

    Everything later reads the stored tables: no text is scanned or parsed twice,
    and a lost executor costs at most the tasks of one stage.
    """
    lazy = Review(files, linters, answers, keep_nodes=lambda n: write_table(n, f"{out}/nodes"))
    write_table(content_hashes(files), f"{out}/hashes")
    return StoredReview(
        write_table(lazy.findings, f"{out}/findings"), write_table(lazy.metrics, f"{out}/metrics"), answers
    )


def run_review(files: DataFrame, out: str, timestamp: str | None = None, linters: tuple = (),
               answers: DataFrame | None = None) -> StoredReview:
    """A stored review with its Markdown, HTML and JSON reports."""
    timestamp = timestamp or now()
    stored = store_review(files, out, linters, answers)
    write_reports(stored.markdown(timestamp), f"{out}/markdown")
    write_reports(stored.html(timestamp), f"{out}/html")
    write_json_fragments(stored.json(timestamp), f"{out}/json")
    return stored
