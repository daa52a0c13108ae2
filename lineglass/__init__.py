"""lineglass: review large corpora of source files and text documents on Spark.

A corpus is a table ``(project, path, content)``.  Rules are data, findings and
metrics are tables, reports are aggregations over those tables.
"""

__version__ = "0.1.0"
