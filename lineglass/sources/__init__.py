"""Readers of file trees, linter output and answer tables; writers of reports."""
