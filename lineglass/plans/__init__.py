"""Whole reviews: from a corpus to stored findings, metrics and reports."""
