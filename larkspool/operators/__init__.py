"""Relational operators: filters, extraction, dedup, sampling, ordering, grading, reports."""
