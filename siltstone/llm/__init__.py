"""Operators for large training-data pipelines.

Nothing outside this package imports it. ``registry.queries()`` and
``registry.oracle_sql()`` are what ``__spark_entry__`` picks up.
"""
