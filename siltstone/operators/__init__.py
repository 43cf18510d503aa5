"""Operators over DataFrames: typing, filters, text rules, vectors, ranking, paging, facets, ingestion."""
