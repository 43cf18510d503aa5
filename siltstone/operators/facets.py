"""Facets, filter options, document summaries and page aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.spans import RANGE, sanitize_ranges
from siltstone.functions.text import fold, strip
from siltstone.operators.fields import FieldDef, FieldType

PAIRS = "array<struct<field:string,kind:string,value:string,key:double>>"


def value_counts(docs: DataFrame, column: str, order: str = "ordinal") -> DataFrame:
    """value, count, ordered by folded text, then by first appearance where ``order`` is a column."""
    first = F.min(order) if order in docs.columns else F.min(F.col(column).cast("string"))
    counted = docs.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count"), first.alias("first"))
    return counted.orderBy(fold(_shown(F.col("value"), docs.schema[column].dataType.typeName())), "first").select("value", "count")


def _shown(c: Column, kind: str) -> Column:
    """The text by which values are ordered: numbers as text, booleans capitalised."""
    return F.when(c, "True").otherwise("False") if kind == "boolean" else c.cast("string")


def item_counts(docs: DataFrame, column: str, order: str = "ordinal") -> DataFrame:
    """value, count over list items; an item counts once a document."""
    keep = [F.explode(F.array_distinct(column)).alias(column), *([F.col(order)] if order in docs.columns else [])]
    return value_counts(docs.select(*keep), column, order)


def bounds(docs: DataFrame, column: str) -> DataFrame:
    """One row: min, max."""
    return docs.agg(F.min(column).alias("min"), F.max(column).alias("max"))


def all_facets(docs: DataFrame, fields: dict[str, tuple[FieldDef, str]]) -> DataFrame:
    """field, kind (available, value or range), value, count of every field, from one pass over docs.

    Each document is unpivoted to its (field, value) pairs and these are
    aggregated once, partially before the shuffle; ranges and counts of
    non-null values come out of the same aggregation.
    """
    pairs = []
    for name, (field, operation) in fields.items():
        c = F.col(name)
        row = lambda kind, v, key: F.struct(F.lit(name).alias("field"), F.lit(kind).alias("kind"), v.cast("string").alias("value"), key.cast("double").alias("key"))
        none = F.lit(None)
        there = F.when(c.isNotNull(), F.array(row("available", none, none)))
        if operation == "range":
            number = F.unix_date(c) if field.type is FieldType.DATE else c
            own = F.when(c.isNotNull(), F.array(row("range", none, number)))
        elif operation == "equality":
            own = F.when(c.isNotNull(), F.array(row("value", c, none)))
        elif field.type is FieldType.LIST:
            own = F.transform(F.array_distinct(F.filter(c, lambda x: x.isNotNull())), lambda x: row("value", x, none))
        else:
            own = None
        pairs += [there] + ([own] if own is not None else [])
    none = F.array().cast(PAIRS)
    long = docs.select(F.inline(F.concat(*[F.coalesce(p.cast(PAIRS), none) for p in pairs])))
    out = long.groupBy("field", "kind", "value").agg(F.count("*").alias("count"), F.min("key").alias("low"), F.max("key").alias("high"))
    return out.select("field", "kind", "value", "count", "low", "high")


def options(docs: DataFrame, columns: list[str]) -> DataFrame:
    """field, value: sorted distinct trimmed non-empty values; list columns item by item."""
    kinds = dict(docs.dtypes)
    out = None
    for name in columns:
        one = docs.select(F.lit(name).alias("field"), (F.explode(name) if kinds[name].startswith("array") else F.col(name)).alias("value"))
        one = one.withColumn("value", F.col("value").cast("string"))
        out = one if out is None else out.unionByName(one)
    return out.select("field", strip("value").alias("value")).where(F.col("value") != "").distinct().orderBy("field", "value")


def document_summary(pages: DataFrame, key: str = "filename", page: str = "page_number", order: str = "row_idx", firsts: tuple[str, ...] = ("doctype", "lawnumber", "date")) -> DataFrame:
    """A row for each file: its pages (distinct numbers, or rows where none is numbered) and first values in row order."""
    numbered = F.count_distinct(F.col(page).cast("string"))
    first = [F.min_by(c, F.col(order)).alias(c) for c in firsts]
    return pages.groupBy(key).agg(F.when(numbered == 0, F.count("*")).otherwise(numbered).alias("pages"), *first)


def corpus_status(pages: DataFrame, path: str = "path") -> DataFrame:
    """One row: rows, distinct paths."""
    return pages.agg(F.count("*").alias("rows"), F.count_distinct(path).alias("paths"))


def chunks_to_pages(hits: DataFrame, pages: DataFrame, page: str = "page_index", text: str = "text") -> DataFrame:
    """Chunk hits (chunk_id, score, page, source_ranges) as page hits: best score, merged ranges clipped to the page, chunk ids by score."""
    of_page = hits.groupBy(page).agg(
        F.max("score").alias("score"),
        F.flatten(F.collect_list(F.col("source_ranges").cast(RANGE))).alias("ranges"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "chunk_id"))), lambda x: x["chunk_id"])).alias("chunk_ids"),
    )
    sized = pages.select(page, F.length(text).alias("text_length"))
    return of_page.join(sized, page).select(page, "score", sanitize_ranges("ranges", "text_length").alias("ranges"), "chunk_ids").orderBy(F.round("score", 9).desc(), page)
