"""Page-corpus search: normalised filters, substring search, chunk search, export and metadata edits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import clean_items, lenient_timestamp, normalize_arabic, page_order, relative_path, split_list, strip_leading_number
from siltstone.operators.semantic import PLACES, AutoTune, auto_tuned, over_threshold, scored

MOST_CANDIDATES = 300_000


def prepare(pages: DataFrame) -> DataFrame:
    """pages with the search columns of this module, to be stored at ingestion: text_norm, filename_norm and so on.

    Columns used where present: filename, path, text, doctype, lawnumber, subjects, signatures, date.
    """
    kinds = dict(pages.dtypes)
    new = {}
    for c in ("text", "filename", "doctype", "lawnumber"):
        if c in kinds:
            new[f"{c}_norm"] = normalize_arabic(c)
    for c in ("subjects", "signatures"):
        if c in kinds:
            items = clean_items(c) if kinds[c].startswith("array") else split_list(c)
            new[f"{c}_norm"] = F.array_distinct(F.filter(F.transform(items, normalize_arabic), lambda x: x != ""))
    if "date" in kinds:
        new["date_ts"] = F.col("date").cast("timestamp") if kinds["date"] != "string" else lenient_timestamp("date")
    if "filename" in kinds:
        new["path_rel"] = relative_path(F.col("path") if "path" in kinds else F.lit(None).cast("string"), "filename")
    return pages.withColumns(new)


def _texts(spark_value: Sequence[str] | str | None) -> list[str]:
    values = [spark_value] if isinstance(spark_value, str) else list(spark_value or [])
    return [v for v in values if v and v.strip()]


def _norm(values: Sequence[str]) -> list[Column]:
    return [normalize_arabic(F.lit(v)) for v in values]


def exact_or(column: str, values: Sequence[str] | str | None) -> Column | None:
    """The normalised column equals one of the normalised values."""
    wanted = _texts(values)
    return F.col(f"{column}_norm").isin(*_norm(wanted)) if wanted else None


def all_keywords(values: Sequence[str] | str | None) -> Column | None:
    wanted = _texts(values)
    return reduce(and_, [F.contains(F.col("text_norm"), w) for w in _norm(wanted)]) if wanted else None


def any_item(column: str, values: Sequence[str] | str | None, without_number: bool = False) -> Column | None:
    """The normalised list has one of the values, compared also without leading numbers if asked."""
    wanted = _texts(values)
    if not wanted:
        return None
    have, ask = F.col(f"{column}_norm"), F.array(*_norm(wanted))
    if without_number:
        have = F.concat(have, F.transform(have, strip_leading_number))
        ask = F.concat(ask, F.transform(ask, strip_leading_number))
    return F.arrays_overlap(F.filter(have, lambda x: x != ""), F.filter(ask, lambda x: x != ""))


def date_between(start: str | None, end: str | None) -> Column | None:
    """Inclusive on points of time: a bare day as the end is its midnight. A bound that can't be read is none."""
    tests = []
    for bound, test in ((start, lambda c, b: c >= b), (end, lambda c, b: c <= b)):
        if bound:
            b = lenient_timestamp(F.lit(bound))
            tests.append(F.when(b.isNull(), True).otherwise(F.coalesce(test(F.col("date_ts"), b), F.lit(False))))
    return reduce(and_, tests) if tests else None


def valid_pages(pages: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    """pages (prepared) that satisfy all filters: filename, doctype, lawnumber, keywords, subjects, signatures, date_from, date_to."""
    tests = [
        exact_or("filename", filters.get("filename")), exact_or("doctype", filters.get("doctype")), exact_or("lawnumber", filters.get("lawnumber")),
        all_keywords(filters.get("keywords")), any_item("subjects", filters.get("subjects"), True), any_item("signatures", filters.get("signatures")),
        date_between(filters.get("date_from"), filters.get("date_to")),
    ]
    tests = [t for t in tests if t is not None]
    return pages.where(reduce(and_, tests)) if tests else pages


def parse_queries(queries: str | Sequence[str], semantic: bool) -> list[str]:
    """Text queries of a request: one joined query for vector search, the distinct lines for text search."""
    parts = [queries] if isinstance(queries, str) else list(queries)
    if semantic:
        whole = "\n".join(p.strip() for p in parts if p.strip())
        return [whole] if whole else []
    return list(dict.fromkeys(line.strip() for p in parts for line in p.split("\n") if line.strip()))


def substring_or(pages: DataFrame, queries: Sequence[str]) -> DataFrame:
    """pages whose normalised text contains any of the normalised queries; blank queries find nothing."""
    wanted = _texts(queries)
    tests = [F.contains(F.col("text_norm"), q) & (q != "") for q in _norm(wanted)]
    return pages.where(reduce(or_, tests) if tests else F.lit(False))


def chunk_search(chunks: DataFrame, query: Sequence[float], pages: DataFrame | None = None, k: int | None = None, tune: AutoTune | None = None, threshold: float | None = None) -> DataFrame:
    """chunk_id, page_index, source_ranges, score of chunks by inner product, in pages only if given.

    With ``threshold`` all hits that reach it, unsorted. Else, with ``tune``
    the threshold is tuned to a wanted number of hits, or the k (80 if k isn't
    positive) best count.
    """
    scope = chunks if pages is None else chunks.join(pages.select("page_index").distinct(), "page_index", "left_semi")
    hits = scored(scope, query, id_col="chunk_id", inner_product=True, keep=("page_index", "source_ranges")).withColumnRenamed("id", "chunk_id")
    hits = hits.select("chunk_id", "page_index", "source_ranges", "score")
    if threshold is not None:
        return over_threshold(hits, threshold)
    if tune is not None:
        hits = auto_tuned(hits, tune)
    k = MOST_CANDIDATES if k is None else k if k > 0 else 80
    return hits.orderBy(F.round("score", PLACES).desc(), "chunk_id").limit(k)


def with_vectors(chunks: DataFrame, vectors: DataFrame, row: str = "row") -> DataFrame:
    """chunks with the vector of their row; each row has one, and all are of one size."""
    n = chunks.count()
    seen = vectors.agg(F.count("*").alias("n"), F.count_distinct(row).alias("rows"), F.count_distinct(F.size("vector")).alias("sizes")).first()
    out = chunks.join(vectors.select(row, "vector"), row)
    if not (seen.n == seen.rows == n == out.count()) or seen.sizes > 1:
        raise ValueError(f"{n} chunks but {seen.n} vectors of {seen.rows} rows in {seen.sizes} sizes")
    return out


def export_text(hits: DataFrame, meta: Sequence[str] = ("doctype", "lawnumber", "date")) -> DataFrame:
    """filename, metadata of the first hit, body: all of a file's hits, pages in order, as one text."""
    first = [F.min_by(c, "row_idx").alias(c) for c in meta if c in hits.columns]
    pages = F.array_sort(F.collect_list(F.struct(page_order("page_number").alias("o"), F.col("row_idx").alias("r"), F.coalesce("text", F.lit("")).alias("t"))))
    out = hits.groupBy("filename").agg(*first, F.count("*").alias("pages"), F.array_join(F.transform(pages, lambda p: p["t"]), "\n\n").alias("body"))
    return out.orderBy(F.lower("filename"), "filename")


# The longest metadata values that an edit accepts.
LIMITS = {"doctype": 250, "lawnumber": 250, "date": 120, "path": 1000}


def with_metadata(pages: DataFrame, filename: str, changes: Mapping[str, object]) -> DataFrame:
    """pages with the given columns of one file set; the caller writes them beside the old and swaps."""
    stray = [c for c in changes if c not in pages.columns]
    if stray:
        raise ValueError(f"no columns {stray}")
    for c, v in changes.items():
        if isinstance(v, str) and len(v) > LIMITS.get(c, 2000):
            raise ValueError(f"{c} is too long")
    mine = F.col("filename") == filename
    return pages.withColumns({c: F.when(mine, F.lit(v).cast(dict(pages.dtypes)[c])).otherwise(F.col(c)) for c, v in changes.items()})


def update_metadata(pages: DataFrame, filename: str, changes: Mapping[str, object], target: str) -> int:
    """Write pages, edited, to a new place; the number of rows changed, of which there must be one."""
    n = pages.where(F.col("filename") == filename).count()
    if not n:
        raise ValueError(f"no rows of {filename}")
    with_metadata(pages, filename, changes).write.mode("errorifexists").parquet(target)
    return n
