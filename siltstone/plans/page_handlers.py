"""Requests on a page corpus: search with filters, single pages, files, options, summaries, export, edits.

Like ``handlers``, without a web framework: plain data in, (status, body) out.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import composite, facets
from siltstone.operators.ranking import page_of
from siltstone.operators.semantic import AutoTune
from siltstone.plans.handlers import plain
from siltstone.plans.subsets import Subsets
from siltstone.sources.writers import inside, write_page_texts

ITEM = ("filename", "page_number", "subjects", "signatures", "doctype", "lawnumber", "date", "path_rel")
# The keys of a filter request and their older names.
FILTER_KEYS = {
    "keywords": ("mandatoryKeywords",), "filename": ("filename", "bookName"), "subjects": ("subjects", "topics"), "signatures": ("signatures",), "doctype": ("doctype",), "lawnumber": ("lawnumber",),
    "date_from": ("date_from", "dateFrom"), "date_to": ("date_to", "dateTo"),
}


def filters_of(raw: Mapping[str, Any]) -> dict[str, Any]:
    """The filters of a request, by the names that ``composite.valid_pages`` has; empty ones are left out."""
    out = {name: next((raw[k] for k in keys if raw.get(k) is not None), None) for name, keys in FILTER_KEYS.items()}
    day = raw.get("date")
    if isinstance(day, Mapping):
        out |= {"date_from": day.get("from"), "date_to": day.get("to")}
    return {k: v for k, v in out.items() if v}


def whole(value: Any, default: int, low: int, high: int | None = None) -> int:
    """An integer in bounds; what can't be read is the default."""
    try:
        n = int(value)
    except (TypeError, ValueError):
        n = default
    return max(low, n if high is None else min(n, high))


class PageHandlers:
    """pages: row_idx and the columns that ``composite.prepare`` uses; chunks and embedder serve vector search."""

    def __init__(self, pages: DataFrame, chunks: DataFrame | None = None, embedder: Any = None, root: str = ".", tune: AutoTune = AutoTune()):
        self.chunks, self.embedder, self.root, self.tune = chunks, embedder, root, tune
        self.subsets, self.version = Subsets(), 0
        self.load(pages)

    def load(self, pages: DataFrame) -> None:
        """Serve these pages from now on, as the next version of the corpus; kept subsets of the old ones go."""
        self.subsets.clear()
        self.pages = composite.prepare(pages)
        self.version += 1

    def _valid(self, filters: Mapping[str, Any]) -> DataFrame:
        """The pages that satisfy the filters; their row ids are kept for the next request with the same ones."""
        if not filters:
            return self.pages
        rows = self.subsets.of(filters, lambda: composite.valid_pages(self.pages, filters).select("row_idx"))
        return self.pages.join(rows, "row_idx", "left_semi")

    # -- search --------------------------------------------------------------

    def search(self, raw: Mapping[str, Any]) -> tuple[int, dict]:
        semantic = str(raw.get("isSemanticSearch", "")).strip().lower() in ("1", "true", "yes", "on")
        asked = raw.get("queries") or raw.get("query") or ""
        queries, filters = composite.parse_queries(asked, semantic), filters_of(raw)
        if not queries and not filters:
            return 400, {"error": "Missing query or filters"}
        page, size = whole(raw.get("page"), 1, 1), whole(raw.get("page_size"), 30, 1, 200)
        valid = self._valid(filters)
        if queries and semantic:
            if self.chunks is None or self.embedder is None:
                return 500, {"error": "there are no chunk vectors"}
            hits = self._by_vector(queries[0], valid if filters else None)
            order = [F.round("score", 9).desc(), F.col("row_idx")]
        else:
            hits = composite.substring_or(valid, queries) if queries else valid
            hits, order = hits.select("row_idx", F.lit(None).cast("double").alias("score"), F.lit(None).cast("array<struct<start:int,end:int>>").alias("ranges")), [F.col("row_idx")]
        total = hits.count()
        last = math.ceil(total / size)
        page = min(page, max(1, last))
        cut = page_of(hits, page, size, size, order)
        rows = cut.join(self.pages, "row_idx").orderBy(*order).collect()
        return 200, {
            "results": [self._item(r, r.score, r.ranges) for r in rows], "original_query": queries[0] if semantic and queries else " OR ".join(queries), "original_queries": queries, "valid_after_filters": valid.count(), "filters": filters, "isSemanticSearch": semantic,
            "page": page, "page_size": size, "total_results": total, "total_pages": last, "has_prev": page > 1, "has_next": page < last,
        }

    def _by_vector(self, text: str, valid: DataFrame | None) -> DataFrame:
        (vector,) = self.embedder.queries([text])
        scope = None if valid is None else valid.select(F.col("row_idx").alias("page_index"))
        hits = composite.chunk_search(self.chunks, vector, scope, tune=self.tune)
        found = facets.chunks_to_pages(hits, self.pages.select(F.col("row_idx").alias("page_index"), "text"))
        return found.select(F.col("page_index").alias("row_idx"), "score", "ranges")

    def _item(self, row, score=None, ranges=None) -> dict:
        have = row.asDict(recursive=True)
        out = {"id": have["row_idx"], "chunk": have.get("text")} | {k.removesuffix("_rel"): have.get(k) for k in ITEM}
        out["source_ranges"] = [[r["start"], r["end"]] for r in ranges or ()]
        return plain(out | ({} if score is None else {"semantic_score": score}))

    # -- single pages and files ------------------------------------------------

    def page(self, key: int) -> tuple[int, dict]:
        rows = self.pages.where(F.col("row_idx") == key).head(1)
        return (200, self._item(rows[0])) if rows else (404, {"error": "no such page"})

    def file(self, relative: str) -> tuple[int, Any]:
        try:
            path = inside(self.root, relative)
        except ValueError as e:
            return 400, {"error": str(e)}
        return (200, path.read_bytes()) if path.is_file() else (404, {"error": "no such file"})

    def open(self, key: int) -> tuple[int, dict]:
        """Where the PDF of a page is, and the page in it."""
        status, item = self.page(key)
        if status != 200:
            return status, item
        relative = item["path"] or ""
        if not relative:
            return 400, {"error": "the page has no path"}
        relative += "" if "." in relative.rsplit("/", 1)[-1] else ".pdf"
        try:
            path = inside(self.root, relative)
        except ValueError as e:
            return 400, {"error": str(e)}
        if not path.is_file():
            return 404, {"error": "no such file", "expected_path": str(path)}
        if path.suffix.lower() != ".pdf":
            return 400, {"error": "only PDF files are opened"}
        return 200, {"type": "pdf", "file_url": f"/file/{relative}", "page": item["page_number"], "path": relative} | {k: item[k] for k in ("filename", "doctype", "lawnumber", "date")}

    # -- corpus ----------------------------------------------------------------

    def status(self) -> tuple[int, dict]:
        row = facets.corpus_status(self.pages, "path_rel").first()
        return 200, {"rows": row["rows"], "documents": row.paths}

    def options(self) -> tuple[int, dict]:
        """Values to choose from; lists item by item. Their number is that of the distinct values."""
        lists = {c: F.col(c) if dict(self.pages.dtypes)[c].startswith("array") else composite.split_list(c) for c in ("subjects", "signatures") if c in self.pages.columns}
        names = [c for c in ("filename", "doctype", "lawnumber", *lists) if c in self.pages.columns]
        rows = facets.options(self.pages.withColumns(lists), names).collect()
        low, high = self.pages.agg(*[F.date_format(f("date_ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'") for f in (F.min, F.max)]).first()
        key = {"filename": "filenames", "doctype": "doctypes", "lawnumber": "lawnumbers", "subjects": "subjects", "signatures": "signatures"}
        return 200, {key[n]: [r.value for r in rows if r.field == n] for n in names} | {"date_bounds": {"min": low, "max": high}}

    def summary(self) -> tuple[int, dict]:
        rows = [plain(r.asDict()) for r in facets.document_summary(self.pages).orderBy(F.lower("filename"), "filename").collect()]
        return 200, {"documents": rows, "total_documents": len(rows), "total_pages": sum(r["pages"] for r in rows)}

    def export(self, raw: Mapping[str, Any], target: str | None = None) -> tuple[int, dict]:
        """All hits of a text search or of filters, a text for each file.

        They are written to ``target`` by the executors; without it the texts
        are the answer itself, so the caller has to hold them.
        """
        queries, filters = composite.parse_queries(raw.get("queries") or raw.get("query") or "", False), filters_of(raw)
        if not queries and not filters:
            return 400, {"error": "Missing query or filters"}
        valid = self._valid(filters)
        hits = composite.substring_or(valid, queries) if queries else valid
        if target is not None:
            write_page_texts(hits, target)
            return 200, {"written": target}
        return 200, {"documents": [plain(r.asDict()) for r in composite.export_text(hits).collect()]}

    def update(self, raw: Mapping[str, Any], target: str) -> tuple[int, dict]:
        """Set the given columns of one file's pages; the edited corpus is written to ``target``."""
        name = str(raw.get("filename") or "").strip()
        changes = {k: raw[k] for k in ("doctype", "lawnumber", "date", "subjects", "signatures", "path") if raw.get(k) is not None and k in self.pages.columns}
        if not name or not changes:
            return 400, {"error": "a filename and a value to set are needed"}
        if not self.pages.where(F.col("filename") == name).head(1):
            return 404, {"error": f"no rows of {name}"}
        try:
            n = composite.update_metadata(self.pages.select(*[c for c in self.pages.columns if not c.endswith(("_norm", "_ts", "_rel"))]), name, changes, target)
        except ValueError as e:
            return 400, {"error": str(e)}
        self.load(self.pages.sparkSession.read.parquet(target))
        return 200, {"updated": n}
