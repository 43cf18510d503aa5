"""The search engine: one lazy plan from request to page.

filter -> text rules and vectors -> merge -> page -> metadata. Filters go into
the scan; both searches read the same narrowed documents; the page is cut
before the metadata is joined, so that only its rows are fetched.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators import facets
from siltstone.operators.fields import BadConfig, BadQuery
from siltstone.operators.filters import FieldFilter, apply_filters, build_filters
from siltstone.operators.ingest import single_model
from siltstone.operators.lexical import LexicalQuery, lexical_hits
from siltstone.operators.ranking import PageInfo, merged, page_of
from siltstone.operators.semantic import PLACES, VectorQuery, VectorStore, multi_search
from siltstone.plans.config import Config

log = logging.getLogger("siltstone.search")


@contextmanager
def stage(name: str, **facts):
    """Log start, end with duration, or failure of a stage."""
    log.info("%s started", name, extra=facts)
    began = time.perf_counter()
    try:
        yield
    except Exception:
        log.exception("%s failed after %.1f ms", name, (time.perf_counter() - began) * 1e3)
        raise
    log.info("%s ended after %.1f ms", name, (time.perf_counter() - began) * 1e3)


@dataclass(frozen=True)
class Request:
    """lexical None: no text search; LexicalQuery() matches all. Filters alone are no query."""

    semantic: tuple[VectorQuery, ...] = ()
    semantic_text: tuple[str, ...] = ()
    lexical: LexicalQuery | None = None
    filters: Mapping[str, Any] = field(default_factory=dict)
    page: int = 1
    page_size: int | None = None

    def __post_init__(self):
        if not (self.semantic or self.semantic_text or self.lexical is not None):
            raise BadQuery("a request has a vector, a text for one, or a text rule")
        if self.page < 1 or (self.page_size is not None and self.page_size < 1):
            raise BadQuery("pages begin at 1 and hold 1 hit at least")

    @classmethod
    def parse(cls, raw: Any) -> Request:
        """From a JSON object; unknown keys are errors."""
        if not isinstance(raw, Mapping):
            raise BadQuery("a request is an object")
        stray = set(raw) - {"semantic", "semantic_text", "lexical", "filters", "page", "page_size"}
        if stray:
            raise BadQuery(f"unknown keys {sorted(stray)}")
        try:
            vectors = tuple(VectorQuery(tuple(float(x) for x in v["vector"]), float(v.get("weight", 1.0))) for v in raw.get("semantic") or ())
            texts = tuple(t if isinstance(t, str) else t["text"] for t in raw.get("semantic_text") or ())
            rule = raw.get("lexical")
            lexical = None if rule is None else LexicalQuery(tuple(rule.get("first_of") or ()), tuple(rule.get("mandatories") or ()), bool(rule.get("case_sensitive", False)))
            return cls(vectors, texts, lexical, dict(raw.get("filters") or {}), int(raw.get("page", 1)), None if raw.get("page_size") is None else int(raw["page_size"]))
        except (KeyError, TypeError, AttributeError) as e:
            raise BadQuery(f"the request is malformed: {e}") from e


@dataclass
class Result:
    hits: DataFrame
    info: PageInfo


class SearchEngine:
    """docs: id, text and the declared fields; vectors: a table of id, vector, model_id, or a VectorStore.

    Of documents that share an id the last one's metadata counts; the ingestion
    that should come before has no such ids.
    """

    def __init__(self, config: Config, docs: DataFrame, vectors: DataFrame | VectorStore | None = None, embedder: Any = None, overrides: dict[str, type[FieldFilter]] | None = None):
        self.config, self.docs, self.vectors, self.embedder = config, docs, vectors, embedder
        absent = [f.name for f in config.fields if f.name not in docs.columns]
        if absent:
            raise BadConfig(f"the documents lack {absent}")
        self.filters = build_filters({n: (f.field, f.operation) for n, f in config.filters.items()}, overrides)
        self.model = None
        if isinstance(vectors, DataFrame) and "model_id" in vectors.columns:
            try:
                self.model = single_model(vectors)
            except ValueError as e:
                raise BadConfig(str(e)) from e
            if embedder is not None and self.model not in (None, embedder.model_id):
                raise BadConfig(f"documents were embedded by {self.model}, queries by {embedder.model_id}")

    # -- plans ---------------------------------------------------------------

    def candidates(self, request: Request) -> DataFrame:
        return apply_filters(self.docs, self.filters, request.filters)

    def queries(self, request: Request) -> list[VectorQuery]:
        out = list(request.semantic)
        if request.semantic_text:
            if self.embedder is None:
                raise BadConfig("texts need an embedder")
            made = self.embedder.queries(list(request.semantic_text))
            if len(made) != len(request.semantic_text):
                raise BadConfig("the embedder's vectors are not one a text")
            out += [VectorQuery(tuple(v)) for v in made]
        return out

    def hits(self, request: Request) -> DataFrame:
        """id, score, semantic_score, lexical_matched of all hits, unordered."""
        docs = self.candidates(request)
        queries = self.queries(request)
        semantic = lexical = None
        if queries:
            if not self.config.semantic_enabled:
                raise BadQuery("vector search is not enabled")
            if self.vectors is None:
                raise BadConfig("there are no vectors")
            semantic = multi_search(self.vectors, queries, self.config.combination, scope=docs if request.filters else self.docs)
        if request.lexical is not None:
            if not self.config.lexical_enabled:
                raise BadQuery("text search is not enabled")
            lexical = lexical_hits(docs, request.lexical)
        return merged(semantic, lexical, self.config.weights, self.config.ranking)

    def page(self, hits: DataFrame, page: int, page_size: int | None) -> DataFrame:
        """place, id, score, matched_fields, text, metadata of one page."""
        size = min(page_size or self.config.default_page_size, self.config.max_page_size)
        cut = page_of(hits, page, size, self.config.max_page_size)
        order = Window.orderBy(F.round("score", PLACES).desc(), "id")  # over one page only
        cut = cut.withColumn("place", F.row_number().over(order) + (page - 1) * size)
        matched = F.when(F.col("lexical_matched"), F.array(F.lit("text"))).otherwise(F.array().cast("array<string>"))
        names = [f.name for f in self.config.fields]
        return cut.withColumn("matched_fields", matched).join(self.docs.select("id", "text", *names), "id").orderBy("place").select("place", "id", "score", "matched_fields", "text", *names)

    # -- answers -------------------------------------------------------------

    def search(self, request: Request) -> Result:
        """One page and the size of the whole result; the hits (ids and scores) are computed once for both."""
        with stage("search", page=request.page):
            hits = self.hits(request).persist(StorageLevel.MEMORY_AND_DISK)
            try:
                total = hits.count()
                if not total:
                    log.info("search has no results")
                size = min(request.page_size or self.config.default_page_size, self.config.max_page_size)
                page = self.page(hits, request.page, size)
                rows = page.collect()  # no more than max_page_size
            finally:
                hits.unpersist()
            return Result(page.sparkSession.createDataFrame(rows, page.schema), PageInfo(request.page, size, total))

    def facets(self, names: Sequence[str] | None = None) -> DataFrame:
        wanted = self.config.filters if names is None else {n: self._filter(n) for n in names}
        return facets.all_facets(self.docs, {n: (f.field, f.operation) for n, f in wanted.items()})

    def _filter(self, name: str):
        if name not in self.config.filters:
            raise ValueError(f"no field {name!r}")
        return self.config.filters[name]

    def get_document(self, key: str) -> dict | None:
        row = self.docs.where(F.col("id") == key).select("id", "text", *[f.name for f in self.config.fields]).head(1)
        return row[0].asDict(recursive=True) if row else None

    def capabilities(self) -> dict[str, bool]:
        c = self.config
        return {"semantic": c.semantic_enabled and self.vectors is not None, "semantic_text": c.semantic_enabled and self.embedder is not None, "lexical": c.lexical_enabled}


def build_engine(config: Config, ingestion, vectors: DataFrame | VectorStore | None = None, embedder: Any = None, overrides: dict[str, type[FieldFilter]] | None = None) -> SearchEngine:
    """From an ingestion, which must be clean."""
    ingestion.require_clean()
    return SearchEngine(config, ingestion.documents, vectors, embedder, overrides)


SourceResolver = Callable[[dict], Any]
