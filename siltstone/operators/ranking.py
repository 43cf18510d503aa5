"""Merging of vector and text hits, and pages of the result."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.fields import BadConfig, BadQuery
from siltstone.operators.semantic import PLACES

Strategy = Callable[[Column, Column, float, float], Column]
_strategies: dict[str, Strategy] = {}


def register_strategy(name: str) -> Callable[[Strategy], Strategy]:
    def put(fn: Strategy) -> Strategy:
        if name in _strategies:
            raise ValueError(f"{name!r} is registered already")
        _strategies[name] = fn
        return fn

    return put


def strategy(name: str) -> Strategy:
    if name not in _strategies:
        raise BadConfig(f"no ranking {name!r}; there are {sorted(_strategies)}")
    return _strategies[name]


@register_strategy("weighted_sum")
def weighted_sum(semantic: Column, lexical: Column, semantic_weight: float, lexical_weight: float) -> Column:
    """A missing score counts 0, a text match 1; nothing is renormalised."""
    if semantic_weight + lexical_weight <= 0:
        raise BadConfig("the ranking weights sum to nothing")
    return F.lit(float(semantic_weight)) * F.coalesce(semantic, F.lit(0.0)) + F.lit(float(lexical_weight)) * F.when(lexical, 1.0).otherwise(0.0)


def merged(semantic: DataFrame | None, lexical: DataFrame | None, weights: tuple[float, float] = (0.5, 0.5), how: str = "weighted_sum") -> DataFrame:
    """id, score, semantic_score, lexical_matched of all that either search found."""
    if semantic is None and lexical is None:
        raise BadQuery("neither search ran")
    if semantic is None:
        both = lexical.select("id", F.lit(None).cast("double").alias("semantic_score"), F.lit(True).alias("lexical_matched"))
    elif lexical is None:
        both = semantic.select("id", F.col("score").alias("semantic_score"), F.lit(False).alias("lexical_matched"))
    else:
        found = lexical.select("id", F.lit(True).alias("hit"))
        both = semantic.withColumnRenamed("score", "semantic_score").join(found, "id", "full").select("id", "semantic_score", F.coalesce("hit", F.lit(False)).alias("lexical_matched"))
    score = strategy(how)(F.col("semantic_score"), F.col("lexical_matched"), *weights)
    return both.withColumn("score", score).select("id", "score", "semantic_score", "lexical_matched")


def matched_fields(*lists: Column) -> Column:
    """Ordered union of the fields that searches matched."""
    return F.array_distinct(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]))


@dataclass(frozen=True)
class PageInfo:
    page: int
    page_size: int
    total_hits: int

    @property
    def total_pages(self) -> int:
        return math.ceil(self.total_hits / self.page_size)

    @property
    def has_previous(self) -> bool:
        return self.page > 1

    @property
    def has_next(self) -> bool:
        return self.page < self.total_pages


def page_of(hits: DataFrame, page: int, page_size: int, max_page_size: int = 100, order: list[Column] | None = None) -> DataFrame:
    """One page, in order, with its place; past the end it is empty. The sort keeps only what the page needs."""
    if page < 1 or page_size <= 0:
        raise BadQuery("pages begin at 1 and hold 1 hit at least")
    size = min(page_size, max_page_size)
    order = order or [F.round("score", PLACES).desc(), F.col("id")]
    return hits.orderBy(*order).offset((page - 1) * size).limit(size)


def page_info(hits: DataFrame, page: int, page_size: int, max_page_size: int = 100) -> DataFrame:
    """One row: page, page_size, total_hits, total_pages, has_previous, has_next."""
    size = min(page_size, max_page_size)
    total = F.count("*")
    pages = F.ceil(total / size)
    return hits.agg(
        F.lit(page).alias("page"), F.lit(size).alias("page_size"), total.alias("total_hits"), pages.cast("long").alias("total_pages"), F.lit(page > 1).alias("has_previous"), (F.lit(page) < pages).alias("has_next")
    )


def clamped_page(hits: DataFrame, page: int, page_size: int = 30, most: int = 200, order: list[Column] | None = None) -> DataFrame:
    """Like page_of, but a page out of range is the nearest one, for which the hits are counted first."""
    size = min(max(page_size, 1), most)
    last = max(1, math.ceil(hits.count() / size))
    return page_of(hits, min(max(page, 1), last), size, size, order)
