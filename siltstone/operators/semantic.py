"""Vector search: scores, nearest neighbours, several queries, thresholds and score scaling."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.vectors import cosine, dot, literal
from siltstone.operators.fields import BadQuery

#: Scores are ordered after rounding, so that the order of a sum never shows.
PLACES = 9


@dataclass(frozen=True)
class VectorQuery:
    vector: tuple[float, ...]
    weight: float = 1.0

    def __post_init__(self):
        if not self.vector or any(x != x or abs(x) == float("inf") for x in self.vector):
            raise BadQuery("a query vector has finite components, one at least")


def scored(vectors: DataFrame, query: Sequence[float], id_col: str = "id", vector_col: str = "vector", inner_product: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """id, the columns of ``keep``, score of every vector."""
    q = literal(query)
    score = dot(vector_col, q) if inner_product else cosine(vector_col, q, norm_b=F.lit(sum(float(x) ** 2 for x in query) ** 0.5))
    return vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), *keep, score.alias("score"))


def by_score(hits: DataFrame) -> list:
    return [F.round("score", PLACES).desc(), F.col("id")]


def nearest(vectors: DataFrame, query: Sequence[float], k: int, **columns) -> DataFrame:
    """The k best by score, then id."""
    if k <= 0:
        raise BadQuery("k is at least 1")
    hits = scored(vectors, query, **columns)
    return hits.orderBy(*by_score(hits)).limit(k)


class VectorStore(Protocol):
    """What vector search asks: anything with this method can stand in for the table of vectors."""

    def scores(self, queries: Sequence[VectorQuery], scope: DataFrame | None = None) -> DataFrame:
        """query (its number), id, score; only of the ids in ``scope`` (column id) if given."""
        ...


@dataclass(frozen=True)
class TableStore:
    """A table of vectors, which are all scored by cosine, every query in one pass."""

    vectors: DataFrame
    id_col: str = "id"
    vector_col: str = "vector"

    def scores(self, queries: Sequence[VectorQuery], scope: DataFrame | None = None) -> DataFrame:
        each = [F.struct(F.lit(i).alias("query"), cosine(self.vector_col, literal(q.vector), norm_b=F.lit(sum(x * x for x in q.vector) ** 0.5)).alias("score")) for i, q in enumerate(queries)]
        found = self.vectors.where(F.col(self.vector_col).isNotNull())
        if scope is not None:
            found = found.join(scope.select(F.col("id").alias(self.id_col)), self.id_col, "left_semi")
        return found.select(F.col(self.id_col).alias("id"), F.inline(F.array(*each)))


Combine = Callable[[DataFrame, Sequence[VectorQuery]], DataFrame]
_combinations: dict[str, Combine] = {}


def register_combination(name: str) -> Callable[[Combine], Combine]:
    def put(fn: Combine) -> Combine:
        if name in _combinations:
            raise ValueError(f"{name!r} is registered already")
        _combinations[name] = fn
        return fn

    return put


def combination(name: str) -> Combine:
    if name not in _combinations:
        raise BadQuery(f"no combination {name!r}; there are {sorted(_combinations)}")
    return _combinations[name]


@register_combination("max_score")
def max_score(pooled: DataFrame, queries: Sequence[VectorQuery]) -> DataFrame:
    return pooled.groupBy("id").agg(F.max("score").alias("score"))


@register_combination("weighted_average")
def weighted_average(pooled: DataFrame, queries: Sequence[VectorQuery]) -> DataFrame:
    """The weights of all queries divide, also of those that an id is absent from."""
    total = sum(q.weight for q in queries)
    if total <= 0:
        raise BadQuery("the weights sum to nothing")
    weight = F.element_at(F.array(*[F.lit(float(q.weight)) for q in queries]), F.col("query") + 1)
    return pooled.groupBy("id").agg((F.sum(F.col("score") * weight) / F.lit(float(total))).alias("score"))


def multi_search(vectors: DataFrame | VectorStore, queries: Sequence[VectorQuery], combine: str = "max_score", pool: int | None = None, top_k: int | None = None, scope: DataFrame | None = None) -> DataFrame:
    """id, score over several queries: each query's ``pool`` best, combined, and of those the ``top_k`` best."""
    if not queries:
        raise BadQuery("no query vector")
    store = TableStore(vectors) if isinstance(vectors, DataFrame) else vectors
    pooled = store.scores(queries, scope)
    if pool is not None:
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.round("score", PLACES).desc(), "id"))
        pooled = pooled.withColumn("place", place).where(F.col("place") <= pool).drop("place")
    hits = combination(combine)(pooled, queries)
    return hits if top_k is None else hits.orderBy(*by_score(hits)).limit(top_k)


def over_threshold(hits: DataFrame, threshold: float, most: int | None = None) -> DataFrame:
    out = hits.where(F.col("score") >= threshold)
    return out if most is None else out.orderBy(*by_score(out)).limit(most)


@dataclass(frozen=True)
class AutoTune:
    """Walk of the threshold towards a wanted number of hits."""

    start: float = 0.8
    step: float = 0.002
    low: float = 0.7
    high: float = 1.0
    least: int = 7
    most: int = 25

    def grid(self) -> list[float]:
        """Every threshold that the walk can stand on, by repeated steps as the walk takes them."""
        out = {round(self.start, 6): self.start}
        for sign in (-1, 1):
            t = self.start
            while self.low < t < self.high:
                t = min(self.high, max(self.low, t + sign * self.step))
                out.setdefault(round(t, 6), t)
        return list(out.values())

    def walk(self, counts: dict[float, int]) -> float:
        """The threshold chosen, given the number of hits at each of the grid (rounded to 6 places)."""
        t, seen, best, best_miss = self.start, set(), self.start, None
        while round(t, 6) not in seen:
            seen.add(round(t, 6))
            n = counts[round(t, 6)]
            miss = max(self.least - n, n - self.most, 0)
            if best_miss is None or miss < best_miss:
                best, best_miss = t, miss
            if not miss:
                break
            t = min(self.high, max(self.low, t - self.step if n < self.least else t + self.step))
            if t in (self.low, self.high):
                break
        return best


def auto_tuned(hits: DataFrame, tune: AutoTune = AutoTune()) -> DataFrame:
    """Hits over the threshold at which their number is nearest to the wanted one.

    One aggregation counts the hits at every threshold of the grid; only those
    counts, whose number the step bounds, reach the driver.
    """
    grid = tune.grid()
    row = hits.agg(*[F.count_if(F.col("score") >= t).alias(f"n{i}") for i, t in enumerate(grid)]).first()
    return over_threshold(hits, tune.walk({round(t, 6): row[i] for i, t in enumerate(grid)}))


# -- score scaling: over a whole result, whose totals are one aggregated row --


def _with_totals(hits: DataFrame, **totals) -> DataFrame:
    return hits.crossJoin(F.broadcast(hits.agg(*[v.alias(k) for k, v in totals.items()])))


def scale_minmax(hits: DataFrame) -> DataFrame:
    """scaled = (score - min) / (max - min); 1 where all scores are equal."""
    t = _with_totals(hits, lo=F.min("score"), hi=F.max("score"))
    span = F.col("hi") - F.col("lo")
    return t.select(*hits.columns, F.when(span == 0, F.lit(1.0)).otherwise((F.col("score") - F.col("lo")) / span).alias("scaled"))


def scale_zsigmoid(hits: DataFrame) -> DataFrame:
    """scaled = logistic of the standard score; 1 where the scores don't vary."""
    t = _with_totals(hits, mean=F.avg("score"), sd=F.stddev_pop("score"))
    z = (F.col("score") - F.col("mean")) / F.col("sd")
    return t.select(*hits.columns, F.when(F.col("sd") < 1e-12, F.lit(1.0)).otherwise(1 / (1 + F.exp(-z))).alias("scaled"))


def rank_percentile(hits: DataFrame, ranges: int = 256) -> DataFrame:
    """scaled = 1 for the best, 0 for the worst, evenly between; 1 for a single hit.

    Hits are ranked inside ranges of the score, whose bounds one aggregation
    estimates, and a range's place is the number of hits above it. Hits of
    equal score are in one range.
    """
    score = F.round("score", PLACES)
    cuts = hits.agg(F.percentile_approx(score, [i / ranges for i in range(1, ranges)])).first()[0] or []
    cut = F.array(*[F.lit(c) for c in sorted(set(cuts))] or [F.lit(0.0)])
    placed = hits.withColumn("range", F.size(F.filter(cut, lambda c: c > score)))
    sizes = placed.groupBy("range").agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))  # over the ranges only
    sizes = sizes.select("range", F.coalesce(above, F.lit(0)).alias("above"), F.sum("n").over(Window.partitionBy()).alias("total"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*by_score(hits))) + F.col("above")
    scaled = F.when(F.col("total") == 1, F.lit(1.0)).otherwise(1 - (place - 1) / (F.col("total") - 1))
    return placed.join(F.broadcast(sizes), "range").select(*hits.columns, scaled.alias("scaled"))


def score_quantile(hits: DataFrame, q: float) -> DataFrame:
    """One row: the interpolated quantile of score; 0 without hits."""
    return hits.agg(F.coalesce(F.percentile("score", F.lit(min(1.0, max(0.0, q)))), F.lit(0.0)).alias("quantile"))
