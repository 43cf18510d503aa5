"""Exact k nearest binary codes by incremental multi-index hashing, as joins of growing radius.

A code of 64 bits is cut into segments, about as wide as the number of
distinct codes has bits, and a table of postings leads from (segment, value)
to the codes that have it. Each query still open looks up the values that differ
from its own in up to r bits, in every segment, and the full Hamming distance
of what it finds is verified. Then every code within ``segments * (r + 1) - 1``
bits has been seen (a farther one alone can differ by more than r in each
segment), so a query is closed as soon as its k-th best distance is no more
than that; r grows by one a round until all are. The first round goes to the
radius at which random codes would be closed where that takes few look-ups,
else to the one below, as the radii up to that one together are a fraction of
the next. The answer is exact.

A pair shows up at one segment and radius only: where its difference is the
least, the first such segment. Queries of one code are searched for once, and
codes that many rows have are one entry with the ids that an answer can need,
so copies cost nothing. A round's k-th distance comes from counts by distance,
which are summed before the shuffle. Of the rounds only row counts reach the
driver.

Edge cases: null, empty or wrong-sized embeddings have no code; they are
neither found nor asked for. A table whose vectors all have another size is an
error. A query never finds rows with its own id. A query that is asked
repeatedly is answered once; an id with several codes has an answer for each.
Rows that repeat an id are rows like others. Fewer than k other rows: all of
them. Ties go to the smaller id. Rows with a null id are ignored. Zero counts
as positive, NaN as negative.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, comb, log2
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.shared import written

BITS = 64
#: Look-ups of a round that are worth less than a round.
FEW = 1 << 22


def binary_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and code: bit i is 1 where component i of a 64-dimensional vector is at least zero.

    Reads the sizes once at the call: ValueError if there are vectors and none has 64 dimensions.
    """
    size = F.size(vector_col)
    fit, largest = vectors.agg(F.max(size == BITS), F.max(size)).first()
    if not fit and (largest or 0) > 0:
        raise ValueError(f"no vector of {vector_col} has {BITS} dimensions; the largest has {largest}")
    # NaN is the largest number to Spark
    bits = F.transform(F.col(vector_col), lambda x, i: F.when((x >= 0) & ~F.isnan(x), F.expr("1L")).otherwise(F.expr("0L")))
    code = F.aggregate(F.reverse(bits), F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))
    whole = (size == BITS) & F.col(id_col).isNotNull()
    return vectors.where(whole).select(F.col(id_col).cast("long").alias("id"), code.alias("code"))


def segments_for(codes: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment, for a number of distinct codes."""
    n = min(max(ceil(BITS / max(2.0, log2(max(codes, 2)))), 2), 32)
    edges = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _segment(code, first: int, width: int):
    return F.shiftrightunsigned(code, first).bitwiseAND(F.lit((1 << width) - 1))


def _values(code, cut: list[tuple[int, int]]):
    return F.posexplode(F.array(*[_segment(code, *c) for c in cut])).alias("segment", "value")


def first_radius(codes: int, queries: int, k: int, cut: list[tuple[int, int]]) -> int:
    """The radius that would close queries of ``codes`` random codes, or that below it if this takes over ``FEW`` look-ups."""
    within = 0
    for far in range(BITS):
        within += comb(BITS, far)
        if codes * within >= k << BITS:
            break
    radius = max(0, ceil((far + 1) / len(cut)) - 1)
    looks = queries * sum(comb(w, r) for _, w in cut for r in range(radius + 1))
    return radius if looks <= FEW else max(0, radius - 1)


def _joined(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join without broadcast, as every side here grows with codes or queries."""
    return left.join(right.hint("merge"), on, how)


def _probes(live: DataFrame, cut: list[tuple[int, int]], radii: range) -> DataFrame:
    """q, need, segment, value, radius: what the queries look up.

    Each step flips one bit behind the last flipped, or none from there on, so
    each set of bits comes once.
    """
    out = live.select("q", "need", _values(F.col("q"), cut)).withColumns({"last": F.lit(-1), "radius": F.lit(0)})
    width = F.element_at(F.array(*[F.lit(w) for _, w in cut]), F.col("segment") + 1)
    for _ in range(radii.stop - 1):
        out = out.withColumn("last", F.explode(F.sequence(F.least(F.col("last") + 1, width), width)))
        flips = F.col("last") < width
        out = out.withColumns({"value": F.when(flips, F.expr("value ^ shiftleft(1L, last)")).otherwise(F.col("value")), "radius": F.col("radius") + flips.cast("int")})
    return out.where(F.col("radius") >= radii.start).drop("last")


def _found(live: DataFrame, postings: DataFrame, cut: list[tuple[int, int]], radii: range) -> DataFrame:
    """q, need, code, rows, distance of the pairs that show up first at these radii."""
    pairs = _joined(_probes(live, cut, radii), postings, ["segment", "value"])
    apart, radius = F.col("q").bitwiseXOR(F.col("code")), F.col("radius")
    first = []
    for n, c in enumerate(cut):
        bits = F.bit_count(_segment(apart, *c))
        first.append(F.when(F.col("segment") > n, bits > radius).otherwise(bits >= radius))
    return pairs.where(reduce(and_, first)).select("q", "need", "code", "rows", F.bit_count(apart).alias("distance"))


def _nearest(found: DataFrame) -> DataFrame:
    """found as far as each query's needed number of rows reaches, with that distance (kth; null if there are too few)."""
    counts = found.groupBy("q", "need", "distance").agg(F.sum("rows").alias("rows"))
    upto = F.sum("rows").over(Window.partitionBy("q").orderBy("distance"))  # 65 distances at most
    kth = counts.withColumn("upto", upto).where(F.col("upto") >= F.col("need")).groupBy("q").agg(F.min("distance").alias("kth"))
    return _joined(found, kth, "q", "left").where(F.col("kth").isNull() | (F.col("distance") <= F.col("kth")))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, neighbor_id, distance. vectors and queries: id and code, as from binary_codes."""
    # k + 1 ids of a code are the most that an answer can need: k, and the query's own; Spark applies
    # this limit before the shuffle too, so copies of one code don't meet in a task
    held = vectors.groupBy("code", "id").agg(F.count("*").alias("n")).withColumn("place", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("place") <= k + 1)
    ids = F.sort_array(F.collect_list(F.struct("id", F.least("n", F.lit(k)).alias("n"))))
    entries = written(held.groupBy("code").agg(ids.alias("ids"), F.sum("n").alias("rows")), "entries")
    # as many rows more than k as the asking id may have itself
    asked = queries.select("id", F.col("code").alias("q")).distinct()
    own = _joined(vectors, asked.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.count("*").alias("own"))
    asked = written(_joined(asked, own, "id", "left").withColumn("need", F.coalesce("own", F.lit(0)) + k), "asked")
    live = asked.groupBy("q").agg(F.max("need").alias("need"))
    codes = entries.count()
    cut = segments_for(codes)
    postings = entries.select("code", "rows", _values(F.col("code"), cut))
    open_, closed, seen = None, [], 0
    start, widest = first_radius(codes, asked.count(), k, cut), max(w for _, w in cut)
    while seen <= widest:
        radii = range(seen, max(seen, min(start, widest)) + 1)
        new, seen = _found(live, postings, cut, radii), radii.stop
        near = written(_nearest(new if open_ is None else open_.drop("kth").unionByName(new)), f"radius-{seen - 1}")
        sure = F.coalesce(F.col("kth") < len(cut) * seen, F.lit(False))
        closed.append(near.where(sure))
        open_ = near.where(~sure)
        live = _joined(live, closed[-1].select("q").distinct(), "q", "left_anti")
        if live.isEmpty():
            break
    else:
        closed.append(open_)  # all there is has been seen
    best = reduce(DataFrame.unionByName, closed).select("q", "code", "distance")
    best = _joined(best, asked.select("q", F.col("id").alias("query_id")), "q")
    rows = _joined(best, entries.select("code", "ids"), "code").select("query_id", "q", "distance", F.inline("ids")).where("id <> query_id")
    rows = rows.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    order = F.row_number().over(Window.partitionBy("query_id", "q").orderBy("distance", "id"))
    return rows.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("neighbor_id"), F.col("distance").cast("int").alias("distance"))


ORACLE = """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x >= 0 AND NOT isnan(x) THEN '1' ELSE '0' END).array_to_string('')::BIT AS code
           FROM embeddings WHERE len(embedding) = 64 AND vec_id IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS neighbor_id, bit_count(xor(q.code, c.code))::INT AS distance
      FROM c q JOIN c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id)::INT AS rank FROM p)
SELECT query_id, rank, neighbor_id, distance FROM r WHERE rank <= 10
"""
