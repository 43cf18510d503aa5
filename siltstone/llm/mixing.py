"""Mixing sources to target weights.

Every document gets a hash-random key. Within each source the keys are sorted
by ranges: the leading key bits name a range, so that ranges hold about equal
shares of any source and a source of any size is spread over many tasks; rows
of one key, too many for a range, are cut on by size and text hash. Sizes
are summed per range, the sums of the ranges before it are a range's offset,
and a window inside the range gives each document its exact prefix sum. A
source's budget is then cut to the word: whole epochs first, and of one more
epoch the documents in key order until the budget is used up, the last of them
in part.

Targets: source i, in code-point order with null last, has weight
``weights[i mod len(weights)]``; together they share ``ratio`` times all
words; no target exceeds ``max_epochs`` times its source, and what is over
goes to the others by weight until none is above (solved in one pass over the
sources sorted by cap/weight).

Edge cases: null text has size 0 and a null source is a source; a source
without words has target 0; an empty table gives no rows; rows that repeat a
doc_id are rows of their own, ordered by size where the keys tie; equal rows
are interchangeable. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.shared import known_id, written

WORDS = r"[^\x20\x09-\x0D]+"
KEY_BITS = 60


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """doc_id, row (hash of the text), source, size and key of each document."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text_col).alias("row"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(name), 1, KEY_BITS // 4), 16, 10).cast("long").alias("key"),
    )


def targets(sizes: DataFrame, ratio: float, weights: tuple[float, ...], max_epochs: int) -> DataFrame:
    """source, source_size, target; from a table with one row a source."""
    every = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    cap = (F.col("source_size") * max_epochs).cast("double")
    by_cap = Window.orderBy("fill", F.col("source").isNull(), "source")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    behind = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.lit(ratio) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(behind)
    out = sizes.withColumn("weight", weight).withColumn("cap", cap).withColumn("fill", F.col("cap") / F.col("weight")).withColumn("level", level)
    out = out.withColumn("level", F.first(F.when(F.col("fill") >= F.col("level"), F.col("level")), ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return out.select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"))


def mix(
    docs: DataFrame,
    ratio: float = 1.5,
    weights: tuple[float, ...] = (3, 1, 2),
    max_epochs: int = 2,
    rows_per_range: int = 20_000,
    **columns: str,
) -> DataFrame:
    """doc_id, row, source, size, source_size, target, taken of every document."""
    base = written(sized(docs, **columns), "sized")
    rows = base.count()
    bits = max(6, math.ceil(math.log2(max(rows, 1) / rows_per_range)) if rows > rows_per_range else 0)
    base = base.withColumn("range", F.shiftright("key", KEY_BITS - bits).cast("int"))
    # nulls join like values
    base = base.withColumn("nil", F.col("source").isNull()).withColumn("source", F.coalesce("source", F.lit("")))
    # a key that very many rows share, as those without a doc_id do, is a run of ranges of its own:
    # rows there are ordered by size and text hash, so these cut it further
    heavy = base.groupBy("range").count().where(F.col("count") > 4 * rows_per_range).select("range")
    hot = base.join(heavy, "range", "left_semi").groupBy("range", "key").count().where(F.col("count") > rows_per_range)
    hot = hot.groupBy("range").agg(F.sort_array(F.collect_list("key")).alias("hot"))
    base = base.join(hot, "range", "left")
    big = F.coalesce(F.array_contains("hot", F.col("key")), F.lit(False))
    step = F.coalesce(F.size(F.filter("hot", lambda k: k < F.col("key"))), F.lit(0)) * 2 + big.cast("int")
    cuts = {"step": step, "of_size": F.when(big, F.col("size")).otherwise(F.lit(0)), "of_text": F.when(big, F.shiftright("row", 56)).otherwise(F.lit(0))}
    base = base.withColumns(cuts).drop("hot")
    place = ["range", "step", "of_size", "of_text"]
    at = ["nil", "source", *place]
    ranges = base.groupBy(*at).agg(F.sum("size").alias("range_size"))
    in_order = Window.partitionBy("nil", "source").orderBy(*place)
    ranges = ranges.withColumn("offset", F.sum("range_size").over(in_order) - F.col("range_size"))
    per_source = ranges.groupBy("nil", "source").agg(F.sum("range_size").alias("source_size"))
    named = per_source.select(F.when(~F.col("nil"), F.col("source")).alias("source"), "source_size")
    goal = targets(named, ratio, weights, max_epochs)
    goal = goal.select(F.col("source").isNull().alias("nil"), F.coalesce("source", F.lit("")).alias("source"), "source_size", "target")
    ranges = ranges.join(goal, ["nil", "source"]).select(*at, "offset", "source_size", "target")
    inside = Window.partitionBy(*at).orderBy("key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    out = base.withColumn("prefix", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(ranges, at)
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size")).cast("long")).otherwise(F.lit(0).cast("long"))
    rest = budget - epochs * F.col("source_size")
    last = F.least(F.greatest(rest - F.col("offset") - F.col("prefix"), F.lit(0).cast("long")), F.col("size"))
    return out.select(
        "doc_id", "row", F.when(~F.col("nil"), F.col("source")).alias("source"), "size", "source_size", "target", (epochs * F.col("size") + last).cast("long").alias("taken")
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: each document as often as its words are taken, the one that is cut to the nearest whole.

    All columns stay. Documents without words take no part. Equal rows come
    as one, as often as all of them together.
    """
    plan = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    keys = {"__doc": known_id(plan, "doc_id"), "__nil": F.col("doc_id").isNull(), "__row": F.col("row")}
    plan = plan.where("taken > 0").withColumns(keys).groupBy("__doc", "__nil", "__row").agg(F.sum(F.round(F.col("taken") / F.col("size"))).cast("int").alias("__times"))
    keyed = docs.withColumns({"__doc": known_id(docs, id_col), "__nil": F.col(id_col).isNull(), "__row": F.xxhash64(text_col)})
    keyed = keyed.join(plan.where("__times > 0"), ["__doc", "__nil", "__row"]).dropDuplicates(["__doc", "__nil", "__row"])
    return keyed.select(*[f"`{c}`" for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("__times"))).alias("__n")).drop("__n")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
             ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS weight, (2 * source_size)::DOUBLE AS cap FROM s),
f AS (SELECT *, cap / weight AS fill FROM w),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
        - coalesce(sum(cap) OVER (ORDER BY fill, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
        / sum(weight) OVER (ORDER BY fill, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
v AS (SELECT arg_min(level, fill) AS level FROM l WHERE fill >= level),
g AS (SELECT source, source_size, CASE WHEN v.level IS NULL THEN cap ELSE least(cap, v.level * weight) END AS target FROM l LEFT JOIN v ON true),
e AS (SELECT d.doc_id, d.size, g.source_size, g.target, floor(g.target)::BIGINT AS budget,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prefix
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
n AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM e)
SELECT doc_id, size, source_size, target, (epochs * size + least(greatest(budget - epochs * source_size - prefix, 0), size))::BIGINT AS taken FROM n
"""
