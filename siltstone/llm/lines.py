"""Removal of lines that many sites share.

A line's spread is the number of distinct sites that have it. One aggregation
over all lines merges a HyperLogLog sketch of sites per line hash. Sketches
decide where the estimate is far from ``min_sites``; within ``margin`` of it
the sites of just those lines are counted exactly. A line of wide spread is
boilerplate: it stays where it occurs first (smallest doc_id, then place) and
goes everywhere else, so that text which exists only in copies is not lost;
with ``keep_first=False`` it goes everywhere.

Only DataFrame functions are used. A line hash is a pair of 64-bit hashes.
Lines end at a line feed and are compared without spaces at their ends (a
carriage return or tab there makes another line); those shorter than
``min_chars`` are never boilerplate. The joins on line hashes have one side
with a row a line; where the other is skewed, adaptive execution splits it.

Edge cases: null text has no lines and stays null; empty lines stay; a null
site counts as one site; a null doc_id comes after all others; rows that
repeat a doc_id are told apart by their text, equal rows are treated alike;
an empty table gives an empty table; other columns pass through, but those
named n_lines and n_removed are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import known_id, written


def wide_lines(lines: DataFrame, min_sites: int, margin: float, lg_k: int) -> DataFrame:
    """h1, h2 and first (doc, place) of the lines that at least ``min_sites`` sites have."""
    spread = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"), F.min(F.struct("nil", "doc", "row", "place")).alias("first"), F.count("*").alias("n")
    )
    low, high = min_sites * (1 - margin), min_sites * (1 + margin)
    spread = written(spread.where((F.col("n") >= min_sites) & (F.col("sites") >= low)).select("h1", "h2", "sites", "first"), "spread")
    near = spread.where(F.col("sites") < high).select("h1", "h2")
    exact = lines.join(near, ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct().groupBy("h1", "h2").count().where(F.col("count") >= min_sites)
    return spread.where(F.col("sites") >= high).select("h1", "h2", "first").unionByName(spread.join(exact.select("h1", "h2"), ["h1", "h2"]).select("h1", "h2", "first"))


def drop_shared_lines(
    docs: DataFrame,
    min_sites: int = 5,
    min_chars: int = 20,
    keep_first: bool = True,
    margin: float = 0.25,
    lg_k: int = 12,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
) -> DataFrame:
    """docs with boilerplate lines taken out of the text, and n_lines, n_removed."""
    row = F.xxhash64(text_col)
    doc, nil = known_id(docs, id_col), F.col(id_col).isNull()
    split = docs.where(F.col(text_col).isNotNull()).select(
        nil.alias("nil"), doc.alias("doc"), row.alias("row"), F.coalesce(F.concat(F.lit("s"), F.col(site_col).cast("string")), F.lit("n")).alias("site"), F.posexplode(F.split(text_col, "\n", -1)).alias("place", "line")
    )
    split = split.withColumn("line", F.trim("line")).where(F.length("line") >= min_chars)
    lines = split.select("nil", "doc", "row", "site", "place", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"))
    wide = written(wide_lines(lines, min_sites, margin, lg_k), "wide")
    hits = lines.join(wide, ["h1", "h2"])
    if keep_first:
        hits = hits.where(~(F.struct("nil", "doc", "row", "place") == F.col("first")))
    # where equal rows have a doc_id in common each place is listed once for all of them
    gone = hits.groupBy("nil", "doc", "row").agg(F.collect_set("place").alias("__gone"))
    plain = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_removed") and c not in (id_col, text_col, site_col)])
    names = plain.columns
    joined = plain.withColumns({"__nil": nil, "__doc": doc, "__row": row}).join(gone.withColumnsRenamed({c: f"__{c}" for c in ("nil", "doc", "row")}), ["__nil", "__doc", "__row"], "left")
    parts = F.split(text_col, "\n", -1)
    left = F.filter(F.transform(parts, lambda line, i: F.when(~F.array_contains("__gone", i), line)), lambda line: line.isNotNull())
    kept = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    n_lines = F.coalesce(F.size(parts), F.lit(0)).cast("long")
    return joined.select(
        *[kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in names],
        F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(n_lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


ORACLE = r"""
WITH a AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, source, unnest(range(len(ls))) AS place, unnest(ls) AS raw FROM a WHERE text IS NOT NULL),
t AS (SELECT *, trim(raw, ' ') AS line FROM l),
w AS (SELECT line, min(struct_pack(d := coalesce(doc_id, 9223372036854775807), p := place)) AS first FROM t
      WHERE length(line) >= 20 GROUP BY line HAVING count(DISTINCT coalesce('s' || source, 'n')) >= 5),
k AS (SELECT t.*, w.line IS NOT NULL AND NOT (w.first.d = coalesce(t.doc_id, 9223372036854775807) AND w.first.p = t.place) AS gone FROM t LEFT JOIN w ON t.line = w.line)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(raw, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM k GROUP BY doc_id
UNION ALL SELECT doc_id, 0::BIGINT, 0::BIGINT, NULL FROM a WHERE text IS NULL
"""
