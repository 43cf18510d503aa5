"""Every query over the driver tables, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import spans, text
from siltstone.functions.vectors import norm
from siltstone.operators import composite, facets, filters, ingest, lexical, ranking, semantic
from siltstone.operators.extract import enriched
from siltstone.operators.extract import extract_metadata as extract_pages
from siltstone.operators.fields import FieldDef, FieldType
from siltstone.operators.fuzzy import fuzzy_titles
from siltstone.plans import corpora as c
from siltstone.plans.config import Config, FilterConfig
from siltstone.plans.corpora import folded, with_
from siltstone.plans.engine import Request, SearchEngine
from siltstone.sources import readers, vector_cache

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(fn: Query) -> Query:
        _queries[fn.__name__] = fn
        if sql:
            _sql[fn.__name__] = sql
        return fn

    return put


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def six(column: str = "score"):
    return F.round(column, 6).alias(column)


# -- filters ------------------------------------------------------------------


def filtered(name: str, corpus: Query, fields: dict, request: dict, sql: str, overrides: dict | None = None) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return filters.apply_filters(corpus(spark, d), filters.build_filters(fields, overrides), request).select("id")

    run.__name__ = name
    query(sql)(run)


D, I, O = c.DOC_FIELDS, c.ITEM_FIELDS, c.ORDER_FIELDS
filtered("filter_equality", c.docs, D, {"lang": "en"}, with_("docs", "SELECT id FROM docs WHERE lang = 'en'"))
filtered("filter_equality_multi", c.docs, D, {"lang": ["en", "fr"]}, with_("docs", "SELECT id FROM docs WHERE lang IN ('en', 'fr')"))
filtered("filter_bool", c.docs, D, {"good": True}, with_("docs", "SELECT id FROM docs WHERE good"))
filtered("filter_null_semantics", c.docs, D, {"quality": [None, 0]}, with_("docs", "SELECT id FROM docs WHERE quality IS NULL OR quality = 0"))
filtered("filter_range_int", c.docs, D, {"n_chars": {"min": 500, "max": 2000}}, with_("docs", "SELECT id FROM docs WHERE n_chars BETWEEN 500 AND 2000"))
filtered("filter_range_exclusive", c.items, I, {"size": {"min": 10, "max": 20, "min_inclusive": False, "max_inclusive": False}}, with_("items", "SELECT id FROM items WHERE size > 10 AND size < 20"))
filtered("filter_range_open", c.items, I, {"price": {"min": 950}}, with_("items", "SELECT id FROM items WHERE price >= 950"))
filtered("filter_range_date", c.orders, O, {"day": {"min": "1995-01-01", "max": "1995-12-31"}}, with_("ords", "SELECT id FROM ords WHERE day BETWEEN DATE '1995-01-01' AND DATE '1995-12-31'"))
filtered("filter_contains_text", c.docs, D, {"source": ["SRC1", "rc7"]}, with_("docs", "SELECT id FROM docs WHERE contains(lower(source), 'src1') OR contains(lower(source), 'rc7')"))
filtered("filter_contains_list", c.items, I, {"tags": ["RED", "blue"]}, with_("items", "SELECT id FROM items WHERE list_has_any(list_transform(tags, lambda x: lower(x)), ['red', 'blue'])"))
filtered("filter_conjunction", c.docs, D, {"lang": ["en", "de"], "n_chars": {"min": 1000}, "source": "src1"}, with_("docs", "SELECT id FROM docs WHERE lang IN ('en', 'de') AND n_chars >= 1000 AND contains(lower(source), 'src1')"))
filtered("filter_ci_equality", c.docs, D, {"lang": ["EN", "De"]}, with_("docs", f"SELECT id FROM docs WHERE {folded('lang')} IN ('en', 'de')"), {"lang": filters.FoldedEquality})
filtered("filter_empty_is_all", c.docs, D, {"lang": [], "n_chars": {}, "source": None}, with_("docs", "SELECT id FROM docs"))


@query()
def filter_fuzzy_title(spark, d):
    return fuzzy_titles(c.items(spark, d).select("id", "title"), "title", ["smal rng", "widgit"])


# at threshold 1 a title is near a needle where it has it, accents and case aside
@query(with_("items", "SELECT id, title FROM items WHERE contains(lower(title), 'red') OR contains(lower(title), 'ring') OR lower(title) = 'small box'"))
def filter_fuzzy_exact(spark, d):
    return fuzzy_titles(c.items(spark, d).select("id", "title"), "title", ["R\u00c9D", "ri\u00f1g", "Small B\u00f6x"], 1.0)


# -- text rules ---------------------------------------------------------------


def rule(name: str, q: lexical.LexicalQuery, where: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return lexical.lexical_hits(c.docs(spark, d), q)

    run.__name__ = name
    query(with_("docs", f"SELECT id FROM docs WHERE {where}"))(run)


def has(term: str) -> str:
    return f"contains({folded('text')}, '{term}')"


rule("lexical_first_of", lexical.LexicalQuery(("STRASSE", "worthless", "ss")), f"{has('strasse')} OR {has('worthless')} OR {has('ss')}")
rule("lexical_mandatories", lexical.LexicalQuery((), ("tion", "Heit")), f"{has('tion')} AND {has('heit')}")
rule("lexical_grouped", lexical.LexicalQuery((), (("eau", "que"), ("ung", "sch"))), f"({has('eau')} AND {has('que')}) OR ({has('ung')} AND {has('sch')})")
rule("lexical_combined", lexical.LexicalQuery(("the", "der"), ("ing",)), f"{has('ing')} AND ({has('the')} OR {has('der')})")
rule("lexical_match_all", lexical.LexicalQuery(), "true")
rule("lexical_case_sensitive", lexical.LexicalQuery(("The ", "Der "), (), True), "contains(text, 'The ') OR contains(text, 'Der ')")


CASES = ["o\uFB03ce", "\u039F\u0394\u039F\u03A3", "Stra\u00DFe", "\u0149 dag", "STRASSE \u017Fo", "plain", "\u0130stanbul"]


@query("SELECT doc_id FROM documents WHERE doc_id % 7 IN (0, 1, 2, 4)")
def lexical_casefold(spark, d):
    """Full case folding: a ligature, capital and final sigma, sharp s; no match by mere lower case of the rest."""
    word = F.element_at(F.array(*[F.lit(x) for x in CASES]), (F.col("doc_id") % 7 + 1).cast("int"))
    docs = c.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat("source", F.lit(" "), word).alias("text"))
    return lexical.lexical_hits(docs, lexical.LexicalQuery(("OFFICE", "\u03BF\u03B4\u03BF\u03C2", "strasse"))).select(F.col("id").alias("doc_id"))


# -- vectors ------------------------------------------------------------------


@query(with_("vecs q sim", "SELECT id, round(score, 6) AS score FROM sim"))
def cosine_scores(spark, d):
    return semantic.scored(c.vectors(spark, d), c.query_vector(spark, d)).select("id", six())


@query(with_("vecs q sim", "SELECT id, round(score, 6) AS score FROM sim ORDER BY round(score, 9) DESC, id LIMIT 10"))
def knn_topk(spark, d):
    return semantic.nearest(c.vectors(spark, d), c.query_vector(spark, d), 10).select("id", six())


@query(with_("vecs q", "SELECT id, round(list_inner_product(v, qv), 6) AS score FROM vecs, q ORDER BY round(list_inner_product(v, qv), 9) DESC, id LIMIT 10"))
def inner_product_topk(spark, d):
    return semantic.nearest(c.vectors(spark, d), c.query_vector(spark, d), 10, inner_product=True).select("id", six())


@query(with_("docs vecs q sim", "SELECT id, round(score, 6) AS score FROM sim SEMI JOIN (SELECT id FROM docs WHERE lang = 'en') USING (id)"))
def semantic_scoped(spark, d):
    docs = filters.apply_filters(c.docs(spark, d), filters.build_filters(D), {"lang": "en"})
    return semantic.scored(c.vectors(spark, d).join(docs.select("id"), "id", "left_semi"), c.query_vector(spark, d)).select("id", six())


@query(with_("docs vecs qs sims", "SELECT id, round(max(score), 6) AS score FROM sims SEMI JOIN docs USING (id) WHERE n < 2 GROUP BY id"))
def semantic_text(spark, d):
    known = {f"query: {n}": c.query_vector(spark, d, n) for n in (0, 1)}
    embedder = vector_cache.TextEmbedder("m", lambda texts: [known[t] for t in texts], query_prefix="query: ")
    engine = SearchEngine(Config({n: FilterConfig(f, o) for n, (f, o) in D.items()}, weights=(1.0, 0.0)), c.docs(spark, d).drop("doc_id"), c.vectors(spark, d), embedder)
    return engine.hits(Request(semantic_text=("0", "1"))).select("id", six())


def three(spark, d, weighted: bool = False):
    return [semantic.VectorQuery(c.query_vector(spark, d, i), 3.0 - i if weighted else 1.0) for i in range(3)]


@query(with_("vecs qs sims", "SELECT id, round(max(score), 6) AS score FROM sims GROUP BY id"))
def multi_query_max(spark, d):
    return semantic.multi_search(c.vectors(spark, d), three(spark, d)).select("id", six())


@query(with_("vecs qs sims", "SELECT id, round(sum(w * score) / 6, 6) AS score FROM sims GROUP BY id"))
def multi_query_weighted(spark, d):
    return semantic.multi_search(c.vectors(spark, d), three(spark, d, True), "weighted_average").select("id", six())


@query(with_("vecs qs sims", """, r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY round(score, 9) DESC, id) AS place FROM sims), s AS (SELECT id, max(score) AS score FROM r WHERE place <= 20 GROUP BY id)
    SELECT id, round(score, 6) AS score FROM s ORDER BY round(score, 9) DESC, id LIMIT 15"""))
def semantic_pool(spark, d):
    return semantic.multi_search(c.vectors(spark, d), three(spark, d), pool=20, top_k=15).select("id", six())


@query(with_("vecs q sim", "SELECT id, round(score, 6) AS score FROM sim WHERE score >= 0.15"))
def threshold_filter(spark, d):
    return semantic.over_threshold(semantic.scored(c.vectors(spark, d), c.query_vector(spark, d)), 0.15).select("id", six())


TUNE = semantic.AutoTune(start=0.3, step=0.01, low=0.05, high=0.9)
_tuned = """, walk(t, n, steps, stop) AS (
  SELECT t, n, 1, n BETWEEN 7 AND 25 FROM (SELECT 0.3::DOUBLE AS t, (SELECT count(*) FROM sim WHERE score >= 0.3) AS n)
  UNION ALL
  SELECT u, (SELECT count(*) FROM sim WHERE score >= u), steps + 1, (SELECT count(*) FROM sim WHERE score >= u) BETWEEN 7 AND 25
  FROM (SELECT least(0.9, greatest(0.05, CASE WHEN n < 7 THEN t - 0.01 ELSE t + 0.01 END))::DOUBLE AS u, n, steps, stop FROM walk) WHERE NOT stop AND u > 0.05 AND u < 0.9 AND steps < 200),
best AS (SELECT arg_min(t, struct_pack(m := greatest(7 - n, n - 25, 0), s := steps)) AS t FROM walk)
SELECT id, round(score, 6) AS score FROM sim, best WHERE score >= best.t"""


@query(with_("vecs q sim", _tuned).replace("WITH ", "WITH RECURSIVE ", 1))
def autotuned_search(spark, d):
    return semantic.auto_tuned(semantic.scored(c.vectors(spark, d), c.query_vector(spark, d)), TUNE).select("id", six())


@query(with_("vecs q sim", ", s AS (SELECT id, score, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS x FROM sim) SELECT id, round(x, 6) AS scaled FROM s"))
def scale_minmax(spark, d):
    return semantic.scale_minmax(semantic.scored(c.vectors(spark, d), c.query_vector(spark, d))).select("id", six("scaled"))


@query(with_("vecs q sim", "SELECT id, round(1 / (1 + exp(-(score - avg(score) OVER ()) / stddev_pop(score) OVER ())), 6) AS scaled FROM sim"))
def scale_zsigmoid(spark, d):
    return semantic.scale_zsigmoid(semantic.scored(c.vectors(spark, d), c.query_vector(spark, d))).select("id", six("scaled"))


@query(with_("vecs q sim", "SELECT id, round(1 - (row_number() OVER (ORDER BY round(score, 9) DESC, id) - 1) / (count(*) OVER () - 1)::DOUBLE, 6) AS scaled FROM sim"))
def rank_percentile(spark, d):
    return semantic.rank_percentile(semantic.scored(c.vectors(spark, d), c.query_vector(spark, d))).select("id", six("scaled"))


@query(with_("vecs q sim", "SELECT round(quantile_cont(score, 0.9), 6) AS quantile FROM sim"))
def score_quantile(spark, d):
    return semantic.score_quantile(semantic.scored(c.vectors(spark, d), c.query_vector(spark, d)), 0.9).select(six("quantile"))


# -- ranking and pages --------------------------------------------------------

_lex = f"lex AS (SELECT id FROM docs WHERE {has('ss')})"
_rank = f""", {_lex}, r AS (SELECT coalesce(s.id, l.id) AS id, 0.7::DOUBLE * coalesce(s.score, 0) + 0.3::DOUBLE * CASE WHEN l.id IS NULL THEN 0 ELSE 1 END AS score,
  s.score AS semantic_score, l.id IS NOT NULL AS lexical_matched FROM sim s FULL JOIN lex l ON s.id = l.id)"""


def ranked(spark, d) -> DataFrame:
    sem = semantic.scored(c.vectors(spark, d), c.query_vector(spark, d))
    return ranking.merged(sem, lexical.lexical_hits(c.docs(spark, d), lexical.LexicalQuery(("ss",))), (0.7, 0.3))


@query(with_("docs vecs q sim", _rank + " SELECT id, round(score, 6) AS score, round(semantic_score, 6) AS semantic_score, lexical_matched FROM r"))
def rank_weighted_sum(spark, d):
    return ranked(spark, d).select("id", six(), six("semantic_score"), "lexical_matched")


@query(with_("docs vecs q sim", _rank + " SELECT id, CASE WHEN semantic_score IS NOT NULL AND lexical_matched THEN 'vector|text' WHEN lexical_matched THEN 'text' ELSE 'vector' END AS fields FROM r"))
def merge_fields(spark, d):
    sem = F.when(F.col("semantic_score").isNotNull(), F.array(F.lit("vector")))
    lex = F.when(F.col("lexical_matched"), F.array(F.lit("text")))
    return ranked(spark, d).select("id", F.array_join(ranking.matched_fields(sem, lex), "|").alias("fields"))


@query(with_("docs vecs q sim", _rank + " SELECT r.id, round(score, 6) AS score, lang, source, n_chars, quality FROM r JOIN docs USING (id)"))
def hydrate(spark, d):
    return ranked(spark, d).join(c.docs(spark, d), "id").select("id", six(), "lang", "source", "n_chars", "quality")


@query(with_("docs vecs q sim", _rank + " SELECT id, round(score, 6) AS score FROM r ORDER BY round(score, 9) DESC, id LIMIT 20 OFFSET 20"))
def paginate_page(spark, d):
    return ranking.page_of(ranked(spark, d), 2, 20).select("id", six())


@query(with_("docs vecs q sim", _rank + " SELECT 2 AS page, 20 AS page_size, count(*) AS total_hits, ceil(count(*) / 20)::BIGINT AS total_pages, true AS has_previous, 2 < ceil(count(*) / 20) AS has_next FROM r"))
def paginate_meta(spark, d):
    return ranking.page_info(ranked(spark, d), 2, 20)


@query(with_("docs vecs q sim", _rank + " SELECT id, round(score, 6) AS score FROM r ORDER BY round(score, 9) DESC, id LIMIT 100 OFFSET 99999900"))
def paginate_beyond(spark, d):
    return ranking.page_of(ranked(spark, d), 1_000_000, 500).select("id", six())


@query(with_("docs vecs q sim", _rank + ", n AS (SELECT count(*) AS n FROM r), p AS (SELECT id, score, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS place FROM r) SELECT id, round(score, 6) AS score FROM p, n WHERE place > (ceil(n / 30) - 1) * 30"))
def legacy_paginate(spark, d):
    return ranking.clamped_page(ranked(spark, d), 1_000_000).select("id", six())


def doc_engine(spark, d) -> SearchEngine:
    shape = {n: FilterConfig(f, o) for n, (f, o) in D.items()}
    return SearchEngine(Config(shape, weights=(0.6, 0.4)), c.docs(spark, d).drop("doc_id"), c.vectors(spark, d))


_flag = f""", cand AS (SELECT * FROM docs WHERE lang IN ('en', 'fr') AND n_chars BETWEEN 200 AND 20000), s AS (SELECT sim.id, score FROM sim SEMI JOIN cand USING (id)),
  l AS (SELECT id FROM cand WHERE {has('worthless')} OR {has('ss')}),
  r AS (SELECT coalesce(s.id, l.id) AS id, 0.6::DOUBLE * coalesce(s.score, 0) + 0.4::DOUBLE * CASE WHEN l.id IS NULL THEN 0 ELSE 1 END AS score, l.id IS NOT NULL AS m FROM s FULL JOIN l ON s.id = l.id),
  p AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS place FROM r)
SELECT place::INT AS place, p.id, round(score, 6) AS score, CASE WHEN m THEN 'text' ELSE '' END AS matched_fields, lang, source, n_chars, quality FROM p JOIN docs USING (id) WHERE place <= 20"""


@query(with_("docs vecs q sim", _flag))
def search_page(spark, d):
    """Flagship: filters, text rule, vector, merge, page, metadata."""
    request = Request((semantic.VectorQuery(c.query_vector(spark, d)),), (), lexical.LexicalQuery(("worthless", "ss")), {"lang": ["en", "fr"], "n_chars": {"min": 200, "max": 20000}})
    engine = doc_engine(spark, d)
    page = engine.page(engine.hits(request), 1, 20)
    return page.select("place", "id", six(), F.array_join("matched_fields", "|").alias("matched_fields"), "lang", "source", "n_chars", "quality")


# -- facets and summaries -----------------------------------------------------


@query(with_("docs", "SELECT lang AS value, count(*) AS count FROM docs WHERE lang IS NOT NULL GROUP BY lang"))
def facet_values(spark, d):
    return facets.value_counts(c.docs(spark, d), "lang")


@query(with_("items", "SELECT value, count(*) AS count FROM (SELECT unnest(list_distinct(tags)) AS value FROM items) GROUP BY value"))
def facet_list(spark, d):
    return facets.item_counts(c.items(spark, d), "tags")


@query(with_("ords", "SELECT min(day) AS min, max(day) AS max FROM ords"))
def facet_range(spark, d):
    return facets.bounds(c.orders(spark, d), "day")


@query(with_("docs", "SELECT count(quality) AS available FROM docs"))
def facet_available(spark, d):
    return c.docs(spark, d).agg(F.count("quality").alias("available"))


_all = """, long AS (
  SELECT 'lang' AS field, 'available' AS kind, NULL AS value, NULL::DOUBLE AS key FROM docs WHERE lang IS NOT NULL UNION ALL SELECT 'lang', 'value', lang, NULL FROM docs WHERE lang IS NOT NULL
  UNION ALL SELECT 'source', 'available', NULL, NULL FROM docs WHERE source IS NOT NULL
  UNION ALL SELECT 'n_chars', 'available', NULL, NULL FROM docs WHERE n_chars IS NOT NULL UNION ALL SELECT 'n_chars', 'range', NULL, n_chars FROM docs WHERE n_chars IS NOT NULL
  UNION ALL SELECT 'quality', 'available', NULL, NULL FROM docs WHERE quality IS NOT NULL UNION ALL SELECT 'quality', 'value', quality::VARCHAR, NULL FROM docs WHERE quality IS NOT NULL
  UNION ALL SELECT 'good', 'available', NULL, NULL FROM docs WHERE good IS NOT NULL UNION ALL SELECT 'good', 'value', good::VARCHAR, NULL FROM docs WHERE good IS NOT NULL)
SELECT field, kind, value, count(*) AS count, min(key) AS low, max(key) AS high FROM long GROUP BY ALL"""


@query(with_("docs", _all))
def facets_all(spark, d):
    return facets.all_facets(c.docs(spark, d), D)


@query(with_("items", "SELECT DISTINCT field, trim(value) AS value FROM (SELECT 'brand' AS field, brand AS value FROM items UNION ALL SELECT 'tags', unnest(tags) FROM items) WHERE trim(value) <> ''"))
def filter_options(spark, d):
    return facets.options(c.items(spark, d), ["brand", "tags"])


@query(with_("pg", """SELECT filename, CASE WHEN count(DISTINCT page_number) = 0 THEN count(*) ELSE count(DISTINCT page_number) END AS pages,
  arg_min_null(doctype, row_idx) AS doctype, arg_min_null(lawnumber, row_idx) AS lawnumber, arg_min_null(date, row_idx) AS date FROM pg GROUP BY filename"""))
def document_summary(spark, d):
    return facets.document_summary(c.pages(spark, d))


@query("SELECT count(*) AS rows, count(DISTINCT source) AS paths FROM documents")
def corpus_status(spark, d):
    return facets.corpus_status(c.table(spark, d, "documents"), "source")


# -- ingestion ----------------------------------------------------------------

RAW_FIELDS = [FieldDef("lang", FieldType.STRING, required=True), FieldDef("n_chars", FieldType.INT), FieldDef("share", FieldType.FLOAT), FieldDef("day", FieldType.DATE), FieldDef("tags", FieldType.LIST, FieldType.STRING)]


def raw_records(spark, d) -> DataFrame:
    """Documents as JSON records with faults by doc_id: see the cases in RAW_SQL."""
    n = F.col("doc_id")
    j = lambda x: F.to_json(F.struct(x.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(x.alias("x")))) - 6)
    key = F.when(n % 50 == 7, F.lit('" "')).when(n % 40 == 9, F.lit('"twin"')).otherwise(F.concat(F.lit('"d'), n.cast("string"), F.lit('"')))
    lang = F.when(n % 30 == 11, F.lit("")).when(n % 30 == 12, F.lit('"lang":5,')).otherwise(F.concat(F.lit('"lang":'), j(F.col("lang")), F.lit(",")))
    chars = F.when(n % 20 == 3, F.lit('"42"')).when(n % 20 == 4, F.lit("1.0")).otherwise(F.col("n_chars").cast("string"))
    share = F.when(n % 2 == 0, F.lit("2")).otherwise(F.lit("0.5"))
    day = F.when(n % 25 == 6, F.lit('"2024-02-30"')).when(n % 25 == 8, F.lit('"2024-2-3"')).otherwise(F.lit('"2024-02-29"'))
    tags = F.when(n % 35 == 13, F.lit('["a",1]')).when(n % 35 == 14, F.lit('"a"')).otherwise(F.concat(F.lit('["a",null,'), j(F.col("source")), F.lit("]")))
    extra = F.when(n % 45 == 2, F.lit(',"odd":1')).otherwise(F.lit(""))
    nested = F.when(n % 55 == 5, F.lit(',"deep":{"x":1}')).otherwise(F.lit(',"note":7'))
    raw = F.concat(F.lit('{"id":'), key, F.lit(',"text":'), j(F.col("text")), extra, F.lit(',"metadata":{'), lang, F.lit('"n_chars":'), chars, F.lit(',"share":'), share, F.lit(',"day":'), day, F.lit(',"tags":'), tags, nested, F.lit("}}"))
    return c.table(spark, d, "documents").select(n.alias("ordinal"), F.when(n % 60 == 1, F.lit("not json")).otherwise(raw).alias("raw"))


_raw = """WITH f AS (SELECT doc_id AS n, *, doc_id % 60 = 1 AS w_json, doc_id % 50 = 7 AS w_id, doc_id % 45 = 2 AS w_extra, doc_id % 55 = 5 AS w_nest FROM documents),
g AS (SELECT *, w_json OR w_id OR w_extra OR w_nest AS wire, CASE WHEN n % 50 = 7 THEN ' ' WHEN n % 40 = 9 THEN 'twin' ELSE 'd' || n END AS id FROM f),
h AS (SELECT *, NOT wire AND (n % 30 IN (11, 12) OR n % 20 IN (3, 4) OR n % 25 IN (6, 8) OR n % 35 IN (13, 14)) AS typing, NOT wire AND count(*) FILTER (WHERE NOT wire) OVER (PARTITION BY id) > 1 AS dup FROM g)
"""


@query(_raw + "SELECT id, sha256(text) AS text_sha256, lang, n_chars, CASE WHEN n % 2 = 0 THEN 2 ELSE 0.5 END::DOUBLE AS share, DATE '2024-02-29' AS day, 'a|' || source AS tags, '7' AS note FROM h WHERE NOT wire AND NOT typing AND NOT dup")
def ingest_typed(spark, d):
    out = ingest.ingest(raw_records(spark, d), RAW_FIELDS).documents
    return out.select("id", text.digest("text").alias("text_sha256"), "lang", "n_chars", "share", "day", F.array_join("tags", "|").alias("tags"), F.col("extras")["note"].alias("note"))


def errors_of(spark, d, stage: str) -> DataFrame:
    return ingest.ingest(raw_records(spark, d), RAW_FIELDS).errors.where(F.col("stage") == stage).select("ordinal", "label", "field")


@query(_raw + """SELECT n AS ordinal, CASE WHEN w_json OR w_id THEN '<record at index ' || n || '>' ELSE id END AS label, field FROM (
  SELECT *, 'record' AS field FROM h WHERE w_json UNION ALL SELECT *, 'id' FROM h WHERE w_id AND NOT w_json UNION ALL SELECT *, 'odd' FROM h WHERE w_extra AND NOT w_json UNION ALL SELECT *, 'metadata' FROM h WHERE w_nest AND NOT w_json)""")
def ingest_wire_errors(spark, d):
    return errors_of(spark, d, "wire_format")


@query(_raw + """SELECT n AS ordinal, id AS label, field FROM (SELECT *, 'lang' AS field FROM h WHERE n % 30 IN (11, 12) UNION ALL SELECT *, 'n_chars' FROM h WHERE n % 20 IN (3, 4) UNION ALL SELECT *, 'day' FROM h WHERE n % 25 IN (6, 8)
  UNION ALL SELECT *, 'tags[1]' FROM h WHERE n % 35 = 13 UNION ALL SELECT *, 'tags' FROM h WHERE n % 35 = 14) WHERE NOT wire""")
def ingest_typing_errors(spark, d):
    return errors_of(spark, d, "metadata_typing")


@query(_raw + "SELECT DISTINCT id FROM h WHERE dup")
def ingest_duplicates(spark, d):
    return ingest.ingest(raw_records(spark, d), RAW_FIELDS).duplicate_ids


@query(_raw + "SELECT count(*) AS records, count(*) FILTER (WHERE NOT wire AND NOT typing AND NOT dup) AS valid, count(*) FILTER (WHERE wire) AS wire_failed, count(*) FILTER (WHERE typing) AS typing_failed, count(DISTINCT id) FILTER (WHERE dup) AS duplicate_ids FROM h")
def ingest_summary(spark, d):
    return ingest.ingest(raw_records(spark, d), RAW_FIELDS).summary()


@query(with_("docs vecs", "SELECT docs.id, len(v)::INT AS dim, CASE WHEN v IS NULL THEN NULL ELSE 'm' END AS model_id FROM docs LEFT JOIN vecs USING (id)"))
def embedding_attach(spark, d):
    return ingest.attach_embeddings(c.docs(spark, d), c.vectors(spark, d)).select("id", F.when(F.col("vector").isNotNull(), F.size("vector")).alias("dim"), "model_id")


@query(_raw + "SELECT vec_id::VARCHAR AS id FROM embeddings WHERE vec_id::VARCHAR NOT IN (SELECT n::VARCHAR FROM h WHERE NOT wire AND NOT typing AND NOT dup)")
def unmatched_embeddings(spark, d):
    good = ingest.ingest(raw_records(spark, d), RAW_FIELDS).documents.select(F.col("ordinal").cast("string").alias("id"))
    return ingest.unmatched_embeddings(good, c.vectors(spark, d))


@query(with_("docs vecs", "SELECT docs.id, len(v)::INT AS dim FROM docs JOIN vecs USING (id) WHERE docs.doc_id % 3 <> 0 AND docs.doc_id % 7 <> 0"))
def embedding_cache_hit(spark, d):
    docs = c.docs(spark, d)
    stale = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    cache = docs.join(c.vectors(spark, d), "id").select("id", text.digest(stale).alias("text_sha256"), F.when(F.col("doc_id") % 7 == 0, "old").otherwise("m").alias("model_id"), "vector")
    return vector_cache.cache_hits(docs, cache, "m").select("id", F.size("vector").alias("dim"))


@query("""WITH f AS (SELECT doc_id, source || '/' || doc_id || '.pdf' AS path_rel, doc_id || '.pdf' AS filename, lang, 'none' AS kind FROM documents)
SELECT path_rel, CASE WHEN doc_id % 3 = 0 THEN 'xx' WHEN doc_id % 3 <> 0 AND doc_id % 2 = 0 THEN coalesce(NULL, lang) ELSE lang END AS lang,
  CASE WHEN doc_id % 3 = 0 THEN 'by path' WHEN doc_id % 2 = 0 THEN 'by name' ELSE 'none' END AS kind FROM f""")
def sidecar_override(spark, d):
    n = F.col("doc_id")
    rel, name = F.concat_ws("/", "source", F.concat(n.cast("string"), F.lit(".pdf"))), F.concat(n.cast("string"), F.lit(".pdf"))
    docs = c.table(spark, d, "documents")
    files = docs.select(rel.alias("path_rel"), name.alias("filename"), "lang", F.lit("none").alias("kind"))
    by_path = docs.where(n % 3 == 0).select(rel.alias("key"), F.lit("xx").alias("lang"), F.lit("by path").alias("kind"))
    by_name = docs.where(n % 2 == 0).select(name.alias("key"), F.lit(None).cast("string").alias("lang"), F.lit("by name").alias("kind"))
    return readers.with_sidecar(files, by_path.unionByName(by_name), ["lang", "kind"]).select("path_rel", "lang", "kind")


@query("""SELECT o_orderkey::VARCHAR AS id, concat_ws(chr(10), c_name, n_name, r_name) AS text, o_orderdate::DATE AS day, coalesce(flags, '') AS flags FROM orders
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def normalized_join(spark, d):
    t = lambda n: c.table(spark, d, n)
    main = t("orders").withColumnsRenamed({"o_custkey": "c_custkey", "o_orderkey": "l_orderkey"})
    parents = [(t("customer").withColumnRenamed("c_nationkey", "n_nationkey"), "c_custkey"), (t("nation").withColumnRenamed("n_regionkey", "r_regionkey"), "n_nationkey"), (t("region"), "r_regionkey")]
    out = readers.relational(main, parents, (t("lineitem"), "l_orderkey", "l_returnflag", "flags"), ["c_name", "n_name", "r_name"], [F.col("o_orderdate").desc(), "l_orderkey"])
    return out.select(F.col("l_orderkey").cast("string").alias("id"), "text", F.to_date("o_orderdate").alias("day"), F.array_join("flags", "|").alias("flags"))


@query(with_("pg", "SELECT row_idx, '1. Topic ' || (row_idx % 3) || '|Lang ' || lower(doctype) AS items FROM pg"))
def split_list_field(spark, d):
    return c.pages(spark, d).select("row_idx", F.array_join(text.split_list("subjects"), "|").alias("items"))


@query(with_("pg", "SELECT row_idx, try_cast(page_number AS INT) AS page, try_cast(date AS TIMESTAMP) AS at FROM pg"))
def typed_page_fields(spark, d):
    return c.pages(spark, d).select("row_idx", text.page_number("page_number").alias("page"), text.lenient_timestamp("date").cast("timestamp_ntz").alias("at"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source || '/' || doc_id || '.pdf' ELSE doc_id || '.pdf' END AS path FROM documents")
def choose_path(spark, d):
    n = F.col("doc_id").cast("string")
    path = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\\"), "source", F.lit("\\"), n, F.lit(".pdf"))).otherwise(F.lit("  "))
    return c.table(spark, d, "documents").select("doc_id", text.relative_path(path, F.concat(n, F.lit(".pdf"))).alias("path"))


# -- spans, text, windows -----------------------------------------------------

_span = "array(named_struct('start', cast(n_chars as int), 'end', 5), named_struct('start', 3, 'end', 10), named_struct('start', -4, 'end', cast(doc_id % 7 as int)), named_struct('start', 12, 'end', 14))"
# independent of the fold: covered positions of a short range, joined where they touch
_span_sql = """WITH r AS (SELECT doc_id, n_chars AS len, unnest([{'a': least(n_chars, 5), 'b': greatest(n_chars, 5)}, {'a': 3, 'b': 10}, {'a': -4, 'b': doc_id % 7}, {'a': 12, 'b': 14}]) AS x FROM documents),
k AS (SELECT doc_id, least(greatest(x.a, 0), len) AS a, least(greatest(x.b, 0), len) AS b FROM r),
m AS (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM k WHERE b > a),
g AS (SELECT *, sum(CASE WHEN far IS NULL OR a > far + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS grp FROM m),
t AS (SELECT doc_id, grp, min(a) || '-' || max(b) AS s FROM g GROUP BY doc_id, grp) """


@query(_span_sql.replace("{gap}", "0") + "SELECT d.doc_id, coalesce(string_agg(s, '|' ORDER BY grp), '') AS ranges FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id GROUP BY d.doc_id")
def sanitize_ranges(spark, d):
    return c.table(spark, d, "documents").select("doc_id", spans.ranges_text(spans.sanitize_ranges(F.expr(_span), F.col("n_chars").cast("int"))).alias("ranges"))


_gap_sql = _span_sql.replace("{gap}", "2").replace("least(greatest(x.a, 0), len) AS a, least(greatest(x.b, 0), len) AS b", "x.a AS a, x.b AS b").replace("WHERE b > a", "").replace("{'a': least(n_chars, 5), 'b': greatest(n_chars, 5)}", "{'a': 20, 'b': 20 + n_chars}")


@query(_gap_sql + "SELECT d.doc_id, coalesce(string_agg(s, '|' ORDER BY grp), '') AS ranges FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id GROUP BY d.doc_id")
def merge_ranges_gap(spark, d):
    ranges = _span.replace("'start', cast(n_chars as int), 'end', 5", "'start', 20, 'end', cast(20 + n_chars as int)")
    return c.table(spark, d, "documents").select("doc_id", spans.ranges_text(spans.merge_ranges(F.expr(ranges))).alias("ranges"))


@query(with_("pieces q ch", """, g AS (SELECT *, row_number() OVER (PARTITION BY page_index ORDER BY start_) - start_ // 400 AS run FROM ch WHERE score >= 0.1),
  t AS (SELECT page_index, run, min(start_) || '-' || max(end_) AS s, min(start_) AS a FROM g WHERE end_ > start_ GROUP BY page_index, run)
  SELECT g.page_index, round(max(score), 6) AS score, (SELECT string_agg(s, '|' ORDER BY a) FROM t WHERE t.page_index = g.page_index) AS ranges, count(*)::INT AS chunks FROM g GROUP BY g.page_index"""))
def chunks_to_pages(spark, d):
    hits = composite.chunk_search(c.chunks(spark, d), c.query_vector(spark, d), threshold=0.1)
    pages = c.table(spark, d, "documents").select(F.col("doc_id").alias("page_index"), "text")
    return facets.chunks_to_pages(hits, pages).select("page_index", six(), F.nullif(spans.ranges_text("ranges"), F.lit("")).alias("ranges"), F.size("chunk_ids").alias("chunks"))


@query(with_("pieces q ch", "SELECT chunk_id, page_index, round(score, 6) AS score FROM ch WHERE page_index % 3 = 0 ORDER BY round(score, 9) DESC, chunk_id LIMIT 50"))
def chunk_subset_topk(spark, d):
    scope = c.table(spark, d, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("page_index"))
    return composite.chunk_search(c.chunks(spark, d), c.query_vector(spark, d), scope, 50).select("chunk_id", "page_index", six())


@query("""SELECT event_id, last_value(CASE WHEN event_id % 3 = 0 THEN event_type END IGNORE NULLS) OVER w AS kind, last_value(CASE WHEN event_id % 4 = 0 THEN value END IGNORE NULLS) OVER w AS amount
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def carry_forward(spark, d):
    return ingest.carry_forward(c.visits(spark, d), ["kind", "amount"], "file", ["ts", "event_id"]).select("event_id", "kind", "amount")


_ar = r"trim(regexp_replace(regexp_replace(replace(replace(lower(translate(regexp_replace(trim(%s, ' ' || chr(9) || chr(10) || chr(13)), '[\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}\x{0640}]', '', 'g'), 'إأآىة٠١٢٣٤٥٦٧٨٩', 'ااايه0123456789')), 'ß', 'ss'), 'ς', 'σ'), '[^0-9\x{0600}-\x{06FF}a-zA-Z\s\-/\._:]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, sha256({_ar % 'text'}) AS norm FROM documents")
def arabic_normalize(spark, d):
    return c.table(spark, d, "documents").select("doc_id", text.digest(text.normalize_arabic("text")).alias("norm"))


@query(r"SELECT p_partkey, coalesce(nullif(substr(trim(regexp_replace(regexp_replace(trim(p_name || ' / ' || p_type), '[^\p{L}\p{N}_\s\-]+', '', 'g'), '\s+', '_', 'g'), '_'), 1, 80), ''), 'export') AS part FROM part")
def safe_filename(spark, d):
    return c.table(spark, d, "part").select("p_partkey", text.safe_filename_part(F.concat("p_name", F.lit(" / "), "p_type")).alias("part"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def text_digest(spark, d):
    return c.table(spark, d, "documents").select("doc_id", text.digest("text").alias("digest"))


@query("SELECT doc_id, CASE WHEN doc_id % 1200 < 1000 THEN source ELSE (doc_id % 1200) || ' - ' || source END AS topic FROM documents")
def strip_topic_number(spark, d):
    return c.table(spark, d, "documents").select("doc_id", text.strip_leading_number(F.concat(F.lit("  "), (F.col("doc_id") % 1200).cast("string"), F.lit(" - "), "source")).alias("topic"))


# a line opens a paragraph by what it is and what stands before it; behind an empty line, by what opened that one
_broken = r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
b AS (SELECT *, lag(line) OVER w AS before FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
o AS (SELECT *, coalesce(before IS NULL OR starts_with(line, '=== Page') OR starts_with(before, '=== Page') OR regexp_matches(before, '[.:]\s*$'), false) AS base FROM b),
e AS (SELECT *, max(CASE WHEN before IS DISTINCT FROM '' THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM o),
p AS (SELECT *, bool_or(base) OVER (PARTITION BY doc_id, run ORDER BY i ROWS UNBOUNDED PRECEDING) AS opens FROM e),
g AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS par FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, par ORDER BY i) AS k, count(*) OVER (PARTITION BY doc_id, par) AS m FROM g),
t AS (SELECT doc_id, par, any_value(CASE WHEN k = 1 AND starts_with(before, '=== Page') AND trim(line, ' ') = '' THEN chr(10) ELSE '' END ORDER BY i) AS gap,
  coalesce(any_value(regexp_replace(line, '\s+$', '')) FILTER (WHERE k = 1 AND m > 1), '') || coalesce(string_agg(' ' || regexp_replace(line, '^\s+|\s+$', '', 'g'), '' ORDER BY i) FILTER (WHERE k > 1 AND k < m AND regexp_matches(line, '\S')), '')
  || CASE WHEN any_value(m) > 1 THEN ' ' ELSE '' END || any_value(CASE WHEN m = 1 THEN line ELSE regexp_replace(line, '^\s+', '') END) FILTER (WHERE k = m) AS body FROM n GROUP BY doc_id, par)
SELECT d.doc_id, sha256(j) AS joined FROM documents d LEFT JOIN (SELECT doc_id, string_agg(gap || body, chr(10) ORDER BY par) AS j FROM t GROUP BY doc_id) x ON x.doc_id = d.doc_id"""


@query(_broken)
def join_broken_lines(spark, d):
    return c.table(spark, d, "documents").select("doc_id", text.digest(text.join_broken_lines("text")).alias("joined"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'بت ' || source WHEN 1 THEN 'كتاب' ELSE source || ' ' || source END AS plain FROM documents""")
def undiacritize(spark, d):
    marked = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" ب\u064Eت\u0640\u0640 \u00A0"), "source")).when(F.col("doc_id") % 3 == 1, F.lit("ك\u0650ت\u0652\u0627ب\u064B\t")).otherwise(F.concat("source", F.lit("\u2003\n"), "source"))
    return c.table(spark, d, "documents").select("doc_id", text.undiacritize(marked).alias("plain"))


@query("SELECT vec_id AS row, label, len(embedding)::INT AS dim FROM embeddings")
def chunk_vectors(spark, d):
    e = c.table(spark, d, "embeddings")
    out = composite.with_vectors(e.select(F.col("vec_id").alias("row"), "label"), e.select(F.col("vec_id").alias("row"), F.col("embedding").alias("vector")))
    return out.select("row", "label", F.size("vector").alias("dim"))


@query()
def extract_metadata(spark, d):
    pages = c.table(spark, d, "documents").select("doc_id", F.concat(F.lit("BO_"), F.floor(F.col("doc_id") / 12).cast("string"), F.lit(".pdf")).alias("source_file"), F.col("doc_id").alias("source_page"), "text")
    return enriched(pages).drop("text")


GAZETTE_PAGE = """concat('الجريدة الرسمية عدد ', 1000 + doc_id % 900, ' مكرر ', 1 + doc_id % 28, if(doc_id % 2 = 0, ' يونيو ', ' (غشت) '), 2000 + doc_id % 25, chr(10), element_at(array('ظهير', 'مرسوم', 'قرار رقم', 'قانون رقم', 'بلاغ'), cast(doc_id % 5 + 1 as int)),
  ' رقم 2.', 10 + doc_id % 90, '.', 100 + doc_id % 800, ' يتعلق بموضوع ', element_at(array('الصحة', 'التعليم والصحة', 'شيء'), cast(doc_id % 3 + 1 as int)), chr(10), 'حرر بالرباط في ', 1 + doc_id % 27, ' دجنبر ', 1990 + doc_id % 30, chr(10), if(doc_id % 4 = 0, 'الإمضاء: فلان', if(doc_id % 4 = 1, 'رئيس الحكومة', 'نص')))"""


@query("""SELECT doc_id, (1000 + doc_id % 900) || CASE WHEN doc_id % 2 = 0 THEN '-bis' ELSE '' END AS issue_number, make_date(2000 + doc_id % 25, CASE WHEN doc_id % 2 = 0 THEN 6 ELSE 8 END, 1 + doc_id % 28) AS publication_date,
  make_date(1990 + doc_id % 30, 12, 1 + doc_id % 27) AS promulgation_date, ['dahir', 'decret', 'arrete', 'loi', 'bulletin_officiel'][(doc_id % 5 + 1)::INT] AS document_type, '2.' || (10 + doc_id % 90) || '.' || (100 + doc_id % 800) AS law_number,
  CASE doc_id % 4 WHEN 0 THEN 'فلان' WHEN 1 THEN 'رئيس الحكومة' END AS signatures, CASE doc_id % 3 WHEN 0 THEN 'public_health' WHEN 1 THEN 'public_health|education' END AS subjects,
  ['ظهير', 'مرسوم', 'قرار رقم', 'قانون رقم', 'بلاغ'][(doc_id % 5 + 1)::INT] || ' رقم 2.' || (10 + doc_id % 90) || '.' || (100 + doc_id % 800) || ' يتعلق بموضوع ' || ['الصحة', 'التعليم والصحة', 'شيء'][(doc_id % 3 + 1)::INT] AS title FROM documents""")
def extract_fields(spark, d):
    """The extractor on pages in the form of a gazette's, made from doc_id."""
    name = F.concat(F.lit("BO_"), (1000 + F.col("doc_id") % 900).cast("string"), F.when(F.col("doc_id") % 2 == 0, F.lit("-bis")).otherwise(F.lit("")), F.lit("_Ar.pdf"))
    pages = c.table(spark, d, "documents").select("doc_id", name.alias("source_file"), F.expr(GAZETTE_PAGE).alias("text"))
    out = extract_pages(pages).select("doc_id", "found.*")
    return out.withColumn("subjects", F.array_join("subjects", "|")).drop("mandatory_keywords")


# -- page corpus --------------------------------------------------------------


def page_filter(name: str, request: dict, where: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return composite.valid_pages(composite.prepare(c.pages(spark, d)), request).select("row_idx")

    run.__name__ = name
    query(with_("pg", f"SELECT row_idx FROM pg WHERE {where}"))(run)


page_filter("legacy_exact_or", {"filename": ["SRC1.pdf", " src2.PDF "], "doctype": ["en", "fr"]}, "filename IN ('src1.pdf', 'src2.pdf') AND doctype IN ('EN', 'FR')")
page_filter("legacy_mandatory_all", {"keywords": ["The", "ING"]}, f"contains({_ar % 'text'}, 'the') AND contains({_ar % 'text'}, 'ing')")
page_filter("legacy_subject_overlap", {"subjects": ["topic 1", "lang DE"]}, "row_idx % 3 = 1 OR doctype = 'DE'")
page_filter("legacy_date_range", {"date_from": "2020-03-01", "date_to": "2021-06-30"}, "date >= '2020-03-01' AND date <= '2021-06-30'")


@query(with_("pg", f"SELECT row_idx FROM pg WHERE contains({_ar % 'text'}, 'tion th') OR contains({_ar % 'text'}, 'ung')"))
def legacy_substring_or(spark, d):
    return composite.substring_or(composite.prepare(c.pages(spark, d)), composite.parse_queries("Tion  TH\nung\nung", False)).select("row_idx")


@query(with_("pg", """SELECT filename, arg_min_null(doctype, row_idx) AS doctype, arg_min_null(lawnumber, row_idx) AS lawnumber, arg_min_null(date, row_idx) AS date, count(*) AS pages,
  sha256(string_agg(text, chr(10) || chr(10) ORDER BY page_number::INT, row_idx)) AS body FROM pg WHERE doctype = 'FR' GROUP BY filename"""))
def export_grouped(spark, d):
    out = composite.export_text(c.pages(spark, d).where(F.col("doctype") == "FR"))
    return out.select("filename", "doctype", "lawnumber", "date", "pages", text.digest("body").alias("body"))


@query(with_("pg", "SELECT row_idx, filename, CASE WHEN filename = 'src3.pdf' THEN 'NEW' ELSE doctype END AS doctype, lawnumber FROM pg"))
def metadata_update(spark, d):
    return composite.with_metadata(c.pages(spark, d), "src3.pdf", {"doctype": "NEW"}).select("row_idx", "filename", "doctype", "lawnumber")


@query(with_("vecs", "SELECT id, round(sqrt(list_inner_product(v, v)), 6) AS norm FROM vecs"))
def vector_norms(spark, d):
    return c.vectors(spark, d).select("id", F.round(norm("vector"), 6).alias("norm"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'n' || doc_id ELSE source END AS source FROM documents""")
def upsert(spark, d):
    from siltstone.sources.writers import upserted

    old = c.table(spark, d, "documents").select("doc_id", "source")
    new = old.where("doc_id % 2 = 0").select("doc_id", F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("source"))
    return upserted(old, new, "doc_id")


@query(with_("vecs", "SELECT id, 'v2' AS model_id FROM vecs WHERE id::BIGINT % 2 = 0 UNION ALL SELECT id, 'v1' FROM vecs WHERE id::BIGINT % 2 <> 0"))
def store_last_wins(spark, d):
    v = c.vectors(spark, d)
    first = v.withColumns({"model_id": F.lit("v1"), "ordinal": F.lit(0)})
    second = v.where(F.col("id").cast("long") % 2 == 0).withColumns({"model_id": F.lit("v2"), "ordinal": F.lit(1)})
    return ingest.last_wins(first.unionByName(second)).select("id", "model_id")
