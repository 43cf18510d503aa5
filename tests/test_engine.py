import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from siltstone.operators import filters as flt
from siltstone.operators import ranking, semantic
from siltstone.operators.fields import BadConfig, BadQuery, FieldDef, FieldType, coerce, schema_of
from siltstone.operators.filters import FoldedEquality, apply_filters, build_filters
from siltstone.operators.fuzzy import FuzzyContains, best_ratio, fuzzy_titles, plain
from siltstone.operators.lexical import And, LexicalQuery, Or, Term, lexical_hits
from siltstone.plans.config import parse
from siltstone.plans.engine import Request, SearchEngine
from siltstone.plans.handlers import Handlers

S = FieldType
SHAPES = [("item-1", "red circle", [1.0, 0.0]), ("item-2", "red circle big", [0.8, 0.6]), ("item-3", "red square", [0.6, 0.8]), ("item-4", "green triangle", [0.0, 1.0]), ("item-5", "blue triangle circle", [-1.0, 0.0])]
GADGETS = [
    ("gadget-1", "wireless office mouse", "Peripherals", True, 4.5, ["office", "Wireless"], [1.0, 0.0]),
    ("gadget-2", "mechanical keyboard", "Peripherals", False, 4.0, ["office"], [0.0, 1.0]),
    ("gadget-3", "usb cable", "Cables", True, 3.0, None, [0.6, 0.8]),
    ("gadget-4", "webcam for calls", "peripherals", True, None, ["video"], [0.5, 0.5]),
]
GADGET_FIELDS = [FieldDef("category", S.STRING, required=True), FieldDef("in_stock", S.BOOL), FieldDef("rating", S.FLOAT), FieldDef("tags", S.LIST, S.STRING)]
CONFIG = {
    "schema_version": 1,
    "filters": {
        "category": {"type": "string", "required": True, "operation": "equality"},
        "in_stock": {"type": "bool", "operation": "equality"},
        "rating": {"type": "float", "operation": "range", "default": {"min": 1, "max": 5}},
        "tags": {"type": "list", "item_type": "string", "operation": "contains"},
    },
    "search": {"ranking": {"weights": {"semantic": 0.5, "lexical": 0.5}}, "pagination": {"default_page_size": 2, "max_page_size": 3}},
    "frontend": {"branding": {"title": "Gadgets"}, "filters": {"category": {"label": "Category", "order": 1}, "rating": {"label": "Rating", "order": 2}, "tags": {"label": "Tags", "order": 3}}},
}


@pytest.fixture(scope="module")
def shapes(spark):
    return spark.createDataFrame(SHAPES, "id string, text string, vector array<double>").cache()


@pytest.fixture(scope="module")
def engine(spark):
    rows = spark.createDataFrame(GADGETS, "id string, text string, category string, in_stock boolean, rating double, tags array<string>, vector array<double>")
    vectors = rows.select("id", "vector", F.lit("m").alias("model_id"))
    return SearchEngine(parse(CONFIG), rows.drop("vector"), vectors, overrides={"category": FoldedEquality})


def ids(df):
    return [r.id for r in df.collect()]


def test_cosine_top_k(shapes):
    out = [(r.id, round(r.score, 9)) for r in semantic.nearest(shapes, [1.0, 0.0], 5).collect()]
    assert out == [("item-1", 1.0), ("item-2", 0.8), ("item-3", 0.6), ("item-4", 0.0), ("item-5", -1.0)]


def test_cosine_of_zero_vector_is_zero_and_unequal_sizes_fail(spark):
    df = spark.createDataFrame([("a", [0.0, 0.0]), ("b", None)], "id string, vector array<double>")
    assert [(r.id, r.score) for r in semantic.scored(df, [1.0, 0.0]).collect()] == [("a", 0.0)]
    with pytest.raises(Exception, match="dimensions"):
        semantic.scored(df, [1.0]).collect()


@pytest.mark.parametrize(
    "query, found",
    [
        (LexicalQuery(("red", "BLUE")), [1, 2, 3, 5]),
        (LexicalQuery((), ("circle",)), [1, 2, 5]),
        (LexicalQuery((), (("red", "circle"), ("blue", "triangle"))), [1, 2, 5]),
        (LexicalQuery(("big", "blue"), ("circle",)), [2, 5]),
        (LexicalQuery(), [1, 2, 3, 4, 5]),
        (LexicalQuery(("RED",), (), True), []),
    ],
)
def test_text_rules(shapes, query, found):
    assert sorted(ids(lexical_hits(shapes, query))) == [f"item-{n}" for n in found]


def test_rules_that_are_no_rules():
    for make in (lambda: Term(" "), lambda: And(()), lambda: Or(()), lambda: LexicalQuery((), ("a", ("b",))).rule(), lambda: LexicalQuery((), ((),)).rule()):
        with pytest.raises(BadQuery):
            make()


def test_folding_reaches_sharp_s(spark):
    df = spark.createDataFrame([("a", "Die Straße"), ("b", "ΟΔΟΣ")], "id string, text string")
    assert ids(lexical_hits(df, LexicalQuery(("STRASSE",)))) == ["a"]
    assert ids(lexical_hits(df, LexicalQuery(("οδος",)))) == ["b"]


def test_merge_and_pages(shapes):
    hits = ranking.merged(semantic.scored(shapes, [1.0, 0.0]), lexical_hits(shapes, LexicalQuery(("red", "blue"))))
    first = ranking.page_of(hits, 1, 10).collect()
    assert [(r.id, round(r.score, 9)) for r in first] == [("item-1", 1.0), ("item-2", 0.9), ("item-3", 0.8), ("item-4", 0.0), ("item-5", 0.0)]
    assert [ids(ranking.page_of(hits, p, 2)) for p in (1, 3, 4)] == [["item-1", "item-2"], ["item-5"], []]
    assert ids(ranking.clamped_page(hits, 9, 2)) == ["item-5"]
    info = ranking.page_info(hits, 3, 2).first()
    assert (info.total_hits, info.total_pages, info.has_previous, info.has_next) == (5, 3, True, False)
    with pytest.raises(BadQuery):
        ranking.page_of(hits, 0, 2)
    with pytest.raises(BadConfig):
        ranking.merged(hits, None, (0, 0))


def test_several_queries(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.7, 0.7])], "id string, vector array<double>")
    q = [semantic.VectorQuery((1.0, 0.0)), semantic.VectorQuery((0.0, 1.0))]
    best = {r.id: round(r.score, 6) for r in semantic.multi_search(df, q).collect()}
    assert best["a"] == best["b"] == 1.0
    mean = {r.id: round(r.score, 6) for r in semantic.multi_search(df, q, "weighted_average").collect()}
    assert mean["a"] == mean["b"] == 0.5
    heavy = semantic.multi_search(df, [semantic.VectorQuery((1.0, 0.0), 3.0), q[1]], "weighted_average", top_k=1)
    assert ids(heavy) == ["a"]
    assert sorted(ids(semantic.multi_search(df, q, pool=1))) == ["a", "b"]
    with pytest.raises(BadQuery):
        semantic.multi_search(df, [semantic.VectorQuery((1.0, 0.0), 0.0)], "weighted_average")
    with pytest.raises(BadQuery):
        semantic.combination("none")


def test_any_vector_store_will_do(spark):
    """The engine asks a store for scores; what stands behind it is its own affair."""

    class Fixed:
        def scores(self, queries, scope=None):
            found = spark.createDataFrame([(n, f"item-{k}", 1.0 / k) for n in range(len(queries)) for k in (1, 2, 3)], "query int, id string, score double")
            return found if scope is None else found.join(scope.select("id"), "id", "left_semi")

    hits = semantic.multi_search(Fixed(), [semantic.VectorQuery((1.0,)), semantic.VectorQuery((0.0,))], top_k=2)
    assert [(r.id, r.score) for r in hits.collect()] == [("item-1", 1.0), ("item-2", 0.5)]
    docs = spark.createDataFrame([("item-2", "x"), ("item-3", "y")], "id string, text string")
    from siltstone.plans.config import Config

    engine = SearchEngine(Config({}), docs, Fixed())
    assert sorted(r.id for r in engine.hits(Request((semantic.VectorQuery((1.0,)),))).collect()) == ["item-2", "item-3"]


def test_auto_tune_walk():
    tune = semantic.AutoTune()
    grid = tune.grid()
    assert len(grid) == 151
    counts = {round(t, 6): 10 if t < 0.75 else 3 for t in grid}
    assert tune.walk(counts) == pytest.approx(0.748)
    assert tune.walk({round(t, 6): 0 for t in grid}) == 0.8


def test_scaling(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 5.0)], "id string, score double")
    assert [r.scaled for r in semantic.scale_minmax(df).orderBy("id").collect()] == [0.0, 0.5, 1.0]
    assert [r.scaled for r in semantic.rank_percentile(df).orderBy("id").collect()] == [0.0, 0.5, 1.0]
    assert [r.scaled for r in semantic.rank_percentile(df.where("id = 'a'")).collect()] == [1.0] and semantic.rank_percentile(df.where("false")).count() == 0
    many = spark.createDataFrame([(f"k{i:03}", float(i * 7 % 50) / 10) for i in range(300)], "id string, score double")
    order = sorted(many.collect(), key=lambda r: (-r.score, r.id))
    for ranges in (2, 5, 256):
        got = {r.id: r.scaled for r in semantic.rank_percentile(many, ranges).collect()}
        assert got == {r.id: pytest.approx(1 - n / 299) for n, r in enumerate(order)}
    same = df.withColumn("score", F.lit(2.0))
    assert {r.scaled for r in semantic.scale_minmax(same).collect()} == {1.0}
    assert {r.scaled for r in semantic.scale_zsigmoid(same).collect()} == {1.0}
    assert semantic.score_quantile(df, 0.25).first()[0] == 2.0
    assert semantic.score_quantile(df.where("false"), 0.25).first()[0] == 0.0


ROWS = [("a", "Ab", 1, 1.5, dt.date(2020, 1, 1), True, ["X", "y"]), ("b", "straße", 5, float("nan"), dt.date(2020, 6, 1), False, []), ("c", None, None, None, None, None, None)]
FIELDS = {
    "t": (FieldDef("t", S.STRING), "contains"), "n": (FieldDef("n", S.INT), "range"), "f": (FieldDef("f", S.FLOAT), "range"), "d": (FieldDef("d", S.DATE), "range"), "b": (FieldDef("b", S.BOOL), "equality"), "l": (FieldDef("l", S.LIST, S.STRING), "contains"),
}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id string, t string, n long, f double, d date, b boolean, l array<string>").cache()


@pytest.mark.parametrize(
    "request_, found",
    [
        ({}, "abc"), ({"t": None, "n": {}, "l": []}, "abc"), ({"t": "AB"}, "a"), ({"t": ""}, "ab"), ({"t": ["zz", "tra"]}, "b"), ({"n": {"min": 1}}, "ab"), ({"n": {"min": 1, "min_inclusive": False}}, "b"),
        ({"n": {"max": 5, "max_inclusive": False}}, "a"), ({"f": {"max": 2}}, "ab"), ({"d": {"min": "2020-02-01", "max": "2020-06-01"}}, "b"), ({"d": {"min": dt.date(2020, 1, 1)}}, "ab"), ({"b": True}, "a"),
        ({"b": [True, None]}, "ac"), ({"b": [None]}, "c"), ({"l": "x"}, "a"), ({"l": ["q", "Y"]}, "a"), ({"t": "a", "n": {"max": 1}}, "a"),
    ],
)
def test_filters(rows, request_, found):
    assert "".join(sorted(ids(apply_filters(rows, build_filters(FIELDS), request_)))) == found


@pytest.mark.parametrize("request_", [{"zz": 1}, {"n": {"min": 5, "max": 1}}, {"n": {"min": "5"}}, {"n": {"min": True}}, {"b": 1}, {"l": [None]}, {"n": 5}, {"d": {"min": "2020-2-3"}}, {"d": {"min": "2020-02-30"}}])
def test_bad_filters(rows, request_):
    with pytest.raises(BadQuery):
        apply_filters(rows, build_filters(FIELDS), request_)


def test_filter_reaches_the_scan(spark, tmp_path, rows):
    rows.write.parquet(str(tmp_path / "t"))
    df = apply_filters(spark.read.parquet(str(tmp_path / "t")), build_filters(FIELDS), {"n": {"min": 2}, "b": [False]}).select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(n,2)" in plan and "Not(EqualTo(b,true))" in plan and "ReadSchema: struct<id:string,n:bigint,b:boolean>" in plan


def test_filter_registry_and_overrides():
    with pytest.raises(ValueError):
        flt.register_filter("range")(flt.Equality)
    with pytest.raises(ValueError):
        flt.register_filter("equality")(type("Other", (flt.Equality,), {}))
    with pytest.raises(BadConfig):
        flt.filter_class("near")
    with pytest.raises(BadConfig):
        build_filters(FIELDS, {"zz": FoldedEquality})
    with pytest.raises(BadConfig):
        build_filters(FIELDS, {"t": FoldedEquality})
    with pytest.raises(BadConfig):
        flt.Range(FieldDef("b", S.BOOL))


def test_coercion_is_strict():
    assert coerce(1, S.FLOAT) == 1.0 and coerce("2020-01-02", S.DATE) == dt.date(2020, 1, 2) and coerce(None, S.INT) is None
    for value, kind in ((True, S.INT), (1.0, S.INT), ("1", S.INT), (1, S.STRING), ("true", S.BOOL), (True, S.FLOAT)):
        with pytest.raises(BadQuery):
            coerce(value, kind)
    with pytest.raises(BadConfig):
        FieldDef("x", S.LIST)
    with pytest.raises(BadConfig):
        schema_of([FieldDef("x", S.INT), FieldDef("x", S.INT)])


def test_fuzzy_titles(spark):
    df = spark.createDataFrame([("book-1", "Kitāb al-Ṭabaqāt al-Kubrá"), ("book-2", "Other Book"), ("book-3", None)], "id string, title string")
    assert ids(fuzzy_titles(df, "title", ["Al-Tabaqat al-Kubra"])) == ["book-1"]
    assert ids(fuzzy_titles(df, "title", ["othr book"])) == ["book-2"]
    assert len(ids(fuzzy_titles(df, "title", []))) == 3
    assert best_ratio(plain("abc"), "") == 0.0
    assert best_ratio("ab", "abc") == pytest.approx(0.8)
    for t in (0, 1.1):
        with pytest.raises(BadConfig):
            FuzzyContains(FieldDef("title", S.STRING), t)


# -- engine and handlers ------------------------------------------------------


def test_search_with_filters_vectors_and_text(engine):
    r = Request.parse({"semantic": [{"vector": [1, 0]}], "lexical": {"first_of": ["wireless", "webcam"]}, "filters": {"category": "PERIPHERALS", "in_stock": True}})
    out = engine.search(r)
    assert ids(out.hits) == ["gadget-1", "gadget-4"] and out.info.total_hits == 2


def test_match_all_pages_are_disjoint(engine):
    pages = [engine.search(Request(lexical=LexicalQuery(), page=p)) for p in (1, 2, 3)]
    assert [len(ids(p.hits)) for p in pages] == [2, 2, 0] and pages[0].info.total_pages == 2
    assert not set(ids(pages[0].hits)) & set(ids(pages[1].hits))
    assert engine.search(Request(lexical=LexicalQuery(), page_size=50)).info.page_size == 3


def test_range_and_list_filters(engine):
    r = Request(lexical=LexicalQuery((), ("office",)), filters={"rating": {"min": 4}, "tags": "OFFICE"})
    assert ids(engine.search(r).hits) == ["gadget-1"]


def test_bad_requests(engine):
    for raw in ({}, {"filters": {"category": "x"}}, {"lexical": {}, "page": 0}, {"lexical": {}, "zz": 1}, {"semantic": [{"vector": []}]}, {"semantic": [{"vector": ["a"]}]}, [], {"semantic": [{"vector": [float("nan")]}]}):
        with pytest.raises((BadQuery, ValueError)):
            Request.parse(raw)
    with pytest.raises(BadQuery):
        engine.hits(Request(lexical=LexicalQuery(), filters={"zz": 1}))
    with pytest.raises(BadConfig):
        engine.hits(Request(semantic_text=("x",)))


def test_handlers(engine):
    h = Handlers(engine, resolver=lambda row: b"pdf" if row["id"] == "gadget-1" else None)
    assert h.dispatch("GET", "/health") == (200, {"status": "ok"})
    status, body = h.dispatch("POST", "/search", json.dumps({"lexical": {}}))
    assert status == 200 and body["total_hits"] == 4 and [x["id"] for x in body["hits"]] == ["gadget-1", "gadget-2"]
    assert h.dispatch("POST", "/search", "{")[0] == 400
    assert h.dispatch("POST", "/search", json.dumps({"lexical": {}, "filters": {"zz": 1}}))[0] == 400
    assert h.dispatch("GET", "/search")[0] == 405 and h.dispatch("GET", "/none")[0] == 404
    facets = h.dispatch("GET", "/facets")[1]["facets"]
    assert facets["rating"] == {"available_count": 3, "min": 3.0, "max": 4.5}
    assert facets["category"]["values"] == [{"value": "Cables", "count": 1}, {"value": "Peripherals", "count": 2}, {"value": "peripherals", "count": 1}]
    assert "in_stock" not in facets and facets["tags"]["available_count"] == 3
    assert h.dispatch("GET", "/documents/gadget-3")[1]["metadata"]["category"] == "Cables"
    assert h.dispatch("GET", "/documents/gadget-1/source") == (200, b"pdf")
    assert h.dispatch("GET", "/documents/gadget-2/source")[0] == 404 and h.dispatch("GET", "/documents/zz")[0] == 404
    config = h.dispatch("GET", "/config")[1]
    assert [f["name"] for f in config["filters"]] == ["category", "rating", "tags"] and config["filters"][0]["control"] == "dropdown"
    assert config["search"] == {"semantic": True, "semantic_text": False, "lexical": True}


@pytest.mark.parametrize(
    "change, said",
    [
        (lambda c: c.update(schema_version=2), "schema_version"), (lambda c: c.update(zz=1), "unknown key"), (lambda c: c["filters"].update({"1x": {"type": "int", "operation": "range"}}), "a name has"),
        (lambda c: c["filters"].update(x={"type": "bool", "operation": "range"}), "operation"), (lambda c: c["filters"].update(x={"type": "list", "operation": "contains"}), "item_type"),
        (lambda c: c["filters"].update(x={"type": "int", "operation": "range", "default": {"min": "1"}}), "default"), (lambda c: c["search"].update(semantic={"enabled": False}, lexical={"enabled": False}), "neither"),
        (lambda c: c["search"].update(ranking={"weights": {"semantic": 0, "lexical": 0}}), "weights"), (lambda c: c["search"].update(pagination={"default_page_size": 9, "max_page_size": 3}), "pagination"),
        (lambda c: c["frontend"]["filters"].update(zz={"label": "z", "order": 9}), "no such filter"), (lambda c: c["frontend"]["filters"].update(in_stock={"label": "z", "order": 1}), "twice"),
        (lambda c: c["frontend"]["filters"].update(in_stock={"label": "z", "order": 9, "control": "text"}), "control"), (lambda c: c["frontend"].update(branding={"title": "x", "primary_color": "red"}), "primary_color"),
        (lambda c: c["search"].update(semantic={"multi_query_combination": "sum"}), "combination"),
    ],
)
def test_bad_configs(change, said):
    raw = json.loads(json.dumps(CONFIG))
    change(raw)
    with pytest.raises(BadConfig, match=said):
        parse(raw)


def test_config_file(tmp_path):
    from siltstone.plans.config import load

    good = tmp_path / "c.yaml"
    good.write_text(json.dumps(CONFIG))
    assert [f.name for f in load(str(good)).fields] == list(CONFIG["filters"])
    (tmp_path / "bad.yaml").write_text("a: [")
    (tmp_path / "empty.yaml").write_text("")
    for name in ("none.yaml", "bad.yaml", "empty.yaml", "."):
        with pytest.raises(BadConfig):
            load(str(tmp_path / name))
