"""The driver tables seen as the engine's corpora, in Spark and, under the same names, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.fields import FieldDef, FieldType

S = FieldType
DOC_FIELDS = {
    "lang": (FieldDef("lang", S.STRING), "equality"), "source": (FieldDef("source", S.STRING), "contains"), "n_chars": (FieldDef("n_chars", S.INT), "range"),
    "quality": (FieldDef("quality", S.INT), "equality"), "good": (FieldDef("good", S.BOOL), "equality"),
}
ITEM_FIELDS = {
    "brand": (FieldDef("brand", S.STRING), "equality"), "kind": (FieldDef("kind", S.STRING), "contains"), "size": (FieldDef("size", S.INT), "range"),
    "price": (FieldDef("price", S.FLOAT), "range"), "tags": (FieldDef("tags", S.LIST, S.STRING), "contains"),
}
ORDER_FIELDS = {"day": (FieldDef("day", S.DATE), "range"), "total": (FieldDef("total", S.FLOAT), "range"), "status": (FieldDef("status", S.STRING), "equality")}
CHUNK = 400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"))
    out = table(spark, d, "documents").join(labels, "doc_id", "left")
    return out.select(F.col("doc_id").cast("string").alias("id"), "doc_id", "text", "lang", "source", "n_chars", "quality", (F.col("quality") == 1).alias("good"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), F.lit("m").alias("model_id"))


def query_vector(spark: SparkSession, d: str, vec_id: int = 0) -> tuple[float, ...]:
    row = table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return tuple(float(x) for x in row[0])


def items(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"),
        F.col("p_size").cast("long").alias("size"), F.col("p_retailprice").alias("price"), F.split("p_name", " ").alias("tags"),
    )


def orders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("id"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("total"), F.col("o_orderstatus").alias("status"))


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents as the pages of files: one file a source."""
    c = F.col
    return table(spark, d, "documents").select(
        c("doc_id").alias("row_idx"), F.concat("source", F.lit(".pdf")).alias("filename"), "text", (c("doc_id") % 17).cast("string").alias("page_number"), F.upper("lang").alias("doctype"),
        F.when(c("doc_id") % 5 != 0, F.concat(F.lit("No "), (c("doc_id") % 7).cast("string"))).alias("lawnumber"),
        F.concat(F.lit("1. Topic "), (c("doc_id") % 3).cast("string"), F.lit("; Lang "), "lang").alias("subjects"),
        F.when(c("doc_id") % 4 != 0, F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (c("doc_id") % 900).cast("int")), "yyyy-MM-dd")).alias("date"),
    )


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Fixed-width pieces of all documents, with the vector of their number modulo 500, as the SQL has it: vectors from 500 on aren't used."""
    pieces = table(spark, d, "documents").select(F.col("doc_id").alias("page_index"), F.posexplode(F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(CHUNK))).alias("n", "start"), F.length("text").alias("len"))
    number = F.pmod(F.col("page_index") * 31 + F.col("n"), F.lit(500)).cast("long")
    pieces = pieces.select(F.concat_ws("-", "page_index", "n").alias("chunk_id"), "page_index", F.array(F.struct(F.col("start").cast("int").alias("start"), F.least(F.col("start") + CHUNK, F.col("len")).cast("int").alias("end"))).alias("source_ranges"), number.alias("vec_id"))
    return pieces.join(table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector")), "vec_id").drop("vec_id")


def visits(spark: SparkSession, d: str) -> DataFrame:
    """Events as pages of a file a user, with the type known on some pages only."""
    e = table(spark, d, "events")
    return e.select("event_id", F.col("user_id").cast("string").alias("file"), "ts", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("kind"), F.when(F.col("event_id") % 4 == 0, F.col("value")).alias("amount"))


SQL = {
    "docs": "docs AS (SELECT d.doc_id::VARCHAR AS id, d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality::BIGINT AS quality, l.quality = 1 AS good FROM documents d LEFT JOIN labels l USING (doc_id))",
    "vecs": "vecs AS (SELECT vec_id::VARCHAR AS id, embedding::DOUBLE[] AS v FROM embeddings)",
    "q": "q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0)",
    "qs": "qs AS (SELECT vec_id AS n, embedding::DOUBLE[] AS qv, (3 - vec_id)::DOUBLE AS w FROM embeddings WHERE vec_id IN (0, 1, 2))",
    "sim": "sim AS (SELECT id, list_cosine_similarity(v, qv) AS score FROM vecs, q)",
    "sims": "sims AS (SELECT n, w, id, list_cosine_similarity(v, qv) AS score FROM vecs, qs)",
    "items": "items AS (SELECT p_partkey::VARCHAR AS id, p_partkey AS ordinal, p_name AS title, p_brand AS brand, p_type AS kind, p_size::BIGINT AS size, p_retailprice AS price, string_split(p_name, ' ') AS tags FROM part)",
    "ords": "ords AS (SELECT o_orderkey::VARCHAR AS id, o_orderdate::DATE AS day, o_totalprice AS total, o_orderstatus AS status FROM orders)",
    "pg": """pg AS (SELECT doc_id AS row_idx, source || '.pdf' AS filename, text, (doc_id % 17)::VARCHAR AS page_number, upper(lang) AS doctype,
        CASE WHEN doc_id % 5 <> 0 THEN 'No ' || (doc_id % 7)::VARCHAR END AS lawnumber, '1. Topic ' || (doc_id % 3)::VARCHAR || '; Lang ' || lang AS subjects,
        CASE WHEN doc_id % 4 <> 0 THEN strftime(DATE '2020-01-01' + (doc_id % 900)::INT, '%Y-%m-%d') END AS date FROM documents)""",
    "pieces": f"""pieces AS (SELECT doc_id AS page_index, n, n * {CHUNK} AS start_, least(n * {CHUNK} + {CHUNK}, len) AS end_, len, doc_id || '-' || n AS chunk_id, (doc_id * 31 + n) % 500 AS vec_id
        FROM (SELECT doc_id, length(text) AS len, unnest(range(0, greatest((length(text) - 1) // {CHUNK}, 0) + 1)) AS n FROM documents))""",
    "ch": "ch AS (SELECT chunk_id, page_index, start_, end_, len, list_inner_product(embedding::DOUBLE[], qv) AS score FROM pieces JOIN embeddings USING (vec_id), q)",
}


def with_(names: str, select: str) -> str:
    """select, after the named tables; one that begins with a comma adds tables of its own."""
    return "WITH " + ", ".join(SQL[n] for n in names.split()) + (select if select.startswith(",") else " " + select)


#: Folding as functions.text.fold has it.
def folded(expr: str) -> str:
    return f"replace(replace(lower({expr}), 'ß', 'ss'), 'ς', 'σ')"
