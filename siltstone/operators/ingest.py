"""Batch ingestion: raw JSON records to typed documents and a full account of what was wrong.

Nothing raises for a bad record. One annotated DataFrame carries every record
with its errors; valid documents and the error tables are views of it. Raw
metadata is a VARIANT, because reading JSON into a schema would turn 5 into
"5" and "42" into 42; a value is accepted only if its own type is right.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import strip
from siltstone.operators.fields import FieldDef, FieldType, schema_of

ERROR = "array<struct<field:string,message:string>>"


def _error(field: Column | str, message: Column | str) -> Column:
    as_lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.array(F.struct(as_lit(field).cast("string").alias("field"), as_lit(message).cast("string").alias("message")))


def _none() -> Column:
    return F.array().cast(ERROR)


def _type(v: Column) -> Column:
    return F.schema_of_variant(v)


def _accepts(v: Column, kind: FieldType) -> Column:
    """Whether the variant is of the declared type as it stands."""
    t = _type(v)
    if kind is FieldType.FLOAT:
        return t.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(t, F.lit("DECIMAL"))
    if kind is FieldType.DATE:
        s = F.try_variant_get(v, "$", "string")
        return (t == "STRING") & s.rlike(r"^\d{4}-\d{2}-\d{2}$") & s.try_cast("date").isNotNull()
    return t == {FieldType.STRING: "STRING", FieldType.BOOL: "BOOLEAN", FieldType.INT: "BIGINT"}[kind]


def _value(v: Column, kind: FieldType) -> Column:
    spark = {FieldType.STRING: "string", FieldType.BOOL: "boolean", FieldType.INT: "bigint", FieldType.FLOAT: "double", FieldType.DATE: "string"}[kind]
    got = F.try_variant_get(v, "$", spark)
    return got.try_cast("date") if kind is FieldType.DATE else got


def _is_null(v: Column) -> Column:
    return v.isNull() | (_type(v) == "VOID")


def _typed(field: FieldDef) -> tuple[Column, Column]:
    """(value or null, errors) of one declared field of the column ``meta``."""
    v = F.try_element_at(F.col("meta"), F.lit(field.name))
    absent = _is_null(v)
    missing = _error(field.name, "required") if field.required else _none()
    if field.type is not FieldType.LIST:
        good = F.coalesce(_accepts(v, field.type), F.lit(False))
        wrong = _error(field.name, F.concat(F.lit(f"not of type {field.type.value}: "), _type(v)))
        return F.when(~absent & good, _value(v, field.type)), F.when(absent, missing).when(good, _none()).otherwise(wrong)
    items = F.try_variant_get(v, "$", "array<variant>")
    is_list = F.startswith(_type(v), F.lit("ARRAY"))
    bad = F.flatten(
        F.transform(items, lambda x, i: F.when(_is_null(x) | F.coalesce(_accepts(x, field.item_type), F.lit(False)), _none()).otherwise(_error(F.concat(F.lit(field.name + "["), i.cast("string"), F.lit("]")), F.concat(F.lit(f"not of type {field.item_type.value}: "), _type(x)))))
    )
    errors = F.when(absent, missing).when(~is_list, _error(field.name, "not a list")).otherwise(F.coalesce(bad, _none()))
    value = F.transform(items, lambda x: F.when(~_is_null(x), _value(x, field.item_type)))
    return F.when(~absent & is_list & (F.size(errors) == 0), value), errors


def _wire_errors() -> Column:
    """Of column ``v``, the record as a variant."""
    rec = F.col("rec")
    part = lambda k: F.try_element_at(rec, F.lit(k))
    is_text = lambda k: F.coalesce(_type(part(k)) == "STRING", F.lit(False))
    id_text = F.try_variant_get(part("id"), "$", "string")
    meta_type = _type(part("metadata"))
    has_meta = F.coalesce(F.startswith(meta_type, F.lit("OBJECT")), F.lit(False))
    nested = F.exists(F.map_values(F.col("raw_meta")), lambda x: F.startswith(_type(x), F.lit("OBJECT")))
    deep = F.exists(
        F.map_values(F.col("raw_meta")),
        lambda x: F.coalesce(F.exists(F.try_variant_get(x, "$", "array<variant>"), lambda y: F.startswith(_type(y), F.lit("OBJECT")) | F.startswith(_type(y), F.lit("ARRAY"))), F.lit(False)) & F.startswith(_type(x), F.lit("ARRAY")),
    )
    extra = F.array_except(F.map_keys(rec), F.array(*map(F.lit, ("id", "text", "metadata"))))
    return F.when(rec.isNull(), _error("record", "not an object")).otherwise(
        F.concat(
            F.when(is_text("id") & F.coalesce(strip(id_text) != "", F.lit(False)), _none()).otherwise(_error("id", "missing, blank or not text")),
            F.when(is_text("text"), _none()).otherwise(_error("text", "missing or not text")),
            F.when(part("metadata").isNull() | has_meta, _none()).otherwise(_error("metadata", "not an object")),
            F.when(F.coalesce(nested | deep, F.lit(False)), _error("metadata", "a value is nested")).otherwise(_none()),
            F.coalesce(F.flatten(F.transform(extra, lambda k: _error(k, "not a key of a record"))), _none()),
        )
    )


@dataclass
class Ingestion:
    """``annotated`` has every record; the rest are views of it."""

    annotated: DataFrame
    fields: list[FieldDef]

    @property
    def documents(self) -> DataFrame:
        """id, text, the declared fields, extras (undeclared metadata as JSON text)."""
        good = self.annotated.where((F.size("wire_errors") == 0) & (F.size("typing_errors") == 0) & ~F.col("duplicate"))
        return good.select("ordinal", "id", "text", *[f.name for f in self.fields], "extras")

    @property
    def errors(self) -> DataFrame:
        """ordinal, label, stage, field, message: one row an error."""
        staged = lambda name, c: F.transform(c, lambda e: F.struct(F.lit(name).alias("stage"), e["field"].alias("field"), e["message"].alias("message")))
        both = F.concat(staged("wire_format", F.col("wire_errors")), staged("metadata_typing", F.col("typing_errors")))
        # inline_outer, as inline would have its non-empty test pushed down and all checks evaluated twice
        return self.annotated.select("ordinal", "label", F.inline_outer(both)).where(F.col("field").isNotNull())

    @property
    def duplicate_ids(self) -> DataFrame:
        return self.annotated.where("duplicate").select("id").distinct()

    def summary(self) -> DataFrame:
        """One row: records, valid, wire_failed, typing_failed, duplicate_ids."""
        wire, typing = F.size("wire_errors") > 0, F.size("typing_errors") > 0
        return self.annotated.agg(
            F.count("*").alias("records"), F.count_if(~wire & ~typing & ~F.col("duplicate")).alias("valid"), F.count_if(wire).alias("wire_failed"), F.count_if(typing).alias("typing_failed"),
            F.count_distinct(F.when(F.col("duplicate"), F.col("id"))).alias("duplicate_ids"),
        )

    def require_clean(self) -> None:
        row = self.summary().first()
        if row.valid != row.records:
            raise ValueError(f"{row.records - row.valid} of {row.records} records are not valid: {row.asDict()}")


def ingest(raw: DataFrame, fields: list[FieldDef], undeclared: str = "passthrough") -> Ingestion:
    """raw: ordinal (long) and raw (one JSON record as text)."""
    if undeclared not in ("passthrough", "strict"):
        raise ValueError("undeclared is passthrough or strict")
    schema_of(fields)
    names = [f.name for f in fields]
    parsed = raw.select("ordinal", F.try_parse_json("raw").alias("v"))
    parsed = parsed.withColumn("rec", F.when(F.startswith(_type(F.col("v")), F.lit("OBJECT")), F.try_variant_get("v", "$", "map<string,variant>")))
    inner = F.try_element_at(F.col("rec"), F.lit("metadata"))
    parsed = parsed.withColumn("raw_meta", F.when(F.startswith(_type(inner), F.lit("OBJECT")), F.try_variant_get(inner, "$", "map<string,variant>")))
    parsed = parsed.withColumn("wire_errors", _wire_errors())
    ok = F.size("wire_errors") == 0
    get = lambda k: F.try_variant_get(F.try_element_at(F.col("rec"), F.lit(k)), "$", "string")
    parsed = parsed.select("ordinal", "wire_errors", F.when(ok, get("id")).alias("id"), F.when(ok, get("text")).alias("text"), F.when(ok, F.col("raw_meta")).alias("meta"), get("id").alias("claimed"))
    typed = [(f.name, *_typed(f)) for f in fields]
    extra = F.map_filter("meta", lambda k, v: ~k.isin(names)) if names else F.col("meta")
    stray = F.coalesce(F.flatten(F.transform(F.map_keys(extra), lambda k: _error(k, "not declared"))), _none()) if undeclared == "strict" else _none()
    errors = F.concat(*[e for _, _, e in typed], stray)
    label = F.coalesce(F.nullif(strip("claimed"), F.lit("")), F.concat(F.lit("<record at index "), F.col("ordinal").cast("string"), F.lit(">")))
    extras = F.coalesce(F.transform_values(extra, lambda _, v: F.to_json(v)), F.create_map().cast("map<string,string>"))
    twice = F.col("id").isNotNull() & (F.count("*").over(Window.partitionBy("id")) > 1)
    out = parsed.select("ordinal", label.alias("label"), "id", "text", *[v.alias(n) for n, v, _ in typed], extras.alias("extras"), "wire_errors", F.when(F.size("wire_errors") == 0, errors).otherwise(_none()).alias("typing_errors"))
    return Ingestion(out.withColumn("duplicate", twice), fields)


def attach_embeddings(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """docs with vector and model_id by id; null where there is none."""
    return docs.join(vectors.select("id", "vector", "model_id"), "id", "left")


def unmatched_embeddings(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Ids of vectors without a document."""
    return vectors.join(docs, "id", "left_anti").select("id").distinct()


def single_model(vectors: DataFrame) -> str | None:
    """The model that made the vectors; more than one is an error."""
    models = [r[0] for r in vectors.select("model_id").distinct().limit(2).collect()]
    if len(models) > 1:
        raise ValueError(f"vectors of more than one model: {sorted(map(str, models))}")
    return models[0] if models else None


def last_wins(vectors: DataFrame, order: str = "ordinal") -> DataFrame:
    """One vector an id: the one added last."""
    return vectors.groupBy("id").agg(F.max_by(F.struct("vector", "model_id"), F.col(order)).alias("e")).select("id", "e.*")


def carry_forward(pages: DataFrame, columns: list[str], group: str, order: list[str]) -> DataFrame:
    """Each column filled with its last value so far in the group; a value of the row's own wins."""
    so_far = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return pages.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in columns})
