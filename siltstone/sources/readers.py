"""Sources: records, JSON, JDBC, relational assembly, pages of files, sidecars."""

from __future__ import annotations

import sqlite3
from collections.abc import Callable, Iterable
from contextlib import closing
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import strip

RAW = "ordinal long, raw string"


def from_records(spark: SparkSession, rows: Iterable[dict]) -> DataFrame:
    """In-memory records as raw JSON text with their place."""
    import json

    return spark.createDataFrame([(i, json.dumps(r, ensure_ascii=False, default=str)) for i, r in enumerate(rows)], RAW)


def template_records(spark: SparkSession) -> DataFrame:
    """What a new project replaces by its own loader, which returns ordinal and raw."""
    raise NotImplementedError("a project supplies its own loader")


def from_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One JSON record a line; the order is that of (file, line start)."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ordinal"))
    return lines.where(F.trim("value") != "").select("ordinal", F.col("value").alias("raw"))


def from_table(table: DataFrame, id_col: str, text_col: str, metadata: list[str], order: str | None = None) -> DataFrame:
    """A typed table as raw records; null metadata is left out."""
    record = F.struct(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.struct(*metadata).alias("metadata"))
    return table.select((F.col(order) if order else F.monotonically_increasing_id()).cast("long").alias("ordinal"), F.to_json(record).alias("raw"))


def from_jdbc(spark: SparkSession, url: str, table: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A table behind JDBC; partition = (column, low, high, number) reads it in parallel ranges."""
    read = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition:
        column, low, high, n = partition
        read = read.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(n))
    return read.load()


#: Rows of a SQLite table that a task reads.
SQLITE_ROWS = 20_000


def from_sqlite(spark: SparkSession, path: str, table: str = "documents") -> DataFrame:
    """id, text, metadata_json rows of a SQLite file, as raw records. Bad JSON names its row.

    The driver reads the range of row ids only; tasks read the rows, a range
    each, so executors have to see the file at the same path. A row's ordinal
    is its row id, counted from the first.
    """
    if not Path(path).is_file():
        raise FileNotFoundError(path)
    if not table.isidentifier():
        raise ValueError(f"no table name: {table}")
    uri = f"file:{path}?mode=ro"
    with closing(sqlite3.connect(uri, uri=True)) as db:
        low, high = db.execute(f"SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM {table}").fetchone()

    def read(batches):
        for starts in batches:
            with closing(sqlite3.connect(uri, uri=True)) as db:
                for start in starts["id"].tolist():
                    rows = db.execute(f"SELECT rowid, id, text, metadata_json FROM {table} WHERE rowid BETWEEN ? AND ?", (start, min(start + SQLITE_ROWS - 1, high)))
                    yield pd.DataFrame(rows.fetchall(), columns=["ordinal", "id", "text", "metadata_json"])

    parts = max(1, -(-(high - low + 1) // SQLITE_ROWS))
    frame = spark.range(low, high + 1, SQLITE_ROWS, parts).mapInPandas(read, "ordinal long, id string, text string, metadata_json string")
    bad = frame.where(F.col("metadata_json").isNotNull() & F.try_parse_json("metadata_json").isNull()).select("id").head(1)
    if bad:
        raise ValueError(f"metadata of row {bad[0].id} is not JSON")
    meta = F.coalesce("metadata_json", F.lit("{}"))
    return frame.select((F.col("ordinal") - low).alias("ordinal"), F.concat(F.lit('{"id":'), _json_text("id"), F.lit(',"text":'), _json_text("text"), F.lit(',"metadata":'), meta, F.lit("}")).alias("raw"))


def _json_text(column: str):
    """A string column as a JSON literal."""
    whole = F.to_json(F.struct(F.col(column).alias("x")), {"ignoreNullFields": "false"})
    return whole.substr(F.lit(6), F.length(whole) - 6)


def relational(main: DataFrame, parents: list[tuple[DataFrame, str]], children: tuple[DataFrame, str, str, str], text: list[str], order: list) -> DataFrame:
    """A normalised schema as one row each of ``main``.

    parents: (table, key) joined inner; children: (table, key, item, name), its
    items grouped to a sorted list, which is empty where there are none; text:
    columns whose non-empty values make ``text``, a line each.
    """
    out = main
    for table, key in parents:
        out = out.join(table, key)
    table, key, item, name = children
    grouped = table.groupBy(key).agg(F.sort_array(F.collect_set(item)).alias(name))
    out = out.join(grouped, key, "left").withColumn(name, F.coalesce(name, F.array().cast(dict(grouped.dtypes)[name])))
    out = out.withColumn("text", F.concat_ws("\n", *[F.nullif(strip(F.col(c).cast("string")), F.lit("")) for c in text]))
    return out.orderBy(*order)


def with_sidecar(files: DataFrame, sidecar: DataFrame, columns: list[str]) -> DataFrame:
    """Defaults of files overridden by a sidecar keyed by relative path or else by file name.

    files: path_rel, filename, columns; sidecar: key, columns. An entry for the
    path hides the one for the name; what an entry leaves null stays.
    """
    keyed = sidecar.groupBy("key").agg(*[F.any_value(c, ignoreNulls=True).alias(c) for c in columns])
    by = lambda k: keyed.select(F.col("key").alias(k), F.struct(*columns).alias(f"by_{k}"))
    out = files.join(by("path_rel"), "path_rel", "left").join(by("filename"), "filename", "left")
    entry = F.coalesce("by_path_rel", "by_filename")
    return out.select(*[F.coalesce(entry[c], F.col(c)).alias(c) if c in columns else F.col(c) for c in files.columns])


Extract = Callable[[bytes], list[str]]


def pages_of_files(spark: SparkSession, folder: str, extract: Extract, glob: str = "*.pdf", recursive: bool = True, empty_pages: str = "skip") -> tuple[DataFrame, DataFrame]:
    """(records, issues): a record for each page of each file, id `relative#page=N`.

    extract turns a file's bytes to page texts on the executors (a PDF library
    is the caller's to bring). empty_pages: skip, include or error. A file that
    can't be read becomes an issue and doesn't stop the rest.
    """
    if empty_pages not in ("skip", "include", "error"):
        raise ValueError("empty_pages is skip, include or error")
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")

    def run(batches):
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                rel = path.removeprefix(root).lstrip("/") if path.startswith(root) else path.rsplit("/", 1)[-1]
                try:
                    texts = extract(bytes(content))
                except Exception as e:  # whatever the library raises belongs to the file
                    out.append((rel, None, None, f"{type(e).__name__}: {e}"))
                    continue
                for n, text in enumerate(texts, 1):
                    if not (text or "").strip() and empty_pages != "include":
                        if empty_pages == "error":
                            out.append((rel, n, None, "empty page"))
                        continue
                    out.append((rel, n, text or "", None))
            yield pd.DataFrame(out, columns=["source_path", "source_page", "text", "issue"]).astype({"source_page": "Int32"})

    read = files.select("path", "content").mapInPandas(run, "source_path string, source_page int, text string, issue string")
    name = F.regexp_extract("source_path", r"[^/]+$", 0)
    records = read.where(F.col("issue").isNull()).select(F.concat("source_path", F.lit("#page="), F.col("source_page").cast("string")).alias("id"), "text", "source_path", name.alias("source_file"), "source_page")
    return records.orderBy(F.lower("source_path"), "source_path", "source_page"), read.where(F.col("issue").isNotNull()).select("source_path", "source_page", "issue")
