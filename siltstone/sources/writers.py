"""Sinks: upserts, exports, and look-up of single documents and their source files."""

from __future__ import annotations

from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import page_order


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those with their key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def write_sources(records: DataFrame, files: DataFrame, folder: str) -> None:
    """Two tables: sources (a row a file, with its bytes) and documents (a row a page)."""
    files.dropDuplicates(["source_file"]).write.mode("errorifexists").parquet(f"{folder}/sources")
    records.write.mode("errorifexists").parquet(f"{folder}/documents")


def write_export(exported: DataFrame, path: str) -> None:
    """One line of text for each exported file: name, tab, body with its line ends escaped."""
    body = F.replace(F.replace(F.col("body"), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    exported.select(F.concat_ws("\t", "filename", body).alias("value")).write.text(path)


def write_page_texts(hits: DataFrame, path: str) -> None:
    """The texts of ``composite.export_text`` as text files, a folder for each file name; no file's text is one row.

    Pages are sorted by ranges of (file, page), so part files in the order of
    their names have a file's pages in order.
    """
    # the folder's column comes first, so that the writer's own sort by it is not needed and keeps the pages' order
    order = ["filename", "__page", "row_idx"]
    pages = hits.select("filename", page_order("page_number").alias("__page"), "row_idx", F.coalesce("text", F.lit("")).alias("text"))
    pages = pages.repartitionByRange(*order).sortWithinPartitions(*order)
    pages.select("filename", "text").write.partitionBy("filename").option("lineSep", "\n\n").text(path)


def document(docs: DataFrame, key: str, id_col: str = "id") -> dict | None:
    """The document of an id, as a dict; the filter reaches the scan."""
    row = docs.where(F.col(id_col) == key).head(1)
    return row[0].asDict(recursive=True) if row else None


def inside(root: str, relative: str) -> Path:
    """The file of a relative path below root; a path that leads out is an error."""
    base = Path(root).resolve()
    found = (base / PurePosixPath(relative.replace("\\", "/").lstrip("/"))).resolve()
    if not found.is_relative_to(base):
        raise ValueError("the path leads out of the documents")
    return found
