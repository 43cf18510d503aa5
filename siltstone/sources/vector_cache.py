"""Embedding cache in Parquet, and the hook for embedders."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import digest

CACHE = "id string, text_sha256 string, model_id string, vector array<double>"


class Embedder(Protocol):
    """Texts to vectors; document and query prefixes are the embedder's own."""

    model_id: str

    def documents(self, texts: Sequence[str]) -> list[list[float]]: ...

    def queries(self, texts: Sequence[str]) -> list[list[float]]: ...


@dataclass(frozen=True)
class TextEmbedder:
    """An Embedder around any function from texts to vectors: prefixes, batches, vectors of unit length.

    ``encode`` travels to the executors, so it has to be picklable.
    """

    model_id: str
    encode: Callable[[list[str]], Sequence[Sequence[float]]]
    document_prefix: str = ""
    query_prefix: str = ""
    normalize: bool = True
    batch_size: int = 32

    def documents(self, texts: Sequence[str]) -> list[list[float]]:
        return self._run(self.document_prefix, texts)

    def queries(self, texts: Sequence[str]) -> list[list[float]]:
        return self._run(self.query_prefix, texts)

    def _run(self, prefix: str, texts: Sequence[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for a in range(0, len(texts), self.batch_size):
            part = [prefix + t for t in texts[a : a + self.batch_size]]
            made = [[float(x) for x in v] for v in self.encode(part)]
            if len(made) != len(part):
                raise ValueError(f"{len(made)} vectors of {len(part)} texts")
            out += made
        return [_unit(v) for v in out] if self.normalize else out


def _unit(v: list[float]) -> list[float]:
    n = math.sqrt(math.fsum(x * x for x in v))
    return [x / n for x in v] if n else v


@dataclass
class ModelByName:
    """``encode`` of a sentence-transformers model, which is loaded once in each process that needs it."""

    name: str

    def __call__(self, texts: list[str]) -> Sequence[Sequence[float]]:
        from sentence_transformers import SentenceTransformer

        if self.name not in _models:
            _models[self.name] = SentenceTransformer(self.name)
        return _models[self.name].encode(texts).tolist()


_models: dict[str, object] = {}


def cache_hits(docs: DataFrame, cache: DataFrame, model_id: str) -> DataFrame:
    """id, vector of the documents whose id, text digest and model agree with an entry."""
    now = docs.select("id", digest("text").alias("text_sha256"))
    return now.join(cache.where(F.col("model_id") == model_id), ["id", "text_sha256"]).select("id", "vector")


def embedded(docs: DataFrame, embedder: Embedder, cache: DataFrame | None = None) -> DataFrame:
    """id, text_sha256, model_id, vector of all documents; only what the cache lacks is computed, in batches."""
    make: Callable = embedder.documents

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(make(texts.fillna("").tolist()))

    now = docs.select("id", "text", digest("text").alias("text_sha256"))
    if cache is None:
        return now.select("id", "text_sha256", F.lit(embedder.model_id).alias("model_id"), run("text").alias("vector"))
    known = cache.where(F.col("model_id") == embedder.model_id).select("id", "text_sha256", "model_id", "vector")
    hit = known.join(now.select("id", "text_sha256"), ["id", "text_sha256"], "left_semi").select("id", "text_sha256", "model_id", "vector")
    miss = now.join(known.select("id", "text_sha256"), ["id", "text_sha256"], "left_anti")
    return hit.unionByName(miss.select("id", "text_sha256", F.lit(embedder.model_id).alias("model_id"), run("text").alias("vector")))


def write_cache(entries: DataFrame, path: str) -> None:
    """Replace the cache by these entries: written beside it, then swapped in. Ids are unique, sizes agree."""
    row = entries.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_distinct(F.size("vector")).alias("sizes")).first()
    if row.n != row.ids:
        raise ValueError("an id is there more than once")
    if row.sizes > 1:
        raise ValueError("vectors differ in size")
    spark = entries.sparkSession
    jvm, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    fresh, place, old = (jvm.Path(f"{path.rstrip('/')}{end}") for end in ("._new", "", "._old"))
    fs = place.getFileSystem(conf)
    entries.sortWithinPartitions("id").write.mode("overwrite").parquet(fresh.toString())
    fs.delete(old, True)
    if fs.exists(place):
        fs.rename(place, old)
    fs.rename(fresh, place)
    fs.delete(old, True)
    spark.catalog.refreshByPath(path)
