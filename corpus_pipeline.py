"""The corpus pipeline: from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps,
with the columns of ``documents``; the last returns what is to be trained on.
A stage's result is written as Parquet and read again by the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.bpe import bpe_round_trip
from siltstone.llm.lines import drop_shared_lines
from siltstone.llm.mixing import mixed
from siltstone.llm.quality import fit, quality_scores
from siltstone.llm.shared import written
from siltstone.llm.simhash import one_of_each

#: Name of a vocabulary file of the installed public tokenizers.
VOCABULARY = "byte_bpe_50k.json"
#: Of two texts' sets of five-word shingles, from which on they are near-duplicates.
SIMILARITY = 0.8


def _beside(docs: DataFrame, made: tuple[str, ...], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """run(docs) with the columns of docs, also those named like the columns that run makes."""
    own = {c: f"__own_{c}" for c in docs.columns if c.lower() in made}
    return run(docs.withColumnsRenamed(own)).drop(*made).withColumnsRenamed({v: k for k, v in own.items()}).select(*[f"`{c}`" for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among them, accepts.

    Null and empty texts are scored like any other (as bytes of zero); without
    labels of both kinds all documents have one score; repeated rows go or
    stay together; columns named score and predicted are kept.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    net = fit(docs, labels)
    return _beside(docs, ("score", "predicted"), lambda d: quality_scores(d, net).where("predicted = 1"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sources share; n_chars follows the text.

    No row is dropped: null texts stay null, with n_chars null, and empty ones
    empty; a null source counts as one source. Of equal lines the one of the
    smallest doc_id stays, a null doc_id being larger than all.
    """
    out = _beside(docs, ("n_lines", "n_removed"), drop_shared_lines)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts whose five-word shingles are similar to 0.8 or more, that of the smallest id.

    Texts without words, null ones included, are one class; a null doc_id is
    kept only where the class has no other; repeated rows and ties (then the
    text hash decides) leave one.
    """
    return one_of_each(docs, similarity=SIMILARITY).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them, none, once or twice.

    Null texts and texts without words take no part; a null source is a
    source; the one document that a budget cuts is kept to the nearest whole.
    """
    return mixed(docs).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, token ids and digests of every document of the mix, repeats included; a null text has no tokens."""
    import public_tokenizers

    out = bpe_round_trip(docs.select("doc_id", "source", "text"), public_tokenizers.path(VOCABULARY))
    return out.select("doc_id", "source", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256")


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mixing", mixing), ("encoding", encoding)]

#: SQL can express neither the classifier nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
