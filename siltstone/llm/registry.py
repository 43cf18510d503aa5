"""The queries of this package, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(modulus: int, rest: int):
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus == rest).alias("held_out")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.topk import binary_codes, top_k

    codes = binary_codes(table(spark, sf_dir, "embeddings"))
    return top_k(codes, codes.where(F.col("id") % 50 == 0))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.lines import drop_shared_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_shared_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.media import text_media

    return text_media(table(spark, sf_dir, "documents").select("doc_id", "text"), with_media=False).drop("text")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.langid import fit, language_of

    docs = table(spark, sf_dir, "documents")
    scored = language_of(docs.select("doc_id", "text"), fit(docs))
    return scored.select("doc_id", held_out(4, 2), "lang_pred", "score")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.quality import fit, quality_scores

    docs = table(spark, sf_dir, "documents")
    scored = quality_scores(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(5, 0), "score", "predicted")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from siltstone.llm.bpe import bpe_round_trip

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.warc import derivatives, responses

    made = derivatives(responses(table(spark, sf_dir, "pages")))
    return made.select("page_id", *[c for c in made.columns if c not in ("page_id", "record")], F.sha2("record", 256).alias("record_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix, op2_topk, op3_lines, op4_simhash, op5_media, op6_language, op7_quality, op8_substrings, op9_bpe, op10_warc)}


def oracle_sql() -> dict[str, str]:
    from siltstone.llm import lines, mixing, substrings, topk

    return {"op1_mix": mixing.ORACLE, "op2_topk": topk.ORACLE, "op3_lines": lines.ORACLE, "op8_substrings": substrings.ORACLE}
