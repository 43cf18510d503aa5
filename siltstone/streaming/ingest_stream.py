"""Micro-batch ingestion: files of JSON lines to a typed corpus and an error table.

Each micro-batch goes through the batch operator, so the rules are the same.
Within a batch no copy of a repeated id survives, as in a batch load; an id
that an earlier batch had is an update, and ``latest`` picks the newest row.
Output folders carry the batch id, so that a batch repeated after a failure
replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.operators.fields import FieldDef
from siltstone.operators.ingest import ingest


def start(spark: SparkSession, source: str, target: str, fields: list[FieldDef], checkpoint: str, undeclared: str = "passthrough", files_at_once: int = 1000) -> StreamingQuery:
    """Ingest all JSON-lines files in ``source`` that are not yet in ``target``."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_at_once).text(source)

    def write(batch: DataFrame, number: int) -> None:
        raw = batch.where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("ordinal"), F.col("value").alias("raw"))
        done = ingest(raw, fields, undeclared)
        done.documents.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/documents/part={number}")
        done.errors.write.mode("overwrite").parquet(f"{target}/errors/part={number}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str) -> DataFrame:
    """The newest row of each id."""
    rows = spark.read.parquet(f"{target}/documents").drop("part")
    columns = [c for c in rows.columns if c not in ("id", "batch")]
    return rows.groupBy("id").agg(F.max_by(F.struct(*columns), "batch").alias("r")).select("id", "r.*")
