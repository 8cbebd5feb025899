"""Incoming files of draws as a stream: every file is taken once, its new draws are checked and added.

The stream remembers which files it has read, so a run after the last one only sees what has arrived since.  A batch
that contradicts the history stops the stream before anything is written, and is tried again at the next run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from drawspark.operators import validation
from drawspark.sources import draws as D

TEXT = T.StructType([T.StructField(c, T.StringType()) for c in D.COLUMNS])


def incoming_stream(spark: SparkSession, folder: str) -> DataFrame:
    return D.canonical(spark.readStream.schema(TEXT).option("header", True).option("pathGlobFilter", "*.csv").csv(folder))


def _take(batch: DataFrame, table: str, batch_id: int) -> None:
    spark = batch.sparkSession
    arrived = batch.dropDuplicates(D.COLUMNS).persist()
    known = spark.read.schema(D.SCHEMA).parquet(table) if D._exists(spark, f"{table}/*.parquet") else D.empty_draws(spark)
    bad = validation.source_conflicts(arrived).unionByName(validation.conflicts(known, arrived)).limit(validation.LISTED).collect()
    if bad:
        raise validation.ValidationError([r.asDict() | {"n_affected": 1, "n_sorteos": [r["n_sorteo"]]} for r in bad])
    new = validation.split_new(known, arrived)
    # rows known from an earlier try of the batch are not new any more, so a retry adds nothing twice
    new.coalesce(1).write.mode("append").parquet(table)
    arrived.unpersist()


def pick_up(spark: SparkSession, folder: str, table: str, checkpoint: str) -> None:
    """Take all files that have arrived since the last run into a Parquet table of draws, then stop."""
    query = (
        incoming_stream(spark, folder).writeStream.foreachBatch(lambda batch, k: _take(batch, table, k))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
