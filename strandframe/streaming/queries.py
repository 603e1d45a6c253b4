"""Streaming forms of two mergeable aggregates: run-log windows and read quality."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_base


def run_log_windows(log: DataFrame, window: str = "1 hour", delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Steps, total milliseconds and errors per tumbling window; rows later than ``delay`` are dropped."""
    return (
        log.withWatermark(ts, delay)
        .groupBy(F.window(ts, window).alias("w"))
        .agg(F.count(F.lit(1)).alias("steps"), F.sum("duration_ms").alias("total_ms"), F.sum(F.when(F.col("status") == "error", 1).otherwise(0)).alias("errors"))
        .select(F.col("w.start").alias("window_start"), "steps", "total_ms", "errors")
    )


def quality_histogram(reads: DataFrame, sample: str = "sample", qual: str = "qual") -> DataFrame:
    """Bases per sample and score: at most 94 rows of state per sample."""
    return reads.select(sample, F.explode(F.split(qual, "")).alias("_c")).filter("_c <> ''").groupBy(sample, (F.ascii("_c") - 33).alias("score")).agg(F.count(F.lit(1)).alias("bases"))


def quality_from_histogram(hist: DataFrame, sample: str = "sample") -> DataFrame:
    n = F.col("bases")
    return hist.groupBy(sample).agg(
        F.sum("bases").alias("bases"), (F.sum(F.col("score") * n) / F.sum("bases")).alias("quality_mean"),
        (F.sum(F.when(F.col("score") >= 20, n).otherwise(0)) / F.sum("bases") * 100).alias("percent_q20"),
        (F.sum(F.when(F.col("score") >= 30, n).otherwise(0)) / F.sum("bases") * 100).alias("percent_q30"),
    )


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for results and stream state in the shared folder."""
    return os.path.join(shared_base(spark), f"{name}-{uuid.uuid4().hex}")


def drain(stream: DataFrame, name: str, complete: bool = False) -> DataFrame:
    """Run a stream over what is available and return what it wrote as a table.

    Appended results go to a Parquet sink. A complete result is rewritten per batch, and read back from the last.
    """
    spark = stream.sparkSession
    base = scratch(spark, name)
    out = os.path.join(base, "out")
    writer = stream.writeStream.option("checkpointLocation", os.path.join(base, "state")).trigger(availableNow=True)
    if complete:
        # a stream without any file runs no batch
        spark.createDataFrame([], stream.schema).write.parquet(out)
        writer = writer.outputMode("complete").foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(out))
        writer.start().awaitTermination()
    else:
        writer.outputMode("append").format("parquet").start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
