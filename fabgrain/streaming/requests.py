"""The windowed request measures as Structured Streaming jobs.

Streams run in append mode: a window is written once, after the watermark has passed its end.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fabgrain.operators.monitor import (
    CALLER_LIMIT, CALLER_WINDOW_SECONDS, ERROR_SHARE, EVALUATION_SECONDS, LABELS, RATE_SECONDS,
    SLOW_QUANTILE, SLOW_SECONDS, bound_counts, bucket_quantile, is_error,
)
from fabgrain.session import new_path

# Rows later than this behind the newest one are dropped; it bounds the state.
DELAY = "10 minutes"


def windowed(
    requests: DataFrame, keys: Sequence[str], measures: Mapping[str, Column], length: int, step: int, delay: str = DELAY
) -> DataFrame:
    """Additive measures per sliding window of a stream whose ``ts`` is a TIMESTAMP.

    Rows are counted once per step; a second aggregation adds the steps of each window up.
    """
    steps = requests.withWatermark("ts", delay).groupBy(F.window("ts", f"{step} seconds").alias("_s"), *keys)
    counted = steps.agg(*[c.alias(n) for n, c in measures.items()])
    if length == step:
        return counted.select(*keys, F.col("_s.start").alias("window_start"), F.col("_s.end").alias("window_end"), *measures)
    at = F.window(F.window_time("_s"), f"{length} seconds", f"{step} seconds")
    grouped = counted.groupBy(at.alias("_w"), *keys).agg(*[F.sum(n).alias(n) for n in measures])
    return grouped.select(*keys, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *measures)


def rate_stream(requests: DataFrame, labels: Sequence[str] = tuple(LABELS), length: int = RATE_SECONDS, step: int = EVALUATION_SECONDS, delay: str = DELAY) -> DataFrame:
    """Requests per second over sliding windows."""
    return windowed(requests, labels, {"requests": F.count("*")}, length, step, delay).withColumn("rate", F.col("requests") / length)


def slow_stream(
    requests: DataFrame, keys: Sequence[str] = (), length: int = RATE_SECONDS, step: int = EVALUATION_SECONDS,
    q: float = SLOW_QUANTILE, threshold: float = SLOW_SECONDS, delay: str = DELAY,
) -> DataFrame:
    """Latency quantile per sliding window."""
    return windowed(requests, keys, bound_counts(), length, step, delay).withColumn("latency", bucket_quantile(q)).select(
        *keys, "window_start", "window_end", "latency", (F.col("latency") > threshold).alias("active")
    )


def error_stream(
    requests: DataFrame, keys: Sequence[str] = (), length: int = RATE_SECONDS, step: int = EVALUATION_SECONDS,
    threshold: float = ERROR_SHARE, delay: str = DELAY,
) -> DataFrame:
    """Share of 5xx requests per sliding window."""
    measures = {"errors": F.count_if(is_error()), "requests": F.count("*")}
    share = F.col("errors") / F.col("requests")
    return windowed(requests, keys, measures, length, step, delay).withColumns(
        {"error_ratio": share, "active": share > threshold}
    )


def over_limit_stream(requests: DataFrame, window_seconds: int = CALLER_WINDOW_SECONDS, limit: int = CALLER_LIMIT, delay: str = DELAY) -> DataFrame:
    """Callers with more than ``limit`` requests in a fixed window."""
    counted = windowed(requests, ["caller"], {"requests": F.count("*")}, window_seconds, window_seconds, delay)
    return counted.where(F.col("requests") > limit).withColumn("rejected", F.col("requests") - limit)


def drain(stream: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Run a stream over everything available now into a Parquet table, and read that table.

    Output and stream checkpoint lie in the shared folder; the file sink writes every batch once.
    """
    spark: SparkSession = stream.sparkSession
    path = path or new_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{path}/rows")
        .option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
