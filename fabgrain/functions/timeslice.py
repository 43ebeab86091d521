"""Time-ordered computations cut into time slices, so that one busy key spreads over many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECOND = 1_000_000


def micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since 1970 of a timestamp column, whatever the session time zone."""
    if isinstance(df.schema[ts].dataType, T.TimestampType):
        return F.unix_micros(F.col(ts))
    gap = F.col(ts) - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    whole = F.extract(F.lit("DAY"), gap) * 86400 + F.extract(F.lit("HOUR"), gap) * 3600 + F.extract(F.lit("MINUTE"), gap) * 60
    return whole.cast("long") * SECOND + (F.extract(F.lit("SECOND"), gap) * SECOND).cast("long")


def with_history(df: DataFrame, at: str, span: int, width: int) -> DataFrame:
    """Give every time slice the rows of the ``span`` before it.

    ``at``, ``span`` and ``width`` are microseconds. Adds ``slice`` (the slice a copy serves) and
    ``own`` (whether the row belongs to that slice); rows near a slice end appear once more.
    """
    home = F.floor(F.col(at) / width).cast("long")
    last = F.floor((F.col(at) + span) / width).cast("long")
    return (
        df.withColumn("_home", home)
        .withColumn("slice", F.explode(F.sequence(F.col("_home"), last)))
        .withColumn("own", F.col("slice") == F.col("_home"))
        .drop("_home")
    )


def trailing(keys: Sequence[str], at: str, span: int):
    """Range frame over the ``span`` microseconds up to and including the row, inside one slice."""
    return Window.partitionBy(*keys, "slice").orderBy(at).rangeBetween(-span, 0)


def islands(points: DataFrame, keys: Sequence[str], step: str, slice_steps: int = 5760) -> DataFrame:
    """Runs of consecutive step numbers per key: ``(*keys, first_step, last_step)``.

    ``points`` has one row per key and step. Runs are found inside slices of ``slice_steps`` steps
    first; the second pass over the far fewer runs joins those that meet at a slice border.
    """
    keys = list(keys)
    sliced = points.withColumn("_slice", F.floor(F.col(step) / slice_steps))
    local = Window.partitionBy(*keys, "_slice").orderBy(step)
    runs = (
        sliced.withColumn("_run", F.col(step) - F.row_number().over(local))
        .groupBy(*keys, "_slice", "_run")
        .agg(F.min(step).alias("_first"), F.max(step).alias("_last"))
    )
    order = Window.partitionBy(*keys).orderBy("_first")
    starts = (F.coalesce(F.lag("_last").over(order) + 1, F.lit(-1)) != F.col("_first")).cast("int")
    return (
        runs.withColumn("_starts", starts)
        .withColumn("_island", F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_island")
        .agg(F.min("_first").alias("first_step"), F.max("_last").alias("last_step"))
        .drop("_island")
    )
