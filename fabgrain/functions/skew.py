"""Joining a small summary to many rows without trusting either its size or the key distribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from fabgrain.session import durable


def keep(df: DataFrame) -> DataFrame:
    """Store a per-group summary that several later steps read, so that it is computed once.

    A checkpoint outlives executors and, unlike a cached plan, is never mistaken for a later state of
    the same files.
    """
    return durable(df)


def attach(rows: DataFrame, summary: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join ``summary`` (one row per key) to ``rows``; ``how`` is "left" or "inner".

    Spark broadcasts the summary where its bytes are within ``spark.sql.autoBroadcastJoinThreshold``, as it knows them from
    files or from the shuffle. Otherwise both sides are shuffled, and the adaptive skew join splits the rows of a hot
    key, or of none, over several tasks. A summary made by grouping on the same keys should be stored with
    :func:`keep` before: read from files, it leaves both sides of the join free to be split.
    """
    return rows.join(summary, list(on), how)
