"""Connected components of an edge table, by rounds of stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabgrain.session import discard, durable


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).head())


def _least(pairs: DataFrame) -> DataFrame:
    """Per centre ``u``, as ``m``, the smallest of it and its neighbours ``v``; stored, so that Spark can split a join with it."""
    return durable(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))


def _star(pairs: DataFrame, least: DataFrame | None = None) -> DataFrame:
    """Per centre ``u``, edges from its neighbours ``v`` to the smallest of them all.

    The smallest ones are stored, so that Spark can split the join where one centre has very many neighbours.
    """
    return pairs.join(_least(pairs) if least is None else least, "u")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) for every node of ``edges`` (columns ``a``, ``b``).

    Each round links all larger neighbours of a node to its smallest neighbour, and then all smaller ones, until nothing
    changes; then every edge leads to the root. A node with many neighbours is only ever aggregated and joined by key.
    Edges are stored after each round, and those of the round before go.
    """
    now = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _signature(now)
    while before[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least_up = _least(both)
        large = durable(_star(both, least_up).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least_down = _least(large)
        down = _star(large, least_down)
        small = down.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(down.select(F.col("u").alias("a"), F.col("m").alias("b")))
        old, now = now, durable(small.where("a <> b").distinct())
        discard(old, large, least_up, least_down)
        after = _signature(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
