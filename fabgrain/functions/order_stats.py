"""Exact order statistics per group, also for groups far larger than one task can sort."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabgrain.functions.skew import attach, keep

# Up to this many rows a group is sorted or counted within one task.
HOT_ROWS = 1_000_000
# Cuts that a larger group's value range gets per pass.
FANOUT = 32


def present(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys and value only, without rows lacking either."""
    named = rows.select(*keys, F.col(value).alias("_v"))
    return named.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*keys, "_v"]]))


def has_hot_group(rows: DataFrame, keys: Sequence[str], hot_rows: int) -> bool:
    """Whether some group exceeds ``hot_rows`` rows.

    A table within the limit, which its file footers tell, needs no look at its groups. Otherwise
    rows are counted per group, combined on the map side, and the largest count reaches the driver.
    """
    if rows.count() <= hot_rows:
        return False
    return (rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) > hot_rows


def order_statistics(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: Callable[[Column], Column],
    hot_rows: int = HOT_ROWS,
    fanout: int = FANOUT,
) -> DataFrame:
    """Values at given 0-based ascending ranks of each group: ``(*keys, n, rank, value)``.

    ``ranks`` maps the group size column to an array of distinct ranks. Groups within ``hot_rows``
    are sorted and numbered. Larger ones go through :func:`_narrowed`, which never sorts or shuffles
    them whole. The limit is the same for tables of any size.
    """
    keys = list(keys)
    vals = present(rows, keys, value)
    groups = keep(
        vals.groupBy(*keys)
        .agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        .withColumn("ranks", ranks(F.col("n")))
    )
    large = groups.where(F.col("n") > hot_rows)
    if large.isEmpty():
        return _numbered(vals, groups, keys)
    names = large.select(*keys)  # stored, so its bytes decide whether it is broadcast
    found = [
        _numbered(vals.join(names, keys, "left_anti"), groups.where(F.col("n") <= hot_rows), keys),
        large.where("lo = hi").select(*keys, "n", F.explode("ranks").alias("rank"), F.col("lo").alias("value")),
        _narrowed(vals, large.where("lo < hi"), keys, hot_rows, fanout),
    ]
    return reduce(DataFrame.unionByName, found)


def _numbered(vals: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted ranks of groups small enough to sort."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_v")).cast("long") - 1
    placed = vals.withColumn("rank", place).join(groups.select(*keys, "n", "ranks"), keys)
    return placed.where(F.array_contains("ranks", F.col("rank"))).select(*keys, "n", "rank", F.col("_v").alias("value"))


def _narrowed(vals: DataFrame, groups: DataFrame, keys: list[str], hot_rows: int, fanout: int) -> DataFrame:
    """Wanted ranks of large groups, by closing in on the values.

    Each pass cuts the value ranges that hold wanted ranks at about ``fanout`` values that occur, evenly spread by rank;
    a value that is cut at is a part of its own. Rows are counted per part (combined on the map side), and the parts
    that still hold a wanted rank are kept, until a part has at most ``hot_rows`` rows or a single value. Only
    rows of these last parts are shuffled and sorted. Cuts at ranks work alike for any values, infinite ones too.
    """
    slot = [*keys, "slot"]
    zero = F.lit(0).cast("long")
    ranges = groups.select(*keys, F.lit(0).alias("slot"), "n", F.col("n").alias("size"), zero.alias("before"), "lo", "hi", "ranks")
    vals = attach(vals, ranges.select(*slot), keys, "inner")
    shares = [i / fanout for i in range(fanout + 1)]
    size = None
    while (left := ranges.where("lo < hi").agg(F.max("size")).first()[0] or 0) > hot_rows:
        if size is not None and left >= size:
            raise RuntimeError(f"a part of {left} rows did not become smaller")
        size = left
        cuts = keep(vals.groupBy(*slot).agg(F.array_distinct(F.percentile_approx("_v", shares, 50 * fanout)).alias("cuts")))
        below_value = F.size(F.filter("cuts", lambda c: c < F.col("_v")))
        part = (2 * below_value + F.array_contains("cuts", F.col("_v")).cast("int")).alias("part")
        parts = attach(vals.select(*slot, "_v"), cuts, slot, "inner").select(*slot, "_v", part)
        counts = parts.groupBy(*slot, "part").agg(F.count("*").alias("size"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        below = F.sum("size").over(Window.partitionBy(*slot).orderBy("part")) - F.col("size")
        wanted = F.filter("ranks", lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("size")))
        number = F.row_number().over(Window.partitionBy(*keys).orderBy("parent", "part"))
        ranges = keep(
            counts.withColumn("below", below)
            .join(ranges.select(*slot, "n", "before", "ranks"), slot)
            .withColumn("before", F.col("before") + F.col("below"))
            .withColumn("ranks", wanted)
            .where(F.size("ranks") > 0)
            .withColumnRenamed("slot", "parent")
            .withColumn("slot", number)
        )
        path = ranges.select(*keys, F.col("parent").alias("_parent"), "part", "slot", "lo", "hi")
        vals = attach(parts.withColumnRenamed("slot", "_parent"), path, [*keys, "_parent", "part"], "inner").drop("_parent", "part")

    counted = vals.groupBy(*slot, "_v").agg(F.count("*").alias("copies"))
    upto = F.sum("copies").over(Window.partitionBy(*slot).orderBy("_v")) + F.col("before")
    last = F.col("upto") - 1
    single = F.when(F.array_contains("ranks", last), F.array(last)).otherwise(F.array().cast("array<long>"))
    several = F.filter("ranks", lambda r: (r > last - F.col("copies")) & (r <= last))
    hits = F.when(F.col("copies") == 1, single).otherwise(several)
    return (
        counted.join(ranges.select(*slot, "n", "before", "ranks"), slot)
        .withColumn("upto", upto)
        .select(*keys, "n", F.explode(hits).alias("rank"), F.col("_v").alias("value"))
    )


def quantile(p: float, rank: str = "rank", value: str = "value") -> Column:
    """Aggregate giving the linearly interpolated quantile from rows that carry 0-based ``rank`` and
    group size ``n``, provided the rows at both neighbouring ranks are among them."""
    at = (F.col("n") - 1) * F.lit(p)
    low = F.max(F.when(F.col(rank) == F.floor(at), F.col(value)))
    high = F.max(F.when(F.col(rank) == F.ceil(at), F.col(value)))
    return low + (high - low) * F.max(at - F.floor(at))


def neighbour_ranks(probs: Sequence[float]) -> Callable[[Column], Column]:
    """Ranks on both sides of every quantile of a group of ``n`` rows."""
    def around(n: Column) -> Column:
        at = [(n - 1) * F.lit(p) for p in probs]
        return F.array_distinct(F.array(*[f(a).cast("long") for a in at for f in (F.floor, F.ceil)]))

    return around


def quantiles(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    hot_rows: int = HOT_ROWS,
    fanout: int = FANOUT,
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one column per entry of ``probs``; groups may
    be of any size."""
    picked = order_statistics(rows, keys, value, neighbour_ranks(list(probs.values())), hot_rows, fanout)
    return picked.groupBy(*keys).agg(*[quantile(p).alias(name) for name, p in probs.items()])
