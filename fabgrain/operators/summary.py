"""Catalogues, wafer and lot summaries, yields."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabgrain.functions.order_stats import HOT_ROWS, has_hot_group, quantile, quantiles
from fabgrain.functions.skew import attach, keep
from fabgrain.sources.measurements import WAFER_KEYS

# The catalogue's dimension columns, and quartile positions of the box plot.
DIMENSIONS = {"product": "product_id", "lot": "lot_id", "wafer": "wafer_id", "parameter": "parameter"}
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}

# Yield rule per parameter, (tolerated spread, percent lost per unit beyond it), the
# rule of all other parameters, and the yield range.
SPREAD_RULES = {"Thickness": (1.8, 5.0)}
OTHER_SPREAD_RULE = (1.3, 6.0)
YIELD_RANGE = (85.0, 100.0)


def with_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are all present; a NULL key forms no group."""
    return df.dropna(subset=list(keys))


def catalogue(df: DataFrame, lots: DataFrame | None = None) -> DataFrame:
    """Distinct products, lots, wafers and parameters as rows ``(dimension, id)``, in order.

    Distinct combinations are taken first, so only those are unfolded and not every row. Where ``lots`` (one row per lot)
    has the product, it joins the combinations.
    """
    stored = [c for c in DIMENSIONS.values() if c in df.columns and not (lots is not None and c == "product_id")]
    combinations = df.select(*stored).distinct()
    if lots is not None:
        combinations = attach(combinations, lots.select("lot_id", "product_id"), ["lot_id"])
    present = {name: c for name, c in DIMENSIONS.items() if c in combinations.columns}
    entries = F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(c).alias("id")) for n, c in present.items()])
    return combinations.select(F.inline(entries)).where("id IS NOT NULL").distinct().orderBy("dimension", "id")


def wafer_map(df: DataFrame) -> DataFrame:
    """Cells of every wafer and parameter, one row per die, with the wafer's minimum and maximum; one scan, one shuffle."""
    whole = Window.partitionBy(*WAFER_KEYS)
    rows = with_keys(df, WAFER_KEYS).select(*WAFER_KEYS, "x", "y", "value")
    return rows.withColumns({"min_value": F.min("value").over(whole), "max_value": F.max("value").over(whole)})


WAFER_MEASURES = {
    "avg_value": F.avg, "std_value": F.stddev_samp, "min_value": F.min, "max_value": F.max,
}


def wafer_summary(df: DataFrame) -> DataFrame:
    """Mean, sample spread, minimum and maximum of every wafer and parameter."""
    return with_keys(df, WAFER_KEYS).groupBy(*WAFER_KEYS).agg(*[measure("value").alias(n) for n, measure in WAFER_MEASURES.items()])


def lot_gallery(df: DataFrame) -> DataFrame:
    """:func:`wafer_summary` on every die row, so that a thumbnail needs no second read; one scan, one shuffle."""
    whole = Window.partitionBy(*WAFER_KEYS)
    rows = with_keys(df, WAFER_KEYS).select(*WAFER_KEYS, "x", "y", "value")
    return rows.withColumns({n: measure("value").over(whole) for n, measure in WAFER_MEASURES.items()})


def box_plot(df: DataFrame, keys: Sequence[str] = tuple(WAFER_KEYS), hot_rows: int = HOT_ROWS) -> DataFrame:
    """Minimum, quartiles, maximum and mean per wafer, exact with linear interpolation.

    Usual groups are sorted once and read off by rank. Where some group is too large for one task,
    the quartiles come from :func:`fabgrain.functions.order_stats.quantiles`.
    """
    keys = list(keys)
    rows = with_keys(df.select(*keys, "value"), keys)
    extremes = [F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.avg("value").alias("mean_value")]
    if has_hot_group(df.select(*keys), keys, hot_rows):
        plots = rows.groupBy(*keys).agg(*extremes).join(quantiles(rows, keys, "value", QUARTILES, hot_rows), keys, "left")
    else:
        group = Window.partitionBy(*keys)
        # missing values sort behind all others and are not counted
        place = F.row_number().over(group.orderBy(F.col("value").asc_nulls_last())) - 1
        placed = rows.withColumns({"rank": place, "n": F.count("value").over(group)})
        plots = placed.groupBy(*keys).agg(*extremes, *[quantile(p).alias(name) for name, p in QUARTILES.items()])
    return plots.select(*keys, "min_value", *QUARTILES, "max_value", "mean_value").orderBy(*keys)


def wafer_means(df: DataFrame) -> DataFrame:
    """Mean value of every wafer and parameter."""
    return with_keys(df, WAFER_KEYS).groupBy(*WAFER_KEYS).agg(F.avg("value").alias("mean_value"))


def lot_trend(df: DataFrame) -> DataFrame:
    """Wafer means per lot and parameter in wafer order."""
    return wafer_means(df).orderBy("lot_id", "parameter", "wafer_id")


def trend_extremes(df: DataFrame) -> DataFrame:
    """Wafers of highest and lowest mean per lot and parameter; ties go to the smaller wafer id."""
    mean = F.col("mean_value")
    return wafer_means(df).groupBy("lot_id", "parameter").agg(
        F.min_by("wafer_id", F.struct(-mean, F.col("wafer_id"))).alias("highest_wafer"),
        F.max(mean).alias("highest_mean"),
        F.min_by("wafer_id", F.struct(mean, F.col("wafer_id"))).alias("lowest_wafer"),
        F.min(mean).alias("lowest_mean"),
    )


def mean_of(total: str = "_sum", n: str = "_n") -> Column:
    """Mean from partial sums and counts; NULL without a value."""
    return F.sum(total) / F.nullif(F.sum(n), F.lit(0))


def lot_yield(df: DataFrame, lots: DataFrame | None = None, weighting: str = "die") -> DataFrame:
    """Mean yield of every lot, with its product.

    ``weighting="die"`` averages over rows, ``"wafer"`` over the wafers' own yields. The product
    comes from the rows, or from ``lots`` (one row per lot), which then joins the aggregated lots.
    Rows are first summed per full key, since only numbers aggregate by hashing.
    """
    keys = {"die": ["lot_id"], "wafer": ["lot_id", "wafer_id"]}[weighting]
    product = ["product_id"] if lots is None else []
    sums = with_keys(df, ["lot_id"]).groupBy(*keys, *product).agg(F.sum("yield").alias("_sum"), F.count("yield").alias("_n"))
    named = [F.min("product_id").alias("product_id")] if product else []
    if weighting == "wafer":
        sums = sums.groupBy(*keys).agg(mean_of().alias("_sum"), *named).withColumn("_n", F.col("_sum").isNotNull().cast("int"))
    per_lot = sums.groupBy("lot_id").agg(mean_of().alias("yield"), *named)
    if lots is not None:
        per_lot = per_lot.join(lots.select("lot_id", "product_id"), "lot_id", "left")
    return per_lot.select("lot_id", "yield", "product_id")


def wafer_yield(df: DataFrame, parameter_order: Sequence[str] = ("Thickness", "Resistance")) -> DataFrame:
    """Mean yield of every wafer over its parameters, and the first of these in the given order.

    Rows are first summed per parameter, which leaves few rows for the choice of the parameter.
    """
    known = F.array(*[F.lit(p) for p in parameter_order])
    place = F.array_position(known, F.col("parameter"))
    rank = F.struct(F.when(place > 0, place).otherwise(len(parameter_order) + 1), F.col("parameter"))
    sums = with_keys(df, ["lot_id", "wafer_id"]).groupBy(*WAFER_KEYS).agg(F.sum("yield").alias("_sum"), F.count("yield").alias("_n"))
    return (
        sums.groupBy("lot_id", "wafer_id")
        .agg(mean_of().alias("yield"), F.min_by("parameter", rank).alias("parameter"))
        .orderBy("lot_id", "wafer_id")
    )


def status_summary(df: DataFrame, constant_yield: bool = True) -> DataFrame:
    """Mean, sample spread, extremes and yield of every lot, wafer and parameter.

    A measurement table repeats one yield on all rows of the group; where the rows differ, pass
    ``constant_yield=False`` for their mean.
    """
    chosen = F.max("yield") if constant_yield else F.avg("yield")
    return with_keys(df, WAFER_KEYS).groupBy(*WAFER_KEYS).agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        chosen.alias("yield"),
    )


# Digits after the point that exact sums keep; values stay below 9e9 then.
EXACT_DIGITS = 6


def _whole(column: str) -> Column:
    """A value in units of the last exact digit."""
    return F.rint(F.col(column) * 10**EXACT_DIGITS).cast("decimal(18,0)")


def _mean(total: Column, n: Column) -> Column:
    return (total.cast("decimal(32,0)") * F.lit(f"1e-{EXACT_DIGITS}").cast(f"decimal({EXACT_DIGITS},{EXACT_DIGITS})")).cast("double") / n


def _spread(n: Column, total: Column, squares: Column) -> Column:
    """Sample spread from exact sums: squares are taken around a whole number near the mean, so nothing cancels."""
    near = F.floor(total / n).cast("decimal(18,0)")
    rest = (total - n * near).cast("double")
    around = (squares - 2 * near * total + n * near * near).cast("double")
    return F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), around - rest * rest / n) / (n - 1)) / 10**EXACT_DIGITS)


MOMENTS = {"n": F.sum, "total": F.sum, "squares": F.sum, "low": F.min, "high": F.max, "yields": F.sum, "yield_total": F.sum}


def moments(df: DataFrame) -> DataFrame:
    """Count, exact sums and extremes of every lot, wafer and parameter: all that the status of a wafer needs.

    Values are kept to ``EXACT_DIGITS`` digits, so sums do not depend on any order, and moments of parts add up to those of
    the whole.
    """
    value = _whole("value")
    return with_keys(df, WAFER_KEYS).groupBy(*WAFER_KEYS).agg(
        F.count("value").alias("n"), F.sum(value).alias("total"), F.sum((value * value).cast("decimal(36,0)")).alias("squares"),
        F.min("value").alias("low"), F.max("value").alias("high"), F.count("yield").alias("yields"), F.sum(_whole("yield")).alias("yield_total"))


def merge_moments(parts: DataFrame) -> DataFrame:
    """One row per wafer and parameter from the moments of any number of parts."""
    return parts.groupBy(*WAFER_KEYS).agg(*[merge(c).cast(parts.schema[c].dataType).alias(c) for c, merge in MOMENTS.items()])


def add_part(rows: DataFrame, path: str, part: str) -> None:
    """Store the moments of new rows beside those that are there; adding a part again replaces it."""
    moments(rows).write.mode("overwrite").parquet(f"{path}/part={part}")


def status_from_moments(parts: DataFrame) -> DataFrame:
    """:func:`status_summary` with the mean of the yields, from stored moments alone: no measurement is read."""
    n, total = F.col("n").cast("decimal(18,0)"), F.col("total")
    return merge_moments(parts).select(
        *WAFER_KEYS, _mean(total, F.col("n")).alias("mean"), _spread(n, total, F.col("squares")).alias("std"),
        F.col("low").alias("min"), F.col("high").alias("max"), _mean(F.col("yield_total"), F.col("yields")).alias("yield"))


def row_total(df: DataFrame) -> DataFrame:
    """Number of rows, as column ``total``."""
    return df.agg(F.count("*").alias("total"))


def yield_from_spread(
    df: DataFrame,
    rules: Mapping[str, tuple[float, float]] = SPREAD_RULES,
    other: tuple[float, float] = OTHER_SPREAD_RULE,
) -> DataFrame:
    """Yield a wafer's value spread implies: percent lost beyond the tolerated population spread."""
    def rule(i: int) -> Column:
        chosen = F.lit(other[i])
        for name, pair in rules.items():
            chosen = F.when(F.col("parameter") == name, F.lit(pair[i])).otherwise(chosen)
        return chosen

    low, high = YIELD_RANGE
    lost = F.greatest(F.lit(0.0), (F.col("spread") - rule(0)) * rule(1))
    return (
        with_keys(df, WAFER_KEYS)
        .groupBy(*WAFER_KEYS)
        .agg(F.stddev_pop("value").alias("spread"))
        .withColumn("implied_yield", F.greatest(F.lit(low), F.least(F.lit(high), 100 - lost)))
    )
