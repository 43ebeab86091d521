"""Distributions of values within lots, control limits, and die geometry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fabgrain.functions.order_stats import FANOUT, HOT_ROWS, order_statistics
from fabgrain.functions.skew import attach, keep
from fabgrain.operators.summary import wafer_means, with_keys

LOT_KEYS = ["lot_id", "parameter"]

# Largest group whose distribution is given in full, points of a thinned one, die grid
# size, and wafer radius as a share of the grid.
CDF_FULL_ROWS = 500
CDF_POINTS = 200
GRID = 30
RADIUS_SHARE = 0.45


def cdf_ranks(n: Column) -> Column:
    """0-based ranks shown for a group of ``n`` values: all, or evenly spaced ones from first to last."""
    step = (n - 1) / F.lit(CDF_POINTS - 1.0)
    spaced = F.transform(
        F.sequence(F.lit(0), F.lit(CDF_POINTS - 1)),
        lambda i: F.when(i == CDF_POINTS - 1, n - 1).otherwise(F.floor(i * step)).cast("long"),
    )
    return F.when(n <= CDF_FULL_ROWS, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(spaced)


def empirical_cdf(df: DataFrame, keys: Sequence[str] = tuple(LOT_KEYS), hot_rows: int = HOT_ROWS, fanout: int = FANOUT) -> DataFrame:
    """Points ``(point, x, y)`` of the empirical distribution per lot and parameter.

    ``y`` rises evenly from 0 to 1 over the shown points; a single value has y 0.
    """
    keys = list(keys)
    shown = order_statistics(df, keys, "value", cdf_ranks, hot_rows, fanout)
    n, points = F.col("n"), F.when(F.col("n") <= CDF_FULL_ROWS, F.col("n")).otherwise(CDF_POINTS)
    point = F.when(n <= CDF_FULL_ROWS, F.col("rank")).otherwise(F.array_position(cdf_ranks(n), F.col("rank")) - 1)
    y = F.when(points == 1, 0.0).when(F.col("point") == points - 1, 1.0).otherwise(F.col("point") * (F.lit(1.0) / (points - 1)))
    return shown.withColumn("point", point).select(*keys, "point", F.col("value").alias("x"), y.alias("y"))


def histogram(df: DataFrame, bins: int = 20, keys: Sequence[str] = tuple(LOT_KEYS)) -> DataFrame:
    """Row count per equal-width bin from a group's minimum to its maximum.

    The maximum falls in the last bin; equal values all fall in bin 1. Empty bins have no row.
    """
    keys = list(keys)
    rows = with_keys(df, [*keys, "value"]).select(*keys, "value")
    limits = keep(rows.groupBy(*keys).agg(F.min("value").alias("low"), F.max("value").alias("high")))
    width = F.col("high") - F.col("low")
    bin_no = F.when(width == 0, 1).otherwise(F.least(F.lit(bins), F.floor((F.col("value") - F.col("low")) / width * bins) + 1))
    counted = attach(rows, limits, keys).withColumn("bin", bin_no.cast("int")).groupBy(*keys, "bin")
    edge = F.col("low") + width / bins * (F.col("bin") - 1)
    return counted.agg(F.count("*").alias("rows"), F.min("low").alias("low"), F.min("high").alias("high")).select(
        *keys, "bin", edge.alias("bin_low"), (edge + width / bins).alias("bin_high"), "rows"
    )


def control_chart(df: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """Wafer means with centre line, control limits and a flag for means outside them."""
    means = keep(wafer_means(df))
    lines = means.groupBy(*LOT_KEYS).agg(
        F.avg("mean_value").alias("centre"), F.stddev_samp("mean_value").alias("_sigma")
    )
    off = F.lit(sigmas) * F.col("_sigma")
    return (
        attach(means, lines, LOT_KEYS)
        .withColumn("lower_limit", F.col("centre") - off)
        .withColumn("upper_limit", F.col("centre") + off)
        .withColumn("out_of_control", ~F.col("mean_value").between(F.col("lower_limit"), F.col("upper_limit")))
        .drop("_sigma")
    )


def range_violations(df: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows outside the limits ``(parameter, low, high)`` of their parameter."""
    return attach(df, limits, ["parameter"], "inner").where(~F.col("value").between(F.col("low"), F.col("high")))


def across_parameters(df: DataFrame, parameters: Sequence[str]) -> DataFrame:
    """One row per wafer with the mean of each named parameter as a column ``mean_<parameter>``."""
    means = [F.avg(F.when(F.col("parameter") == p, F.col("value"))).alias(f"mean_{p}") for p in parameters]
    return with_keys(df, ["lot_id", "wafer_id"]).groupBy("lot_id", "wafer_id").agg(*means)


def centre_distance(grid: int = GRID) -> Column:
    """Distance of die (x, y) from the wafer centre, in dies."""
    centre = (grid + 1) / 2
    return F.sqrt(F.pow(F.col("x") - centre, F.lit(2)) + F.pow(F.col("y") - centre, F.lit(2)))


def die_grid(spark: SparkSession, grid: int = GRID) -> DataFrame:
    """Dies on the wafer: those of the grid within the wafer radius."""
    place = F.col("id")
    dies = spark.range(grid * grid).select(
        (place % grid + 1).alias("x"), (F.floor(place / grid) + 1).alias("y")
    )
    return dies.withColumn("distance", centre_distance(grid)).where(F.col("distance") <= RADIUS_SHARE * grid)


def die_coverage(df: DataFrame, grid: int = GRID) -> DataFrame:
    """Per wafer and parameter: measured dies on the wafer, dies expected there, missing ones, and
    measured positions off the wafer.

    Distinct positions are counted, and the grid joins by position, so nothing pairs every wafer
    with every die.
    """
    keys = ["lot_id", "wafer_id", "parameter"]
    spots = with_keys(df, [*keys, "x", "y"]).select(*keys, "x", "y").distinct()
    on_wafer = centre_distance(grid) <= RADIUS_SHARE * grid
    on_grid = F.col("x").between(1, grid) & F.col("y").between(1, grid)
    expected = die_grid(df.sparkSession, grid).agg(F.count("*").alias("n")).scalar()
    counted = spots.groupBy(*keys).agg(
        F.count_if(on_wafer & on_grid).alias("measured_dies"), F.count_if(~(on_wafer & on_grid)).alias("off_wafer")
    )
    return counted.withColumn("expected_dies", expected).withColumn(
        "missing_dies", F.col("expected_dies") - F.col("measured_dies")
    )


WORD_BITS = 64


def _on_wafer(grid: int) -> list[int]:
    """Places of the grid, row by row from 0, that lie on the wafer."""
    centre, reach = (grid - 1) / 2, (RADIUS_SHARE * grid) ** 2
    return [p for p in range(grid * grid) if (p % grid - centre) ** 2 + (p // grid - centre) ** 2 <= reach]


def _words(places: list[int], grid: int) -> list[int]:
    """A bitmap of the grid as signed 64-bit words."""
    words = [0] * -(-grid * grid // WORD_BITS)
    for p in places:
        words[p // WORD_BITS] |= 1 << p % WORD_BITS
    return [w - (1 << WORD_BITS) if w >> WORD_BITS - 1 else w for w in words]


def coverage_bitmaps(df: DataFrame, grid: int = GRID) -> DataFrame:
    """Per wafer and parameter one bitmap of the measured places, ``places``, and the rows that lie ``beyond`` the grid.

    The state is of fixed size (15 words for a grid of 30), whatever the number of rows, and bitmaps of parts can be merged.
    """
    keys = ["lot_id", "wafer_id", "parameter"]
    on_grid = F.col("x").between(1, grid) & F.col("y").between(1, grid)
    place = F.when(on_grid, (F.col("y") - 1) * grid + F.col("x") - 1).cast("int")
    rows = with_keys(df, [*keys, "x", "y"]).select(*keys, F.floor(place / WORD_BITS).cast("int").alias("_word"),
                                                   F.call_function("shiftleft", F.lit(1).cast("long"), (place % WORD_BITS)).alias("_bit"))
    words = [F.coalesce(F.bit_or(F.when(F.col("_word") == i, F.col("_bit"))), F.lit(0).cast("long")) for i in range(-(-grid * grid // WORD_BITS))]
    return rows.groupBy(*keys).agg(F.array(*words).alias("places"), F.count_if(F.col("_word").isNull()).alias("beyond"))


def merge_bitmaps(parts: DataFrame, grid: int = GRID) -> DataFrame:
    """One bitmap per wafer and parameter from those of any number of parts."""
    words = [F.bit_or(F.get("places", F.lit(i))) for i in range(-(-grid * grid // WORD_BITS))]
    return parts.groupBy("lot_id", "wafer_id", "parameter").agg(F.array(*words).alias("places"), F.sum("beyond").alias("beyond"))


def bitmap_coverage(bitmaps: DataFrame, grid: int = GRID) -> DataFrame:
    """:func:`die_coverage` from bitmaps; rows beyond the grid are counted as rows, not as positions."""
    places = _on_wafer(grid)
    wafer = F.lit(_words(places, grid))

    def bits(words: Column) -> Column:
        return F.aggregate(F.transform(words, lambda w: F.bit_count(w)), F.lit(0), lambda s, n: s + n).cast("long")

    inside = F.zip_with("places", wafer, lambda a, b: a.bitwiseAND(b))
    outside = F.zip_with("places", wafer, lambda a, b: a.bitwiseAND(F.bitwise_not(b)))
    counted = bitmaps.select("lot_id", "wafer_id", "parameter", bits(inside).alias("measured_dies"), (bits(outside) + F.col("beyond")).alias("off_wafer"))
    return counted.withColumn("expected_dies", F.lit(len(places)).cast("long")).withColumn("missing_dies", F.col("expected_dies") - F.col("measured_dies"))


def bitmap_gaps(bitmaps: DataFrame, grid: int = GRID) -> DataFrame:
    """:func:`missing_dies` from bitmaps: the wafer's places whose bit is not set."""
    gone = F.filter(F.lit(_on_wafer(grid)), lambda p: F.call_function("getbit", F.get("places", F.floor(p / WORD_BITS).cast("int")), p % WORD_BITS) == 0)
    missing = bitmaps.select("lot_id", "wafer_id", "parameter", F.explode(gone).alias("_place"))
    return missing.select("lot_id", "wafer_id", "parameter", (F.col("_place") % grid + 1).cast("long").alias("x"), (F.floor(F.col("_place") / grid) + 1).cast("long").alias("y"))


# Size of a quantile sketch, and its rank error for that size: at most this share of a group's rows, in 99 of 100 cases.
SKETCH_SIZE = 400
SKETCH_ERROR = 0.0075


def wafer_sketches(df: DataFrame, size: int = SKETCH_SIZE) -> DataFrame:
    """Count, extremes and a quantile sketch per wafer and parameter; stored, they answer for any grouping of wafers."""
    keys = ["lot_id", "wafer_id", "parameter"]
    return with_keys(df, [*keys, "value"]).groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.kll_sketch_agg_double("value", F.lit(size)).alias("sketch"))


def roll_up(sketches: DataFrame, keys: Sequence[str], size: int = SKETCH_SIZE) -> DataFrame:
    """The sketches of coarser groups, merged from those of finer ones."""
    return sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"))


def sketched_quantiles(sketches: DataFrame, shares: Sequence[float]) -> DataFrame:
    """Values ``(share, value)`` below which about that share of a group's rows lie, without another look at the rows."""
    points = F.array(*[F.struct(F.lit(q).alias("share"), F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias("value")) for q in shares])
    kept = [c for c in sketches.columns if c != "sketch"]
    return sketches.select(*kept, F.inline(points))


def missing_dies(df: DataFrame, grid: int = GRID) -> DataFrame:
    """Positions on the wafer that a wafer and parameter has no row for.

    The places of a wafer are one set, of at most the grid's size; what the grid has beyond it is unfolded.
    """
    keys = ["lot_id", "wafer_id", "parameter"]
    on_grid = F.col("x").between(1, grid) & F.col("y").between(1, grid)
    place = ((F.col("y") - 1) * grid + F.col("x") - 1).cast("int")
    measured = with_keys(df, [*keys, "x", "y"]).groupBy(*keys).agg(F.collect_set(F.when(on_grid, place)).alias("_places"))
    missing = measured.select(*keys, F.explode(F.array_except(F.lit(_on_wafer(grid)), "_places")).alias("_place"))
    return missing.select(*keys, (F.col("_place") % grid + 1).cast("long").alias("x"), (F.floor(F.col("_place") / grid) + 1).cast("long").alias("y"))
