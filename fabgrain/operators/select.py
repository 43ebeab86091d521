"""Selection, derived columns, ordering and paging of measurement rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabgrain.functions.rank_select import FEW_ROWS, Keys, start_of
from fabgrain.functions.skew import attach
from fabgrain.sources.measurements import DIE_KEYS, WAFER_KEYS, Measurements

# Yield limit, report columns and page size, number of heat colours.
LOW_YIELD = 96.5
REPORT_COLUMNS = ["product_id", "lot_id", "wafer_id", "parameter", "x", "y", "value"]
PAGE_ROWS = 100
HEAT_LEVELS = 11
# Heat colours from lowest to highest.
HEAT_COLOURS = [
    "#313695", "#4575b4", "#74add1", "#abd9e9", "#e0f3f8", "#ffffbf",
    "#fee090", "#fdae61", "#f46d43", "#d73027", "#a50026",
]

# A page reaching further than this into the order is not gathered by one top-k.
SHALLOW_ROWS = 100_000


def one_wafer(m: Measurements, lot_id: str, wafer_id: str, parameter: str = "Thickness") -> DataFrame:
    """Rows of one lot, wafer and parameter."""
    return m.where(lot_id=lot_id, wafer_id=wafer_id, parameter=parameter).frame()


def optional_filters(
    m: Measurements, product_id: str | None = None, lot_id: str | None = None, wafer_id: str | None = None
) -> Measurements:
    """Filter by whichever values are given; None and "" filter nothing."""
    return m.where(product_id=product_id, lot_id=lot_id, wafer_id=wafer_id)


def report_columns(df: DataFrame) -> DataFrame:
    """The report columns; the product is left out where the table has none."""
    return df.select(*[c for c in REPORT_COLUMNS if c in df.columns])


def wafer_like_typed(m: Measurements, typed: str) -> Measurements:
    """Filter by a wafer id typed in any case; the stored column stays bare for pushdown."""
    return m.where(wafer_id=typed.upper())


def yield_status(column: str = "yield", threshold: float = LOW_YIELD) -> Column:
    """"low" strictly below the threshold, otherwise "ok"; a missing yield counts as 100, as in the diagnosis."""
    return F.when(F.col(column) < threshold, "low").otherwise("ok")


def zero_based(df: DataFrame) -> DataFrame:
    """Die coordinates counted from 0."""
    return df.withColumns({"x": F.col("x") - 1, "y": F.col("y") - 1})


def heat_levels(df: DataFrame, keys: Sequence[str] = tuple(WAFER_KEYS)) -> DataFrame:
    """Place each value between its wafer's extremes on the colour scale.

    Adds ``level`` (0 to 10) and ``colour``; a wafer of equal values has level 0. One scan and one shuffle: the extremes
    are taken over the wafer's rows where they lie together.
    """
    whole = Window.partitionBy(*keys)
    limits = df.withColumns({"_low": F.min("value").over(whole), "_high": F.max("value").over(whole)})
    share = (F.col("value") - F.col("_low")) / (F.col("_high") - F.col("_low"))
    level = F.when(F.col("_high") == F.col("_low"), 0).otherwise(
        F.least(F.lit(HEAT_LEVELS - 1), F.floor(share * HEAT_LEVELS))
    )
    colours = F.array(*[F.lit(c) for c in HEAT_COLOURS])
    return (
        limits.withColumn("level", level.cast("int"))
        .withColumn("colour", F.get(colours, F.col("level")))
        .drop("_low", "_high")
    )


def sort_keys(df: DataFrame, sort_by: str = "wafer_id", direction: str = "asc", tie: Sequence[str] = tuple(DIE_KEYS)) -> list[tuple[str, bool]]:
    """Sort columns and whether they ascend: one column, made total by ``tie``.

    An unknown column orders by ``tie`` alone; any direction but "asc" means descending.
    """
    first = [(sort_by, direction == "asc")] if sort_by in df.columns else []
    return first + [(c, True) for c in tie if c != sort_by and c in df.columns]


def ordering(keys: Keys) -> list[Column]:
    """The sort columns with missing values last both ways."""
    return [F.col(c).asc_nulls_last() if ascending else F.col(c).desc_nulls_last() for c, ascending in keys]


def sort_order(df: DataFrame, sort_by: str = "wafer_id", direction: str = "asc", tie: Sequence[str] = tuple(DIE_KEYS)) -> list[Column]:
    """The ordering of :func:`sort_keys`."""
    return ordering(sort_keys(df, sort_by, direction, tie))


def sort_rows(df: DataFrame, sort_by: str = "wafer_id", direction: str = "asc", tie: Sequence[str] = tuple(DIE_KEYS)) -> DataFrame:
    """All rows in the order of :func:`sort_order`; copies of one row spread by their source partition."""
    order = sort_order(df, sort_by, direction, tie)
    return df.withColumn("_part", F.spark_partition_id()).orderBy(*order, "_part").drop("_part")


def page(df: DataFrame, keys: Keys, number: int = 1, limit: int = PAGE_ROWS, shallow_rows: int = SHALLOW_ROWS) -> DataFrame:
    """Rows ``[(number-1)*limit, number*limit)`` of the table ordered by ``keys``, as :func:`sort_keys` gives them.

    Pages near the front are one top-k. Deeper pages go through :func:`deep_page`.
    """
    if number < 1 or limit < 1:
        raise ValueError("page number and limit count from 1")
    if number * limit <= shallow_rows:
        return df.orderBy(*ordering(keys)).offset((number - 1) * limit).limit(limit)
    return deep_page(df, keys, (number - 1) * limit, limit)


def page_of(
    m: Measurements, number: int = 1, limit: int = PAGE_ROWS, sort_by: str = "wafer_id", direction: str = "asc",
    tie: Sequence[str] = tuple(DIE_KEYS), shallow_rows: int = SHALLOW_ROWS,
) -> DataFrame:
    """One page of measurements; a product kept per lot joins the rows of the page, unless the order needs it."""
    late = m.lots is not None and sort_by != "product_id"
    rows = m.frame(*[c for c in m.available() if not (late and c == "product_id")])
    keys = sort_keys(rows, sort_by, direction, tie)
    chosen = page(rows, keys, number, limit, shallow_rows)
    return attach(chosen, m.lots, ["lot_id"]).orderBy(*ordering(keys)) if late else chosen


def deep_page(df: DataFrame, keys: Keys, start: int, limit: int, few_rows: int = FEW_ROWS) -> DataFrame:
    """``limit`` rows from the 0-based rank ``start`` on, at about the same cost for any rank.

    The place of the first row is found by counting ranges of the sort columns (:func:`fabgrain.functions.rank_select.start_of`);
    one top-k over the rows from there on gives the page. Rows with equal keys are told apart by a hash of the whole row, so
    that pages neither overlap nor skip; which of several equal rows a page shows does not matter.
    """
    own = "_row"
    while own in df.columns:
        own += "_"
    hashed = df.withColumn(own, F.xxhash64(*df.columns))
    full = [*keys, (own, True)]
    found = start_of(hashed, full, start, few_rows)
    if found.same is None:
        return found.rows.orderBy(*ordering(full)).offset(found.skip).limit(limit).drop(own)
    equal = max(0, min(limit, found.n_same - found.skip))
    both = found.same.limit(equal).unionByName(found.rows.orderBy(*ordering(full)).limit(limit - equal))
    return both.orderBy(*ordering(full)).drop(own)


def page_after(df: DataFrame, columns: Sequence[str], last: Sequence, limit: int = PAGE_ROWS) -> DataFrame:
    """The next rows after a known last row, ascending over non-null ``columns``.

    Costs the same at any depth, and the leading comparison is pushed to the scan.
    """
    after, equal = F.lit(False), F.lit(True)
    for column, value in zip(columns, last):
        after = after | (equal & (F.col(column) > F.lit(value)))
        equal = equal & (F.col(column) == F.lit(value))
    rest = df.where(F.col(columns[0]) >= F.lit(last[0])).where(after)
    return rest.orderBy(*columns).limit(limit)


def report(
    m: Measurements,
    number: int = 1,
    limit: int = PAGE_ROWS,
    product_id: str | None = None,
    lot_id: str | None = None,
    wafer_id: str | None = None,
    sort_by: str = "wafer_id",
    direction: str = "asc",
    tie: Sequence[str] = tuple(DIE_KEYS),
) -> DataFrame:
    """One page of filtered, sorted rows with ``total``, ``page`` and ``page_limit`` on each row.

    A page without rows is one row of these three, with NULL in all other columns.
    """
    kept = optional_filters(m, product_id, lot_id, wafer_id)
    total = kept.frame("lot_id").agg(F.count("*").alias("total"))
    chosen = report_columns(page_of(kept, number, limit, sort_by, direction, tie))
    envelope = [F.lit(number).alias("page"), F.lit(limit).alias("page_limit")]
    none = [F.lit(None).cast(t).alias(c) for c, t in chosen.dtypes]
    empty = total.where(F.col("total") <= (number - 1) * limit).select(*none, "total", *envelope)
    return chosen.select("*", total.scalar().alias("total"), *envelope).unionByName(empty)


def page_links(total: DataFrame, limit: int = PAGE_ROWS) -> DataFrame:
    """Every page of a result of ``total`` rows: its row count and whether a page lies before and after it.

    ``total`` is a one-row frame; an empty result has the single empty page 1.
    """
    rows = total.first()["total"]
    number = F.col("page")
    return total.sparkSession.range(1, max(1, -(-rows // limit)) + 1).select(F.col("id").alias("page")).select(
        "page",
        F.least(F.lit(limit), F.lit(rows) - (number - 1) * limit).cast("long").alias("page_rows"),
        (number > 1).alias("has_previous"),
        (number * limit < F.lit(rows)).alias("has_next"),
    )


def top_lots(lots: DataFrame, n: int = 25, natural: bool = False) -> DataFrame:
    """The last ``n`` lots by id, descending as text; ``natural`` compares their numbers instead."""
    number = F.regexp_extract("lot_id", r"(\d+)$", 1).try_cast("long")
    order = [number.desc_nulls_last()] if natural else []
    return lots.orderBy(*order, F.col("lot_id").desc_nulls_last()).limit(n)


def ordered_wafers(df: DataFrame) -> DataFrame:
    """Wafers of every lot in order of their ids."""
    return df.select("lot_id", "wafer_id").dropna().distinct().orderBy("lot_id", "wafer_id")
