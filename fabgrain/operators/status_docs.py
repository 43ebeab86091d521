"""Status sentences per wafer and the questions answered from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabgrain.operators.select import LOW_YIELD

# Fixed value: the status sentence. Numbers are rounded half up from their decimal text.
SENTENCE = "Wafer %s in Lot %s status for %s: Average is %s, Std Dev is %s, Yield is %s%%."


def _number(column: str, digits: int) -> Column:
    return F.when(F.col(column).isNull(), "nan").otherwise(F.format_string(f"%.{digits}f", F.col(column)))


def doc_id() -> Column:
    """Id of a status document: lot, wafer and parameter."""
    return F.concat_ws("_", "lot_id", "wafer_id", "parameter")


def status_documents(summary: DataFrame) -> DataFrame:
    """One document per summary row: ``(id, document, metadata)``."""
    text = F.format_string(
        SENTENCE, "wafer_id", "lot_id", "parameter", _number("mean", 4), _number("std", 4), _number("yield", 2)
    )
    metadata = F.struct("lot_id", "wafer_id", "parameter", "mean", "std", "yield")
    return summary.select(doc_id().alias("id"), text.alias("document"), metadata.alias("metadata"))


def wafer_status(summary: DataFrame, wafer_id: str, lot_id: str | None = None) -> DataFrame:
    """Summary rows of one wafer, in one lot or in all; the filter is pushed below the grouping."""
    found = summary.where(F.col("wafer_id") == wafer_id)
    return found.where(F.col("lot_id") == lot_id) if lot_id else found


def low_yield_wafers(summary: DataFrame, lot_id: str | None = None, threshold: float = LOW_YIELD) -> DataFrame:
    """Wafers and parameters with yield below the threshold, lowest first; a missing yield counts as 100."""
    rows = summary.where(F.col("lot_id") == lot_id) if lot_id else summary
    low = rows.where(F.coalesce("yield", F.lit(100.0)) < threshold)
    return low.select("lot_id", "wafer_id", "parameter", "yield", "std").orderBy("lot_id", "yield", "wafer_id", "parameter")


def lot_verdicts(summary: DataFrame, threshold: float = LOW_YIELD) -> DataFrame:
    """Per lot: low-yield entries, the parameter with most of them, and "low" or "good"."""
    low = F.coalesce("yield", F.lit(100.0)) < threshold
    per_parameter = summary.groupBy("lot_id", "parameter").agg(F.count_if(low).alias("low_entries"))
    worst = F.min_by("parameter", F.struct(-F.col("low_entries"), F.col("parameter")))
    return (
        per_parameter.groupBy("lot_id")
        .agg(F.sum("low_entries").alias("low_entries"), worst.alias("worst_parameter"))
        .withColumn("verdict", F.when(F.col("low_entries") > 0, "low").otherwise("good"))
        .withColumn("worst_parameter", F.when(F.col("low_entries") > 0, F.col("worst_parameter")))
    )
