"""Where a rank of an ordered table lies, found by counting; nothing is sorted, shuffled whole or written."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sort columns with their direction; missing values come last both ways.
Keys = Sequence[tuple[str, bool]]
#: Values a round cuts a range at, and rows of a range that is not cut further.
CUTS, FEW_ROWS = 32, 10_000


class Start(NamedTuple):
    """All rows from a place of the order on, and how many of them lie before the wanted rank.

    Where that place is among more than a few rows that are equal in all keys, those are ``same``, their number is ``n_same``,
    and ``rows`` has the ones after them.
    """

    rows: DataFrame
    skip: int
    same: DataFrame | None = None
    n_same: int = 0


def _after(column: str, value, ascending: bool, equal: bool = False) -> Column:
    """Rows that come after ``value``, or are it too; missing values come after all."""
    c, v = F.col(column), F.lit(value)
    later = (c >= v if equal else c > v) if ascending else (c <= v if equal else c < v)
    return later | c.isNull()


def _upto(column: str, value, ascending: bool) -> Column:
    return F.col(column) <= F.lit(value) if ascending else F.col(column) >= F.lit(value)


def _sample(rows: DataFrame, column: str, n: int) -> list:
    """Up to ``n`` different values of a column, those of smallest hash under ``n`` hashes: frequent ones count once."""
    picked = rows.agg(*[F.min_by(column, F.xxhash64(F.lit(i), column)).alias(f"v{i}") for i in range(n)]).first()
    return list({v for v in picked if v is not None})


def start_of(df: DataFrame, keys: Keys, rank: int, few_rows: int = FEW_ROWS, cuts: int = CUTS) -> Start:
    """The rows from a place at most ``few_rows`` before the 0-based ``rank`` on, in the order of ``keys``.

    Key by key, the range of values that holds the rank is cut at some of its own values and the rows between them are counted,
    until few rows are left or all have one value; then the next key tells rows of that value apart. Every round is two scans
    of the range, with filters that reach the files, and returns one row per cut.
    """
    equal, later = F.lit(True), F.lit(False)  # rows like the prefix found so far; rows that come after all of those
    for column, ascending in keys:
        rows = df.where(equal)
        present = rows.agg(F.count(column).alias("n"), F.count("*").alias("all")).first()
        if rank >= present["all"]:
            return Start(df.where(F.lit(False)), 0)
        if present["all"] <= few_rows:
            break
        if rank >= present["n"]:  # the rank lies among the missing values
            rank -= present["n"]
            equal = equal & F.col(column).isNull()
            continue
        within, low = F.col(column).isNotNull(), None
        while True:
            ranged = rows.where(within)
            # the number of cuts that come before a value, so that a cut is the last value of its part
            # the first value is a cut too, so that every round after the first makes the range smaller
            values = _sample(ranged, column, cuts) + ([] if low is None else [low])
            part = sum((_cut_before(column, v, ascending) for v in values), F.lit(0))
            counted = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min(column).alias("least"), F.max(column).alias("most")).collect()
            before = 0
            for r in sorted(counted, key=lambda r: r["part"]):
                if rank < before + r["n"]:
                    break
                before += r["n"]
            rank -= before
            first, last = (r["least"], r["most"]) if ascending else (r["most"], r["least"])
            low = first
            one_value = first == last or (first != first and last != last)  # NaN is one value too
            if r["n"] <= few_rows or one_value:
                break
            within = _after(column, first, ascending, equal=True) & _upto(column, last, ascending) & F.col(column).isNotNull()
        if r["n"] <= few_rows:
            later = later | (equal & _after(column, low, ascending, equal=True))
            return Start(df.where(later), rank)
        later = later | (equal & _after(column, low, ascending))
        equal = equal & (F.col(column) == F.lit(low))
    else:
        same = df.where(equal)
        return Start(df.where(later), rank, same, same.count())
    return Start(df.where(later | equal), rank)


def _cut_before(column: str, value, ascending: bool) -> Column:
    c, v = F.col(column), F.lit(value)
    return (c > v if ascending else c < v).cast("int")
