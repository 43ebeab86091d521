"""The measurement table, and the mapping of any other table onto its columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fabgrain.functions.skew import attach

# One row per die, wafer and measured parameter.
SCHEMA = T.StructType(
    [
        T.StructField("product_id", T.StringType()),
        T.StructField("lot_id", T.StringType()),
        T.StructField("wafer_id", T.StringType()),
        T.StructField("parameter", T.StringType()),
        T.StructField("x", T.LongType()),
        T.StructField("y", T.LongType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("yield", T.DoubleType()),
    ]
)
COLUMNS = SCHEMA.fieldNames()
WAFER_KEYS = ["lot_id", "wafer_id", "parameter"]
DIE_KEYS = [*WAFER_KEYS, "y", "x"]


def no_nan(column: Column) -> Column:
    """NaN becomes NULL, so that every aggregate skips it."""
    return F.when(~F.isnan(column), column)


@dataclass(frozen=True)
class Measurements:
    """A table read as measurements.

    ``columns`` gives the expression of each measurement column. ``locate`` turns an equality on a
    computed column into a predicate on stored columns, so that the filter reaches the file scan.
    ``lots`` is an optional (``lot_id``, ``product_id``) table where the product is kept per lot;
    ``extra`` names further source columns to carry along, such as a row key.
    """

    source: DataFrame
    columns: Mapping[str, Column]
    locate: Mapping[str, Callable[[str], Column]] = field(default_factory=dict)
    lots: DataFrame | None = None
    extra: tuple[str, ...] = ()

    def where(self, **equal: str | None) -> Measurements:
        """Equality filters on measurement columns; a missing or empty value filters nothing."""
        source, lots, product = self.source, self.lots, None
        for name, value in equal.items():
            if value in (None, ""):
                continue
            if name == "product_id" and lots is not None:
                product = value
            else:
                test = self.locate.get(name, lambda v, c=self.columns[name]: c == F.lit(v))
                source = source.where(test(value))
        kept = replace(self, source=source)
        return kept if product is None else kept._of_product(product)

    def _of_product(self, product: str) -> Measurements:
        """Rows of the product's lots; one join, as the product of the rows left is known."""
        tagged = self.source.withColumn("lot_id", self.columns["lot_id"])
        kept = attach(tagged, self.lots.where(F.col("product_id") == product).select("lot_id"), ["lot_id"], "inner")
        return replace(self, source=kept, lots=None, columns={**self.columns, "lot_id": F.col("lot_id"), "product_id": F.lit(product)})

    def available(self) -> tuple[str, ...]:
        """The measurement columns this table can give."""
        return tuple(n for n in COLUMNS if n in self.columns or n == "product_id" and self.lots is not None)

    def frame(self, *names: str) -> DataFrame:
        """The named measurement columns (all by default); nothing else is read."""
        names = names or self.available()
        from_lots = self.lots is not None and "product_id" in names
        needed = [n for n in names if not (from_lots and n == "product_id")]
        if from_lots and "lot_id" not in needed:
            needed.append("lot_id")
        rows = self.source.select(*[self.columns[n].alias(n) for n in needed], *self.extra)
        if from_lots:
            rows = attach(rows, self.lots, ["lot_id"])
        return rows.select(*names, *self.extra)


def of_table(table: DataFrame) -> Measurements:
    """A table that already has the measurement columns; ``product_id`` may be absent."""
    columns = {n: F.col(n) for n in COLUMNS if n in table.columns}
    for name in ("value", "yield"):
        if name in columns:
            columns[name] = no_nan(columns[name])
    return Measurements(table, columns)


def scan(spark: SparkSession, path: str, fmt: str = "parquet") -> Measurements:
    """Read a stored measurement table; a missing path raises Spark's own analysis error.

    ``fmt="delta"`` needs a Delta connector on the classpath.
    """
    reader = spark.read.format(fmt)
    return of_table((reader if fmt == "delta" else reader.schema(SCHEMA)).load(path))
