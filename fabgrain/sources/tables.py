"""Writing, profiling, upserting and serialising tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fabgrain.sources.measurements import DIE_KEYS

NUMBERS = (T.NumericType,)


def overwrite_measurements(df: DataFrame, path: str, max_rows_per_file: int = 20_000_000) -> None:
    """Replace the table at ``path``, one folder per parameter, rows clustered by lot and wafer.

    Ranges over the whole die key keep a large lot or parameter from landing in one task, and the
    source partition as the last key does so for copies of one row. The file statistics on lot and
    wafer then let readers skip files.
    """
    order = ["parameter", *[k for k in DIE_KEYS if k != "parameter"]]
    (
        df.withColumn("_part", F.spark_partition_id())
        .repartitionByRange(*order, "_part")
        .sortWithinPartitions(*order)
        .drop("_part")
        .write.mode("overwrite")
        .option("maxRecordsPerFile", max_rows_per_file)
        .partitionBy("parameter")
        .parquet(path)
    )


def profile(df: DataFrame) -> DataFrame:
    """Row count and per-column minimum, maximum and null count, in one pass.

    Numbers report in ``min_number``/``max_number``, all other types in ``min_text``/``max_text``.
    """
    def entry(f: T.StructField):
        number = isinstance(f.dataType, NUMBERS)
        col = F.col(f"`{f.name}`")
        low, high = F.min(col), F.max(col)
        none = F.lit(None)
        return F.struct(
            F.lit(f.name).alias("column_name"),
            (low if number else none).cast("double").alias("min_number"),
            (high if number else none).cast("double").alias("max_number"),
            (none if number else low).cast("string").alias("min_text"),
            (none if number else high).cast("string").alias("max_text"),
            F.count_if(col.isNull()).alias("null_count"),
            F.count("*").alias("num_records"),
        )

    return df.agg(F.array(*[entry(f) for f in df.schema]).alias("entries")).select(F.inline("entries"))


def relational_snapshot(
    spark: SparkSession,
    path: str | None = None,
    jdbc: dict[str, str] | None = None,
    key: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 32,
) -> DataFrame:
    """All rows of a relational table: a Parquet snapshot, or JDBC read in key ranges."""
    if jdbc is None:
        return spark.read.parquet(path)
    reader = spark.read.format("jdbc").options(**jdbc)
    if key and bounds:
        reader = reader.options(
            partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions
        )
    return reader.load()


def upsert(target: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """Replace rows by key, add new keys; of several incoming rows the highest version wins.

    Ranking keeps one row per key before the shuffle, so an often repeated key stays cheap. The
    remaining columns break ties between equal versions.
    """
    rest = [F.col(c).desc_nulls_last() for c in incoming.columns if c not in (key, version)]
    newest = Window.partitionBy(key).orderBy(F.col(version).desc_nulls_last(), *rest)
    latest = incoming.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")
    return target.join(latest.select(key), key, "left_anti").unionByName(latest)


def store_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """Store rows as table ``name`` under ``path``, in files by the hash of ``key``: one per bucket, each sorted by it.

    The catalogue must know the table to read it by buckets; a session without a shared one knows its own tables only.
    """
    rows = df.repartition(buckets, key)
    rows.write.bucketBy(buckets, key).sortBy(key).option("path", path).mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def upsert_bucketed(target: DataFrame, incoming: DataFrame, key: str, version: str, buckets: int) -> DataFrame:
    """:func:`upsert` into a table of :func:`store_bucketed`: only the incoming rows are shuffled, to the buckets of the target.

    The result lies in the same buckets, so that it can be stored again without a shuffle. Keys are not null and occur once in
    the target.
    """
    rest = [F.col(c).desc_nulls_last() for c in incoming.columns if c not in (key, version)]
    newest = Window.partitionBy(key).orderBy(F.col(version).desc_nulls_last(), *rest)
    latest = incoming.repartition(buckets, key).withColumn("_rank", F.row_number().over(newest)).where("_rank = 1")
    new = latest.select(F.col(key), F.struct(*[c for c in target.columns if c != key]).alias("_new"))
    both = target.join(new.hint("merge"), key, "full_outer")
    return both.select(*[F.col(c) if c == key else F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in target.columns])


def ingest_missing(target: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Add incoming rows whose key the target lacks; an empty target takes them all."""
    return target.unionByName(incoming.join(target.select(key), key, "left_anti"))


def ingest_if_empty(target: DataFrame, incoming: DataFrame) -> DataFrame:
    """The incoming rows when the target is empty, otherwise the target as it is."""
    return incoming if target.isEmpty() else target


def json_records(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One JSON object per row in column ``record``; NULL fields stay in it as null."""
    return df.select(F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false"}).alias("record"))


def write_json(df: DataFrame, path: str) -> None:
    """Write rows as JSON lines."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def concat(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all frames by column name; absent columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
