"""The text queries that SQL can express, against their SQL; and that one hot key does not stay in one task."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import check_oracles
from fabgrain.llm import components, exact_dedup
from fabgrain.session import durable

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = [n for n, fn in entry.queries().items() if fn.__module__.startswith("fabgrain.llm.") and n in entry.oracle_sql()]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not found")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in check_oracles.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    assert check_oracles.compare(entry.queries()[name](spark, FOLDER).toPandas(), con.execute(entry.oracle_sql()[name]).df()) == "ok"


@pytest.fixture
def splitting(spark):
    """Joins are shuffled, and partitions of a few KB count as skewed."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_star_of_many_neighbours_is_split(spark, splitting):
    pairs = durable(spark.range(0, 60_000, numPartitions=8).select(F.when(F.col("id") % 5 > 0, 0).otherwise(F.col("id")).alias("u"), F.col("id").alias("v")))
    assert "skew=true" in final_plan(components._star(pairs))


def test_copies_of_one_text_are_split(spark, splitting):
    docs = spark.range(0, 30_000, numPartitions=8).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 5 > 0, "the same").otherwise(F.concat(F.lit("t"), (F.col("id") % 700).cast("string"))).alias("text"))
    found = exact_dedup.groups(docs)
    assert "skew=true" in final_plan(found)
    assert found.where("group_size > 20000 and keep_id = 29999").count() == 24_000
