"""Every registered query against its SQL, and the shape of important plans."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
import check_oracles

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not found")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in check_oracles.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


CORE = [n for n, fn in entry.queries().items() if fn.__module__.startswith("fabgrain.plans.")]


@pytest.mark.parametrize("name", [n for n in CORE if n in entry.oracle_sql()])
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    text = plan(df)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert check_oracles.compare(df.toPandas(), duck.execute(entry.oracle_sql()[name]).df()) == "ok"


def test_every_query_has_sql():
    assert set(CORE) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).columns == ["lot_id", "wafer_id", "parameter", "min_value", "q1", "median", "q3", "max_value", "mean_value"]


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_wafer_filters_reach_the_scan(spark):
    text = plan(entry.queries()["p1_one_wafer"](spark, FOLDER))
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", text)[1]
    assert "EqualTo(l_suppkey,3)" in pushed and "EqualTo(l_linenumber,2)" in pushed and "EqualTo(l_returnflag,A)" in pushed


def test_scans_read_only_used_columns(spark):
    text = plan(entry.queries()["a5_lot_trend"](spark, FOLDER))
    assert re.findall(r"ReadSchema: struct<([^>]*)>", text) == ["l_suppkey:bigint,l_linenumber:int,l_extendedprice:double,l_returnflag:string"]


@pytest.mark.parametrize("name", ["l2_page", "l4_top_lots", "r4_nearest_l2"])
def test_top_rows_need_no_full_sort(spark, name):
    assert "TakeOrderedAndProject" in plan(entry.queries()[name](spark, FOLDER))


@pytest.mark.parametrize("name", ["a5_lot_trend", "a7_lot_yield", "a8_wafer_yield", "a9_status_summary", "t1_request_rate"])
def test_rows_aggregate_by_hashing_before_the_shuffle(spark, name):
    below = plan(entry.queries()[name](spark, FOLDER)).split("Exchange hashpartitioning")[-1]
    assert "HashAggregate" in below and "SortAggregate" not in below



@pytest.mark.parametrize("name", ["a2_wafer_map", "a3_lot_gallery", "p7_heat_level"])
def test_wafer_limits_take_one_scan_and_one_shuffle(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    assert text.count("Scan parquet") == 1 and text.count("Exchange hashpartitioning") == 1


def test_words_are_counted_without_a_shuffle(spark):
    from fabgrain.operators.retrieval import count_vectors

    text = plan(count_vectors(spark.read.parquet(f"{FOLDER}/documents.parquet"), "doc_id", "text"))
    assert "Exchange" not in text
