"""The paths taken only by large or uneven tables must give what the plain ones give."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fabgrain.functions.order_stats import order_statistics, quantiles
from fabgrain.functions.skew import attach, keep
from fabgrain.operators.distribution import cdf_ranks, empirical_cdf
from fabgrain.operators.select import deep_page, ordering, page, sort_keys
from fabgrain.operators.summary import box_plot


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_attach_splits_a_hot_key_and_rows_without_one(spark):
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id") % 11)
    rows = spark.range(0, 60000, numPartitions=16).select(F.col("id").alias("v"), key.cast("int").alias("k"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("t"))
    summary = keep(spark.createDataFrame([(k, k * 10) for k in range(9)], "k int, s int"))
    plain = {how: rows_of(rows.join(F.broadcast(summary), "k", how).select("v", "s")) for how in ("left", "inner")}
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        for how in ("left", "inner"):
            joined = attach(rows, summary, ["k"], how).select("v", "s", F.length("t").alias("n"), F.spark_partition_id().alias("task"))
            got = joined.collect()
            assert sorted([(r.v, r.s) for r in got], key=str) == plain[how]
            assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
            assert len({r.task for r in got if r.s == 70}) > 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def skewed_values(spark):
    rng = np.random.default_rng(5)
    parts = [
        ("hot", rng.normal(0, 1, 3000)), ("hot", np.full(1500, 0.25)), ("hot", [1e300, -1e300, 1e-300]),
        ("same", np.full(700, 4.0)), ("one", [2.5]), ("two", [1.0, 9.0]), ("close", 1 + np.arange(900) * 2.2e-16),
    ]
    pdf = pd.concat([pd.DataFrame({"k": k, "value": np.asarray(v, dtype=float)}) for k, v in parts])
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("hot_rows", [10**6, 400, 1])
def test_order_statistics_match_sorting(spark, hot_rows):
    pdf, df = skewed_values(spark)
    got = order_statistics(df, ["k"], "value", cdf_ranks, hot_rows=hot_rows, fanout=8).toPandas()
    for k, group in pdf.groupby("k"):
        ordered = np.sort(group["value"].to_numpy())
        n = len(ordered)
        ranks = np.arange(n) if n <= 500 else np.linspace(0, n - 1, 200).astype(int)
        mine = got[got["k"] == k].sort_values("rank")
        assert mine["rank"].tolist() == ranks.tolist()
        assert mine["value"].tolist() == ordered[ranks].tolist()
        assert set(mine["n"]) == {n}


def test_quantiles_match_numpy_when_split(spark):
    pdf, df = skewed_values(spark)
    pdf, df = pdf[pdf["value"].abs() < 1e200], df.where(F.abs("value") < 1e200)
    got = quantiles(df, ["k"], "value", {"q1": 0.25, "q9": 0.9}, hot_rows=300, fanout=16).toPandas().set_index("k")
    for k, group in pdf.groupby("k"):
        np.testing.assert_allclose(got.loc[k].astype(float), np.percentile(group["value"], [25, 90]), rtol=1e-12)


def test_box_plot_and_cdf_do_not_depend_on_the_path(spark):
    pdf, df = skewed_values(spark)
    df = df.where(F.abs("value") < 1e200)
    usual, split = (box_plot(df, ["k"], hot_rows=h).toPandas().set_index("k") for h in (10**6, 200))
    np.testing.assert_allclose(usual.astype(float), split.loc[usual.index].astype(float), rtol=1e-12)
    assert rows_of(empirical_cdf(df, ["k"])) == rows_of(empirical_cdf(df, ["k"], hot_rows=150, fanout=4))


@pytest.mark.parametrize("n", [1, 2, 499, 500, 501, 502, 1000, 39801, 123457])
def test_cdf_ranks_match_numpy(spark, n):
    got = spark.range(1).select(cdf_ranks(F.lit(n).cast("long"))).first()[0]
    assert got == (np.arange(n) if n <= 500 else np.linspace(0, n - 1, 200).astype(int)).tolist()


def test_deep_pages_join_up_to_the_sorted_table(spark):
    df = spark.range(0, 1000, numPartitions=5).select((F.col("id") * 7 % 13).alias("wafer_id"), F.col("id").alias("x"))
    keys = sort_keys(df, "wafer_id", "desc", ["x"])
    wanted = [tuple(r) for r in df.orderBy(*ordering(keys)).collect()]
    got = []
    for start in range(0, 1000, 300):
        got += [tuple(r) for r in deep_page(df, keys, start, 300, few_rows=20).collect()]
    assert got == wanted
    shallow = [tuple(r) for r in page(df, keys, 2, 30).collect()]
    assert shallow == [tuple(r) for r in page(df, keys, 2, 30, shallow_rows=10).collect()] == wanted[30:60]


@pytest.mark.parametrize("first", [True, False])
def test_deep_pages_of_any_values(spark, first):
    """Missing values, NaN, text, a hot value, and rows that repeat."""
    rows = [(None if i % 5 == 0 else float("nan") if i % 11 == 0 else float(i % 3), None if i % 7 == 0 else f"k{i * i % 50:02d}", i) for i in range(400)]
    df = spark.createDataFrame(rows, "v double, name string, n int")
    keys = [("v", first), ("name", not first), ("n", True)]
    wanted = [str(tuple(r)) for r in df.orderBy(*ordering(keys)).collect()]
    got = [str(tuple(r)) for start in range(0, 400, 80) for r in deep_page(df, keys, start, 80, few_rows=10).collect()]
    assert got == wanted
    assert deep_page(df, keys, 5000, 80, few_rows=10).count() == 0 and deep_page(df.limit(0), keys, 0, 5).count() == 0


def test_deep_pages_of_equal_keys_show_every_row_once(spark):
    same = spark.range(0, 500, numPartitions=4).select(F.lit(1).alias("v"), F.col("id"))
    pages = [deep_page(same, [("v", True)], start, 100, few_rows=30).collect() for start in range(0, 500, 100)]
    assert sorted(r["id"] for p in pages for r in p) == list(range(500))
    copies = spark.range(0, 500, numPartitions=4).select(F.when(F.col("id") < 450, 1).otherwise(2).alias("v"))
    pages = [[r["v"] for r in deep_page(copies, [("v", True)], start, 100, few_rows=30).collect()] for start in range(0, 500, 100)]
    assert sum(pages, []) == [1] * 450 + [2] * 50


def test_a_deep_page_is_one_top_k_and_writes_nothing(spark, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    monkeypatch.setattr(DataFrameWriter, "parquet", lambda *a, **k: pytest.fail("a table was written"))
    df = spark.range(0, 20_000, numPartitions=4).select((F.col("id") % 7).alias("v"), "id")
    found = deep_page(df, [("v", True), ("id", False)], 9_000, 50, few_rows=100)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange rangepartitioning" not in plan
    assert [tuple(r) for r in found.collect()] == [tuple(r) for r in df.orderBy("v", F.desc("id")).offset(9_000).limit(50).collect()]
