"""Measurement operators on small tables with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fabgrain.operators import distribution as dist
from fabgrain.operators import select as sel
from fabgrain.operators import summary as summ
from fabgrain.sources import tables
from fabgrain.sources.measurements import SCHEMA, of_table, scan


def rows_of(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def test_nan_becomes_null_and_is_skipped(spark):
    raw = spark.createDataFrame(
        [("P", "L", "W", "T", 1, 1, v, 90.0) for v in (1.0, 3.0, float("nan"), None)] + [("P", None, "W", "T", 1, 1, 5.0, 90.0)], SCHEMA
    )
    clean = of_table(raw).frame()
    assert clean.where(F.isnan("value")).count() == 0
    assert rows_of(summ.wafer_summary(clean)) == [("L", "W", "T", 2.0, math.sqrt(2), 1.0, 3.0)]
    assert rows_of(summ.box_plot(clean)) == [("L", "W", "T", 1.0, 1.5, 2.0, 2.5, 3.0, 2.0)]
    assert rows_of(dist.empirical_cdf(clean).orderBy("point"), "x", "y") == [(1.0, 0.0), (3.0, 1.0)]


def test_box_plot(measured):
    plots = {(r.lot_id, r.wafer_id, r.parameter): r for r in summ.box_plot(measured).collect()}
    p = plots["Lot1", "W01", "Thickness"]
    assert (p.min_value, p.q1, p["median"], p.q3, p.max_value, p.mean_value) == (1, 1.75, 3, 5, 8, 3.75)
    p = plots["Lot1", "W02", "Thickness"]
    assert {p.min_value, p.q1, p["median"], p.q3, p.max_value, p.mean_value} == {3.0}


def test_spread_of_one_value_is_null(measured):
    std = {(r.lot_id, r.wafer_id, r.parameter): r.std_value for r in summ.wafer_summary(measured).collect()}
    assert std["Lot1", "W01", "Thickness"] == pytest.approx(3.095695936834452)
    assert std["Lot1", "W02", "Thickness"] is None


def test_yield_from_spread(measured):
    got = {(r.lot_id, r.wafer_id, r.parameter): r.implied_yield for r in summ.yield_from_spread(measured).collect()}
    assert got["Lot1", "W01", "Thickness"] == pytest.approx(100 - (2.680951323690902 - 1.8) * 5)
    assert got["Lot1", "W02", "Thickness"] == 100


def test_lot_and_wafer_yield(measured, spark):
    die = {r.lot_id: (r["yield"], r.product_id) for r in summ.lot_yield(measured).collect()}
    assert die["Lot1"] == (pytest.approx(96.58333333333333), "P1")
    wafer = {r.lot_id: r["yield"] for r in summ.lot_yield(measured, weighting="wafer").collect()}
    assert wafer["Lot1"] == pytest.approx(96.55)
    lots = spark.createDataFrame([("Lot1", "P1"), ("Lot2", "P2")], "lot_id string, product_id string")
    assert {(r.lot_id, r.product_id) for r in summ.lot_yield(measured.drop("product_id"), lots).collect()} == {
        ("Lot1", "P1"), ("Lot2", "P2"), ("Lot10", None)
    }
    assert rows_of(summ.wafer_yield(measured.where("lot_id = 'Lot1'"))) == [
        ("Lot1", "W01", pytest.approx(96.6), "Thickness"), ("Lot1", "W02", 96.5, "Thickness")
    ]


def test_status_is_low_strictly_below_the_limit(spark):
    yields = spark.createDataFrame([(96.5,), (96.4,), (None,)], "yield double")
    assert rows_of(yields.select(sel.yield_status())) == [("ok",), ("low",), ("ok",)]


def test_lot_order_is_text_order(measured, spark):
    lots = measured.select("lot_id").distinct()
    assert rows_of(sel.top_lots(lots)) == [("Lot2",), ("Lot10",), ("Lot1",)]
    assert rows_of(sel.top_lots(lots, natural=True)) == [("Lot10",), ("Lot2",), ("Lot1",)]
    thirty = spark.range(1, 31).select(F.concat(F.lit("Lot"), F.col("id").cast("string")).alias("lot_id"))
    kept = [r[0] for r in sel.top_lots(thirty).collect()]
    assert kept[0] == "Lot9" and kept[-1] == "Lot14"
    assert not {"Lot13", "Lot12", "Lot11", "Lot10", "Lot1"} & set(kept)


def test_optional_filters_skip_empty_values(measured):
    m = of_table(measured)
    assert sel.optional_filters(m, "", None, "").frame().count() == 8
    assert sel.optional_filters(m, "P2", "Lot10").frame().count() == 1
    assert sel.wafer_like_typed(m, "w02").frame().count() == 1
    assert sel.one_wafer(m, "Lot1", "W01").count() == 4
    assert sel.one_wafer(m, "Lot1", "W09").columns == SCHEMA.fieldNames()


def test_report_without_product_column(measured):
    m = of_table(measured.drop("product_id"))
    page = sel.report(m, limit=3, sort_by="value", direction="desc")
    assert page.columns == ["lot_id", "wafer_id", "parameter", "x", "y", "value", "total", "page", "page_limit"]
    assert rows_of(page, "value", "total") == [(9.0, 8), (8.0, 8), (7.0, 8)]
    assert rows_of(sel.report(m, limit=3, sort_by="value", direction="up"), "value") == [(9.0,), (8.0,), (7.0,)]
    by_unknown = sel.report(m, limit=8, sort_by="nothing")
    assert sorted(rows_of(by_unknown, "value")) == sorted(rows_of(measured, "value"))


def test_pages_partition_the_sorted_rows(measured):
    order = sel.sort_keys(measured)
    pages = [rows_of(sel.page(measured, order, n, 3)) for n in (1, 2, 3, 4)]
    assert [len(p) for p in pages] == [3, 3, 2, 0]
    assert sum(pages, []) == rows_of(sel.sort_rows(measured))
    with pytest.raises(ValueError):
        sel.page(measured, order, 0)


def test_missing_values_sort_last_both_ways(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "v int")
    assert rows_of(sel.sort_rows(df, "v", "asc")) == [(1,), (2,), (None,)]
    assert rows_of(sel.sort_rows(df, "v", "desc")) == [(2,), (1,), (None,)]


def test_next_page_after_a_row(measured):
    keys = ["lot_id", "wafer_id", "parameter", "y", "x"]
    first = measured.orderBy(*keys).limit(3).collect()
    rest = rows_of(sel.page_after(measured, keys, [first[-1][k] for k in keys], 10), *keys)
    assert rest == rows_of(measured.orderBy(*keys), *keys)[3:]


@pytest.mark.parametrize("total, links", [
    (0, [(1, 0, False, False)]), (100, [(1, 100, False, False)]), (101, [(1, 100, False, True), (2, 1, True, False)]),
])
def test_page_links(spark, total, links):
    assert rows_of(sel.page_links(spark.createDataFrame([(total,)], "total long"))) == links


def test_heat_levels(measured, spark):
    levels = {(r.wafer_id, r.value): (r.level, r.colour) for r in sel.heat_levels(measured.where("lot_id = 'Lot1'")).collect()}
    assert levels["W01", 1.0] == (0, "#313695") and levels["W01", 8.0] == (10, "#a50026")
    assert levels["W01", 4.0] == (math.floor(3 / 7 * 11), "#e0f3f8")
    assert levels["W02", 3.0] == (0, "#313695")


def test_zero_based(measured):
    assert (0, 0) in rows_of(sel.zero_based(measured), "x", "y")


def test_catalogue(measured):
    got = rows_of(summ.catalogue(measured))
    assert [i for d, i in got if d == "lot"] == ["Lot1", "Lot10", "Lot2"]
    assert [i for d, i in got if d == "parameter"] == ["Resistance", "Thickness"]
    assert {d for d, _ in rows_of(summ.catalogue(measured.drop("product_id")))} == {"lot", "wafer", "parameter"}


def test_cdf(measured):
    got = dist.empirical_cdf(measured).where("parameter = 'Thickness'").orderBy("point")
    assert rows_of(got.where("lot_id = 'Lot1'"), "x", "y") == [(1, 0), (2, 0.25), (3, 0.5), (4, 0.75), (8, 1)]
    assert rows_of(got.where("lot_id = 'Lot2'"), "x", "y") == [(9, 0)]


@pytest.mark.parametrize("n, points", [(500, 500), (501, 200)])
def test_cdf_thins_out_above_500_values(spark, n, points):
    df = spark.range(n).select(F.lit("L").alias("lot_id"), F.lit("T").alias("parameter"), F.col("id").cast("double").alias("value"))
    got = rows_of(dist.empirical_cdf(df).orderBy("point"), "x", "y")
    assert len(got) == points
    assert got[0] == (0, 0) and got[-1] == (n - 1, 1)
    assert got == sorted(got)


def test_histogram_counts_every_value(measured, spark):
    bins = dist.histogram(measured, 4)
    assert bins.agg(F.sum("rows")).first()[0] == 8
    lot1 = {r.bin: r.rows for r in bins.where("lot_id = 'Lot1' AND parameter = 'Thickness'").collect()}
    assert lot1 == {1: 2, 2: 2, 4: 1}
    equal = spark.createDataFrame([("L", "T", 2.0)] * 3, "lot_id string, parameter string, value double")
    assert rows_of(dist.histogram(equal, 4), "bin", "bin_low", "bin_high", "rows") == [(1, 2.0, 2.0, 3)]


def test_control_chart_flags_outliers(spark):
    values = [(f"W{i:02d}", 10.0 + i % 2) for i in range(20)] + [("W99", 30.0)]
    df = spark.createDataFrame([("L", w, "T", v) for w, v in values], "lot_id string, wafer_id string, parameter string, value double")
    assert rows_of(dist.control_chart(df).where("out_of_control"), "wafer_id") == [("W99",)]


def test_range_violations(measured, spark):
    limits = spark.createDataFrame([("Thickness", 2.0, 7.0)], "parameter string, low double, high double")
    assert sorted(r.value for r in dist.range_violations(measured, limits).collect()) == [1.0, 8.0, 9.0]


def test_across_parameters(measured):
    got = {(r.lot_id, r.wafer_id): (r.mean_Thickness, r.mean_Resistance) for r in dist.across_parameters(measured, ["Thickness", "Resistance"]).collect()}
    assert got["Lot1", "W01"] == (3.75, 5.0) and got["Lot1", "W02"] == (3.0, None)


def test_die_grid(spark):
    grid = dist.die_grid(spark)
    assert grid.count() == 560
    facts = grid.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.min("distance"), F.max("distance")).first()
    assert tuple(facts)[:4] == (3, 28, 3, 28)
    assert tuple(facts)[4:] == pytest.approx((0.7071067811865476, 13.435028842544403))
    assert rows_of(grid.orderBy("y", "x").limit(3), "x", "y") == [(11, 3), (12, 3), (13, 3)]


def test_coverage_and_missing_dies_agree(spark):
    keys = [F.lit("L").alias("lot_id"), F.lit("W").alias("wafer_id"), F.lit("T").alias("parameter")]
    measured = dist.die_grid(spark).where("x <> 15").select(*keys, "x", "y")
    measured = measured.unionByName(spark.range(1).select(*keys, F.lit(1).cast("long").alias("x"), F.lit(1).cast("long").alias("y")))
    row = dist.die_coverage(measured).first()
    missing = dist.missing_dies(measured)
    assert (row.expected_dies, row.off_wafer) == (560, 1)
    assert row.missing_dies == missing.count() == 560 - row.measured_dies
    assert {r.x for r in missing.collect()} == {15}


def test_write_read_and_skip_files(measured, spark, folder):
    path = f"{folder}/measurements"
    tables.overwrite_measurements(measured, path)
    tables.overwrite_measurements(measured, path)
    back = scan(spark, path).frame()
    assert sorted(rows_of(back)) == sorted(rows_of(measured))
    plan = scan(spark, path).where(parameter="Thickness", lot_id="Lot1").frame("value")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(parameter" in plan
    assert "EqualTo(lot_id,Lot1)" in plan
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        scan(spark, f"{folder}/none").frame().count()


def test_profile(measured):
    got = {r.column_name: r for r in tables.profile(measured).collect()}
    assert (got["value"].min_number, got["value"].max_number, got["value"].null_count, got["value"].num_records) == (1.0, 9.0, 0, 8)
    assert (got["lot_id"].min_text, got["lot_id"].max_text) == ("Lot1", "Lot2")


def test_json(measured, spark, folder):
    record = tables.json_records(measured.where("lot_id = 'Lot2'")).first()[0]
    assert record == '{"product_id":"P2","lot_id":"Lot2","wafer_id":"W01","parameter":"Thickness","x":1,"y":1,"value":9.0,"yield":100.0}'
    tables.write_json(measured, f"{folder}/rows")
    assert spark.read.schema(SCHEMA).json(f"{folder}/rows").count() == 8


def test_upsert_keeps_the_newest_and_repeats_safely(spark):
    stored = spark.createDataFrame([("a", "old", 1), ("b", "old", 1)], "id string, document string, version int")
    incoming = spark.createDataFrame([("a", "new", 2), ("a", "newer", 3), ("c", "new", 2)], stored.schema)
    once = tables.upsert(stored, incoming, "id", "version")
    assert sorted(rows_of(once)) == [("a", "newer", 3), ("b", "old", 1), ("c", "new", 2)]
    assert sorted(rows_of(tables.upsert(once, incoming, "id", "version"))) == sorted(rows_of(once))


def test_ingest(spark):
    stored = spark.createDataFrame([("a", 1)], "id string, v int")
    incoming = spark.createDataFrame([("a", 2), ("b", 2)], stored.schema)
    assert sorted(rows_of(tables.ingest_missing(stored, incoming, "id"))) == [("a", 1), ("b", 2)]
    assert rows_of(tables.ingest_if_empty(stored, incoming)) == [("a", 1)]
    assert sorted(rows_of(tables.ingest_if_empty(stored.limit(0), incoming))) == [("a", 2), ("b", 2)]


def test_concat_fills_absent_columns(spark):
    a = spark.createDataFrame([(1, "x")], "id int, s string")
    assert sorted(rows_of(tables.concat([a, a.select("id")])), key=str) == [(1, "x"), (1, None)]


def test_moments_of_parts_add_up_exactly(spark, folder):
    rng = np.random.default_rng(5)
    rows = [("Lot1", f"W{i % 3}", "T", float(np.round(1000 + rng.normal() * 0.001, 6)), 90.0 + i % 5) for i in range(600)]
    rows += [("Lot1", "W9", "T", None, None), ("Lot1", "W8", "T", 5.0, None), (None, "W1", "T", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "lot_id string, wafer_id string, parameter string, value double, yield double")
    whole = summ.status_from_moments(summ.moments(df)).collect()
    for i in range(3):
        summ.add_part(df.where(F.pmod(F.xxhash64("value"), F.lit(3)) == i) if i else df.where("value IS NULL OR pmod(xxhash64(value), 3) = 0"), f"{folder}/m", str(i))
    summ.add_part(df.where(F.pmod(F.xxhash64("value"), F.lit(3)) == 2), f"{folder}/m", "2")  # adding a part again replaces it
    parts = spark.read.parquet(f"{folder}/m")
    assert sorted(map(str, summ.status_from_moments(parts).collect())) == sorted(map(str, whole))
    want = {r.wafer_id: r for r in summ.status_summary(df, constant_yield=False).collect()}
    for r in whole:
        w = want[r.wafer_id]
        assert (r.min, r.max) == (w.min, w.max) and r["yield"] == (pytest.approx(w["yield"]) if w["yield"] is not None else None)
        assert r.mean == (pytest.approx(w["mean"], rel=1e-12) if w["mean"] is not None else None)
        values = [v for lot, wafer, _, v, _ in rows if wafer == r.wafer_id and v is not None and lot is not None]
        assert r["std"] == (pytest.approx(np.std(values, ddof=1), rel=1e-6) if len(values) > 1 else None)


def test_moments_need_no_measurement(spark, folder, measured):
    summ.add_part(measured, f"{folder}/m", "a")
    plan = summ.status_from_moments(spark.read.parquet(f"{folder}/m"))._jdf.queryExecution().executedPlan().toString()
    assert "value" not in plan.replace("values", "") and f"{folder}/m" in plan


def test_bitmaps_of_parts_equal_the_dies(spark):
    rng = np.random.default_rng(6)
    rows = [("L", f"W{i % 4}", "T", int(rng.integers(1, 31)), int(rng.integers(1, 31))) for i in range(900)] + [("L", "W1", "T", 0, 5), ("L", "W1", "T", 31, 31), ("L", "W7", "T", None, 3)]
    df = spark.createDataFrame(rows, "lot_id string, wafer_id string, parameter string, x int, y int")
    parts = dist.coverage_bitmaps(df.where("x % 2 = 0")).unionByName(dist.coverage_bitmaps(df.where("x % 2 = 1")))
    merged = dist.merge_bitmaps(parts)
    columns = ["wafer_id", "measured_dies", "off_wafer", "expected_dies", "missing_dies"]
    assert sorted(rows_of(dist.bitmap_coverage(merged), *columns)) == sorted(rows_of(dist.die_coverage(df), *columns))
    assert sorted(rows_of(dist.bitmap_gaps(merged))) == sorted(rows_of(dist.missing_dies(df)))
    assert len(merged.first()["places"]) * 8 < 150


def test_sketches_roll_up_within_their_rank_error(spark):
    rng = np.random.default_rng(9)
    values = {f"W{w}": rng.lognormal(w / 5, 1.0, 4000 + 500 * w) for w in range(10)}
    rows = [("Lot%d" % (int(w[1:]) % 2), w, "T", float(v)) for w, vs in values.items() for v in vs]
    df = spark.createDataFrame(rows, "lot_id string, wafer_id string, parameter string, value double").repartition(6)
    sketches = dist.wafer_sketches(df)
    for keys, groups in ((["lot_id"], lambda w: f"Lot{int(w[1:]) % 2}"), (["parameter"], lambda w: "T")):
        rolled = dist.roll_up(sketches, keys)
        points = dist.sketched_quantiles(rolled, [0.01, 0.25, 0.5, 0.75, 0.99])
        for r in points.collect():
            own = np.sort(np.concatenate([v for w, v in values.items() if groups(w) == r[keys[0]]]))
            assert (r.n, r.low, r.high) == (len(own), own[0], own[-1])
            assert abs(np.searchsorted(own, r.value, side="right") / len(own) - r.share) <= 3 * dist.SKETCH_ERROR
        scans = [d._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") for d in (points, sketches)]
        assert scans == [1, 1]


def test_bucketed_upsert_moves_incoming_rows_only(spark, folder):
    rows = spark.range(500).select("id", F.concat(F.lit("old"), F.col("id")).alias("document"), F.lit(0).alias("version"))
    incoming = spark.createDataFrame([(i * 3 % 700, f"new{i}", i) for i in range(400)] + [(5, None, 900), (5, "late", 3)], "id long, document string, version int")
    stored = tables.store_bucketed(rows, "bucketed_documents", f"{folder}/t", "id", 4)
    got = tables.upsert_bucketed(stored, incoming, "id", "version", 4)
    assert sorted(map(str, rows_of(got))) == sorted(map(str, rows_of(tables.upsert(rows, incoming, "id", "version"))))
    plan = tables.upsert_bucketed(stored, incoming, "id", "version", 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan and "SelectedBucketsCount: 4 out of 4" in plan
    assert plan.index("Scan parquet") < plan.index("Exchange hashpartitioning")  # the exchange is on the incoming side
    spark.sql("DROP TABLE bucketed_documents")
