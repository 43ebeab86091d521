"""Queries over the measurement rows: sources, selection, summaries, distributions, paging."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabgrain.operators import distribution as dist
from fabgrain.operators import select as sel
from fabgrain.operators import summary as summ
from fabgrain.plans.driver_tables import MEASURED, PARAMETERS, ROW_KEY, USERS, lots, measurements, shown, table, users
from fabgrain.plans.registry import query
from fabgrain.session import new_path
from fabgrain.sources import measurements as meas
from fabgrain.sources import tables

ALL = "product_id, lot_id, wafer_id, parameter, x, y, value, yield"


def from_m(select: str) -> str:
    return f"WITH {MEASURED} {select}"


# --- sources and sinks

@query("s1_scan", from_m(f"SELECT {ALL} FROM m"))
def _(spark, sf):
    return meas.of_table(measurements(spark, sf).frame()).frame()


@query("s2_overwrite", from_m("""
SELECT parameter, count(*) AS rows, count(DISTINCT lot_id) AS lots, sum(value) AS value_sum, sum(yield) AS yield_sum
FROM m GROUP BY parameter"""))
def _(spark, sf):
    path = new_path(spark, "measurements")
    tables.overwrite_measurements(measurements(spark, sf).frame(), path)
    per_lot = meas.scan(spark, path).frame().groupBy("parameter", "lot_id").agg(
        F.count("*").alias("rows"), F.sum("value").alias("value_sum"), F.sum("yield").alias("yield_sum")
    )
    return per_lot.groupBy("parameter").agg(
        F.sum("rows").alias("rows"), F.count("*").alias("lots"), F.sum("value_sum").alias("value_sum"), F.sum("yield_sum").alias("yield_sum")
    )


def _profile_sql(columns: dict[str, str]) -> str:
    def row(name: str, kind: str) -> str:
        low, high = f"min({name})", f"max({name})"
        number = f"{low}::DOUBLE AS min_number, {high}::DOUBLE AS max_number, NULL::VARCHAR AS min_text, NULL::VARCHAR AS max_text"
        text = f"NULL::DOUBLE AS min_number, NULL::DOUBLE AS max_number, {low}::VARCHAR AS min_text, {high}::VARCHAR AS max_text"
        return (
            f"SELECT '{name}' AS column_name, {number if kind == 'number' else text}, "
            f"count(*) FILTER ({name} IS NULL) AS null_count, count(*) AS num_records FROM lineitem"
        )
    return " UNION ALL ".join(row(n, k) for n, k in columns.items())


@query("s3_profile", _profile_sql({
    "l_orderkey": "number", "l_partkey": "number", "l_suppkey": "number", "l_linenumber": "number", "l_quantity": "number",
    "l_extendedprice": "number", "l_discount": "number", "l_tax": "number", "l_returnflag": "text", "l_linestatus": "text",
    "l_shipdate": "text",
}))
def _(spark, sf):
    return tables.profile(table(spark, sf, "lineitem"))


@query("s4_snapshot", f"WITH {USERS} SELECT * REPLACE (coalesce(group_id, -1) AS group_id) FROM users")
def _(spark, sf):
    return shown(users(spark, sf), "group_id")


@query("s5_upsert", """
WITH latest AS (
  SELECT o_custkey * 2 AS id, o_orderpriority AS document, o_orderkey AS version FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1
)
SELECT c_custkey AS id, c_mktsegment AS document, -1::BIGINT AS version FROM customer WHERE c_custkey NOT IN (SELECT id FROM latest)
UNION ALL SELECT id, document, version FROM latest""")
def _(spark, sf):
    stored = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("document"), F.lit(-1).cast("long").alias("version")
    )
    incoming = table(spark, sf, "orders").select(
        (F.col("o_custkey") * 2).alias("id"), F.col("o_orderpriority").alias("document"), F.col("o_orderkey").alias("version")
    )
    return tables.upsert(stored, incoming, "id", "version")


@query("s5_upsert_bucketed", """
WITH latest AS (
  SELECT o_custkey * 2 AS id, o_orderpriority AS document, o_orderkey AS version FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1
)
SELECT c_custkey AS id, c_mktsegment AS document, -1::BIGINT AS version FROM customer WHERE c_custkey NOT IN (SELECT id FROM latest)
UNION ALL SELECT id, document, version FROM latest""")
def _(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("document"), F.lit(-1).cast("long").alias("version"))
    path = new_path(spark, "documents")
    stored = tables.store_bucketed(rows, path.rpartition("/")[2].replace("-", "_"), path, "id", 8)
    incoming = table(spark, sf, "orders").select(
        (F.col("o_custkey") * 2).alias("id"), F.col("o_orderpriority").alias("document"), F.col("o_orderkey").alias("version"))
    return tables.upsert_bucketed(stored, incoming, "id", "version", 8)


@query("s6_ingest_missing", """
SELECT c_custkey AS id, CASE WHEN c_acctbal < 5000 THEN 'stored' ELSE 'incoming' END AS origin FROM customer""")
def _(spark, sf):
    customer = table(spark, sf, "customer")
    stored = customer.where("c_acctbal < 5000").select(F.col("c_custkey").alias("id"), F.lit("stored").alias("origin"))
    incoming = customer.select(F.col("c_custkey").alias("id"), F.lit("incoming").alias("origin"))
    return tables.ingest_missing(stored, incoming, "id")


@query("s6_ingest_if_empty", "SELECT c_custkey AS id, c_name AS document FROM customer")
def _(spark, sf):
    incoming = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("document"))
    return tables.ingest_if_empty(incoming.where("id IS NULL"), incoming)


@query("s6_ingest_if_empty_keeps", "SELECT c_custkey AS id, c_name AS document FROM customer WHERE c_acctbal < 5000")
def _(spark, sf):
    customer = table(spark, sf, "customer")
    stored = customer.where("c_acctbal < 5000").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("document"))
    return tables.ingest_if_empty(stored, customer.select(F.col("c_custkey").alias("id"), F.lit("new").alias("document")))


@query("s7_json", from_m("""
SELECT to_json({'product_id': product_id, 'lot_id': lot_id, 'wafer_id': wafer_id, 'parameter': parameter, 'x': x, 'y': y, 'value': value / 100,
                'yield': yield})::VARCHAR AS record FROM m"""))
def _(spark, sf):
    # whole units of money, as engines write large numbers in several ways
    rows = measurements(spark, sf).frame().withColumn("value", F.col("value") / 100)
    return tables.json_records(rows)


@query("s8_concat", """
SELECT l_orderkey, l_linenumber, l_linestatus, CASE WHEN l_linestatus = 'F' THEN l_tax END AS l_tax FROM lineitem""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem")
    done = rows.where("l_linestatus = 'F'").select("l_orderkey", "l_linenumber", "l_linestatus", "l_tax")
    rest = rows.where("l_linestatus <> 'F'").select("l_linestatus", "l_orderkey", "l_linenumber")
    return tables.concat([done, rest])


# --- selection and derived columns

@query("p1_one_wafer", from_m(f"SELECT {ALL} FROM m WHERE lot_id = 'Lot3' AND wafer_id = 'W02' AND parameter = 'A'"))
def _(spark, sf):
    return sel.one_wafer(measurements(spark, sf), "Lot3", "W02", "A")


@query("p2_optional_filters", from_m(f"SELECT {ALL} FROM m WHERE product_id = 'PRD-3' AND wafer_id = 'W04'"))
def _(spark, sf):
    return sel.optional_filters(measurements(spark, sf), product_id="PRD-3", lot_id="", wafer_id="W04").frame()


@query("p3_report_columns", from_m("SELECT product_id, lot_id, wafer_id, parameter, x, y, value FROM m"))
def _(spark, sf):
    return sel.report_columns(measurements(spark, sf).frame())


@query("p4_typed_wafer", from_m(f"SELECT {ALL} FROM m WHERE wafer_id = upper('w03')"))
def _(spark, sf):
    return sel.wafer_like_typed(measurements(spark, sf), "w03").frame()


@query("p5_yield_status", from_m("""
SELECT lot_id, wafer_id, avg(yield) AS yield, CASE WHEN avg(yield) < 96.5 THEN 'low' ELSE 'ok' END AS status
FROM m GROUP BY lot_id, wafer_id"""))
def _(spark, sf):
    per_wafer = summ.wafer_yield(measurements(spark, sf).frame("lot_id", "wafer_id", "parameter", "yield"), PARAMETERS)
    return per_wafer.select("lot_id", "wafer_id", "yield", sel.yield_status().alias("status"))


@query("p6_zero_based", from_m("SELECT lot_id, wafer_id, parameter, x - 1 AS x, y - 1 AS y, value FROM m"))
def _(spark, sf):
    return sel.zero_based(measurements(spark, sf).frame("lot_id", "wafer_id", "parameter", "x", "y", "value"))


@query("p7_heat_level", from_m("""
, limits AS (SELECT lot_id, wafer_id, parameter, min(value) AS low, max(value) AS high FROM m GROUP BY ALL)
SELECT lot_id, wafer_id, parameter, x, y, value, level,
  ['#313695','#4575b4','#74add1','#abd9e9','#e0f3f8','#ffffbf','#fee090','#fdae61','#f46d43','#d73027','#a50026'][level + 1] AS colour
FROM (
  SELECT m.*, CASE WHEN high = low THEN 0 ELSE least(10, floor((value - low) / (high - low) * 11)) END::INTEGER AS level
  FROM m JOIN limits USING (lot_id, wafer_id, parameter))"""))
def _(spark, sf):
    return sel.heat_levels(measurements(spark, sf).frame("lot_id", "wafer_id", "parameter", "x", "y", "value"))


# --- summaries

@query("a1_catalogue", from_m("""
SELECT 'product' AS dimension, product_id AS id FROM m WHERE product_id IS NOT NULL UNION SELECT 'lot', lot_id FROM m
UNION SELECT 'wafer', wafer_id FROM m UNION SELECT 'parameter', parameter FROM m"""))
def _(spark, sf):
    return summ.catalogue(measurements(spark, sf).frame("lot_id", "wafer_id", "parameter"), lots(spark, sf))


@query("a2_wafer_map", from_m("""
SELECT lot_id, wafer_id, parameter, x, y, value, min(value) OVER w AS min_value, max(value) OVER w AS max_value
FROM m WINDOW w AS (PARTITION BY lot_id, wafer_id, parameter)"""))
def _(spark, sf):
    return summ.wafer_map(measurements(spark, sf).frame("lot_id", "wafer_id", "parameter", "x", "y", "value"))


@query("a3_lot_gallery", from_m("""
, s AS (SELECT lot_id, wafer_id, parameter, avg(value) AS avg_value, round(stddev_samp(value), 2) AS std_value,
        min(value) AS min_value, max(value) AS max_value FROM m GROUP BY ALL)
SELECT lot_id, wafer_id, parameter, x, y, value, avg_value, std_value, min_value, max_value
FROM m JOIN s USING (lot_id, wafer_id, parameter)"""))
def _(spark, sf):
    rows = summ.lot_gallery(measurements(spark, sf).frame("lot_id", "wafer_id", "parameter", "x", "y", "value"))
    return rows.withColumn("std_value", F.round("std_value", 2))


@query("a4_box_plot", from_m("""
SELECT lot_id, wafer_id, parameter, min(value) AS min_value, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
       quantile_cont(value, 0.75) AS q3, max(value) AS max_value, avg(value) AS mean_value
FROM m GROUP BY ALL"""))
def _(spark, sf):
    return summ.box_plot(measurements(spark, sf).frame("lot_id", "wafer_id", "parameter", "value"))


@query("a5_lot_trend", from_m("SELECT lot_id, wafer_id, parameter, avg(value) AS mean_value FROM m GROUP BY ALL"))
def _(spark, sf):
    return summ.lot_trend(measurements(spark, sf).frame("lot_id", "wafer_id", "parameter", "value"))


@query("a6_trend_extremes", from_m("""
, t AS (SELECT lot_id, wafer_id, parameter, avg(value) AS mean_value FROM m GROUP BY ALL)
SELECT lot_id, parameter, first(wafer_id ORDER BY mean_value DESC, wafer_id) AS highest_wafer, max(mean_value) AS highest_mean,
       first(wafer_id ORDER BY mean_value, wafer_id) AS lowest_wafer, min(mean_value) AS lowest_mean
FROM t GROUP BY lot_id, parameter"""))
def _(spark, sf):
    return summ.trend_extremes(measurements(spark, sf).frame("lot_id", "wafer_id", "parameter", "value"))


@query("a7_lot_yield", from_m("SELECT lot_id, avg(yield) AS yield, min(product_id) AS product_id FROM m GROUP BY lot_id"))
def _(spark, sf):
    return summ.lot_yield(measurements(spark, sf).frame("lot_id", "yield"), lots(spark, sf))


@query("a7_lot_yield_of_product", from_m("""
SELECT lot_id, avg(yield) AS yield, min(product_id) AS product_id FROM m WHERE product_id = 'PRD-3' GROUP BY lot_id"""))
def _(spark, sf):
    return summ.lot_yield(measurements(spark, sf).where(product_id="PRD-3").frame("lot_id", "yield", "product_id"))


@query("a7_lot_yield_by_wafer", from_m("""
, w AS (SELECT lot_id, wafer_id, avg(yield) AS yield, min(product_id) AS product_id FROM m GROUP BY ALL)
SELECT lot_id, round(avg(yield), 6) AS yield, min(product_id) AS product_id FROM w GROUP BY lot_id"""))
def _(spark, sf):
    rows = summ.lot_yield(measurements(spark, sf).frame("lot_id", "wafer_id", "yield"), lots(spark, sf), weighting="wafer")
    return rows.withColumn("yield", F.round("yield", 6))


@query("a8_wafer_yield", from_m("""
SELECT lot_id, wafer_id, avg(yield) AS yield,
       first(parameter ORDER BY list_position(['N', 'A', 'R'], parameter)) AS parameter
FROM m GROUP BY lot_id, wafer_id"""))
def _(spark, sf):
    return summ.wafer_yield(measurements(spark, sf).frame("lot_id", "wafer_id", "parameter", "yield"), PARAMETERS)


@query("a9_status_summary", from_m("""
SELECT lot_id, wafer_id, parameter, avg(value) AS mean, round(stddev_samp(value), 2) AS std, min(value) AS min, max(value) AS max,
       avg(yield) AS yield
FROM m GROUP BY ALL"""))
def _(spark, sf):
    rows = summ.status_summary(measurements(spark, sf).frame("lot_id", "wafer_id", "parameter", "value", "yield"), constant_yield=False)
    return rows.withColumn("std", F.round("std", 2))


@query("a9_status_one_yield", from_m("""
SELECT lot_id, wafer_id, parameter, avg(value) AS mean, round(stddev_samp(value), 2) AS std, min(value) AS min, max(value) AS max,
       max(yield) AS yield
FROM m GROUP BY ALL"""))
def _(spark, sf):
    rows = summ.status_summary(measurements(spark, sf).frame("lot_id", "wafer_id", "parameter", "value", "yield"))
    return rows.withColumn("std", F.round("std", 2))


@query("a9_incremental", from_m("""
SELECT lot_id, wafer_id, parameter, avg(value) AS mean, round(stddev_samp(value), 2) AS std, min(value) AS min, max(value) AS max,
       avg(yield) AS yield
FROM m GROUP BY ALL"""))
def _(spark, sf):
    rows = measurements(spark, sf, ("l_orderkey",)).frame("lot_id", "wafer_id", "parameter", "value", "yield")
    path = new_path(spark, "moments")
    for part in range(3):
        summ.add_part(rows.where(F.col("l_orderkey") % 3 == part), path, str(part))
    return summ.status_from_moments(spark.read.parquet(path)).withColumn("std", F.round("std", 2))


@query("a10_total", from_m("SELECT count(*) AS total FROM m WHERE wafer_id = 'W05'"))
def _(spark, sf):
    return summ.row_total(sel.optional_filters(measurements(spark, sf), wafer_id="W05").frame("wafer_id"))


@query("a11_spread_yield", from_m("""
, s AS (SELECT lot_id, wafer_id, parameter, stddev_pop(value / 1000000) AS spread FROM m GROUP BY ALL)
SELECT lot_id, wafer_id, parameter, round(spread, 6) AS spread,
  round(greatest(85, least(100, 100 - greatest(0, (spread - CASE WHEN parameter = 'A' THEN 1.8 ELSE 1.3 END)
                                              * CASE WHEN parameter = 'A' THEN 5.0 ELSE 6.0 END))), 6)::DOUBLE AS implied_yield
FROM s"""))
def _(spark, sf):
    rows = measurements(spark, sf).frame("lot_id", "wafer_id", "parameter", "value")
    implied = summ.yield_from_spread(rows.withColumn("value", F.col("value") / 1000000), {"A": (1.8, 5.0)})
    return implied.withColumns({c: F.round(c, 6) for c in ("spread", "implied_yield")})


# --- distributions

CDF_SQL = from_m("""
, r AS (SELECT {keys}, value, row_number() OVER (PARTITION BY {keys} ORDER BY value) - 1 AS rank, count(*) OVER (PARTITION BY {keys}) AS n FROM m),
p AS (
  SELECT {keys}, value, n, rank AS point, n AS points FROM r WHERE n <= 500
  UNION ALL
  SELECT {keys}, value, n, i AS point, 200 AS points FROM r, range(200) AS g(i)
  WHERE n > 500 AND rank = CASE WHEN i = 199 THEN n - 1 ELSE floor(i * ((n - 1) / 199.0::DOUBLE))::BIGINT END
)
SELECT {keys}, point, value AS x,
  CASE WHEN points = 1 THEN 0 WHEN point = points - 1 THEN 1 ELSE point * (1.0::DOUBLE / (points - 1)) END::DOUBLE AS y
FROM p""")


@query("c1_cdf", CDF_SQL.format(keys="lot_id, parameter"))
def _(spark, sf):
    return dist.empirical_cdf(measurements(spark, sf).frame("lot_id", "parameter", "value"))


@query("c1_cdf_sampled", CDF_SQL.format(keys="parameter"))
def _(spark, sf):
    return dist.empirical_cdf(measurements(spark, sf).frame("parameter", "value"), keys=["parameter"])


@query("c1_sketched", from_m("""
SELECT lot_id, parameter, count(value) AS n, min(value) AS low, max(value) AS high, 9::BIGINT AS points, true AS in_order
FROM m WHERE value IS NOT NULL GROUP BY lot_id, parameter"""))
def _(spark, sf):
    # quantiles are approximate, so the check looks at their number and order; their rank error is tested
    wafers = dist.wafer_sketches(measurements(spark, sf).frame("lot_id", "wafer_id", "parameter", "value"))
    points = dist.sketched_quantiles(dist.roll_up(wafers, ["lot_id", "parameter"]), [i / 10 for i in range(1, 10)])
    listed = F.array_sort(F.collect_list(F.struct("share", "value")))["value"]
    return points.groupBy("lot_id", "parameter", "n", "low", "high").agg(listed.alias("v")).select(
        "lot_id", "parameter", "n", "low", "high", F.size("v").cast("long").alias("points"),
        ((F.array_sort("v") == F.col("v")) & (F.array_min("v") >= F.col("low")) & (F.array_max("v") <= F.col("high"))).alias("in_order"))


@query("c2_histogram", from_m("""
, b AS (SELECT lot_id, parameter, min(value) AS low, max(value) AS high FROM m GROUP BY ALL)
SELECT lot_id, parameter, bin, low + (high - low) / 20 * (bin - 1) AS bin_low, low + (high - low) / 20 * (bin - 1) + (high - low) / 20 AS bin_high, count(*) AS rows
FROM (
  SELECT lot_id, parameter, low, high,
         CASE WHEN high = low THEN 1 ELSE least(20, floor((value - low) / (high - low) * 20) + 1) END::INTEGER AS bin
  FROM m JOIN b USING (lot_id, parameter))
GROUP BY lot_id, parameter, bin, low, high"""))
def _(spark, sf):
    return dist.histogram(measurements(spark, sf).frame("lot_id", "parameter", "value"), 20)


@query("c3_control_chart", from_m("""
, t AS (SELECT lot_id, wafer_id, parameter, avg(value) AS mean_value FROM m GROUP BY ALL),
l AS (SELECT lot_id, parameter, avg(mean_value) AS c, stddev_samp(mean_value) AS s FROM t GROUP BY ALL)
SELECT lot_id, parameter, wafer_id, mean_value, round(c, 2) AS centre, round(c - 1.5::DOUBLE * s, 2) AS lower_limit, round(c + 1.5::DOUBLE * s, 2) AS upper_limit,
       mean_value NOT BETWEEN c - 1.5::DOUBLE * s AND c + 1.5::DOUBLE * s AS out_of_control
FROM t JOIN l USING (lot_id, parameter)"""))
def _(spark, sf):
    rows = dist.control_chart(measurements(spark, sf).frame("lot_id", "wafer_id", "parameter", "value"), sigmas=1.5)
    return rows.withColumns({c: F.round(c, 2) for c in ("centre", "lower_limit", "upper_limit")})


LIMITS = [("A", 500000.0, 8000000.0), ("N", 400000.0, 7500000.0), ("R", 300000.0, 9000000.0)]


@query("c4_range_violations", from_m("""
, l(parameter, low, high) AS (VALUES ('A', 500000::DOUBLE, 8000000::DOUBLE), ('N', 400000, 7500000), ('R', 300000, 9000000))
SELECT lot_id, wafer_id, parameter, x, y, value, low, high FROM m JOIN l USING (parameter) WHERE value NOT BETWEEN low AND high"""))
def _(spark, sf):
    limits = spark.createDataFrame(LIMITS, "parameter string, low double, high double")
    return dist.range_violations(measurements(spark, sf).frame("lot_id", "wafer_id", "parameter", "x", "y", "value"), limits)


@query("c5_across_parameters", from_m("""
SELECT lot_id, wafer_id, avg(value) FILTER (parameter = 'N') AS "mean_N", avg(value) FILTER (parameter = 'A') AS "mean_A",
       avg(value) FILTER (parameter = 'R') AS "mean_R"
FROM m GROUP BY lot_id, wafer_id"""))
def _(spark, sf):
    return dist.across_parameters(measurements(spark, sf).frame("lot_id", "wafer_id", "parameter", "value"), PARAMETERS)


ON_WAFER = "sqrt((x - 15.5::DOUBLE) ** 2 + (y - 15.5::DOUBLE) ** 2) <= 13.5"


@query("c6_die_coverage", from_m(f"""
, spots AS (SELECT DISTINCT lot_id, wafer_id, parameter, x, y FROM m),
grid AS (SELECT a.i AS x, b.i AS y FROM range(1, 31) a(i), range(1, 31) b(i))
SELECT lot_id, wafer_id, parameter, count(*) FILTER ({ON_WAFER}) AS measured_dies, count(*) FILTER (NOT ({ON_WAFER})) AS off_wafer,
       (SELECT count(*) FROM grid WHERE {ON_WAFER}) AS expected_dies,
       (SELECT count(*) FROM grid WHERE {ON_WAFER}) - count(*) FILTER ({ON_WAFER}) AS missing_dies
FROM spots GROUP BY lot_id, wafer_id, parameter"""))
def _(spark, sf):
    return dist.die_coverage(measurements(spark, sf).frame("lot_id", "wafer_id", "parameter", "x", "y"))


@query("c6_bitmap_coverage", from_m(f"""
, spots AS (SELECT DISTINCT lot_id, wafer_id, parameter, x, y FROM m),
grid AS (SELECT a.i AS x, b.i AS y FROM range(1, 31) a(i), range(1, 31) b(i))
SELECT lot_id, wafer_id, parameter, count(*) FILTER ({ON_WAFER}) AS measured_dies, count(*) FILTER (NOT ({ON_WAFER})) AS off_wafer,
       (SELECT count(*) FROM grid WHERE {ON_WAFER}) AS expected_dies,
       (SELECT count(*) FROM grid WHERE {ON_WAFER}) - count(*) FILTER ({ON_WAFER}) AS missing_dies
FROM spots GROUP BY lot_id, wafer_id, parameter"""))
def _(spark, sf):
    rows = measurements(spark, sf, ("l_orderkey",)).frame("lot_id", "wafer_id", "parameter", "x", "y")
    parts = [dist.coverage_bitmaps(rows.where(F.col("l_orderkey") % 3 == part)) for part in range(3)]
    return dist.bitmap_coverage(dist.merge_bitmaps(functools.reduce(DataFrame.unionByName, parts)))


@query("c6_bitmap_gaps", from_m(f"""
, spots AS (SELECT DISTINCT lot_id, wafer_id, parameter, x, y FROM m),
grid AS (SELECT a.i AS x, b.i AS y FROM range(1, 31) a(i), range(1, 31) b(i)),
wafers AS (SELECT DISTINCT lot_id, wafer_id, parameter FROM m)
SELECT lot_id, wafer_id, parameter, x, y FROM wafers, grid WHERE {ON_WAFER}
EXCEPT SELECT lot_id, wafer_id, parameter, x, y FROM spots"""))
def _(spark, sf):
    return dist.bitmap_gaps(dist.coverage_bitmaps(measurements(spark, sf).frame("lot_id", "wafer_id", "parameter", "x", "y")))


@query("c6_missing_dies", from_m(f"""
, spots AS (SELECT DISTINCT lot_id, wafer_id, parameter, x, y FROM m),
grid AS (SELECT a.i AS x, b.i AS y FROM range(1, 31) a(i), range(1, 31) b(i)),
wafers AS (SELECT DISTINCT lot_id, wafer_id, parameter FROM m)
SELECT lot_id, wafer_id, parameter, x, y FROM wafers, grid WHERE {ON_WAFER}
EXCEPT SELECT lot_id, wafer_id, parameter, x, y FROM spots"""))
def _(spark, sf):
    return dist.missing_dies(measurements(spark, sf).frame("lot_id", "wafer_id", "parameter", "x", "y"))


# --- order and paging

@query("l1_sort", from_m(f"SELECT {ALL} FROM m ORDER BY value DESC, lot_id"))
def _(spark, sf):
    rows = measurements(spark, sf, ROW_KEY).frame()
    return sel.sort_rows(rows, "value", "desc", ROW_KEY).drop(*ROW_KEY)


PAGE_SQL = from_m("""
SELECT product_id, lot_id, wafer_id, parameter, x, y, value FROM m
ORDER BY value DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 100 OFFSET {offset}""")


@query("l2_page", PAGE_SQL.format(offset=200))
def _(spark, sf):
    return sel.report_columns(sel.page_of(measurements(spark, sf, ROW_KEY), 3, 100, "value", "desc", ROW_KEY))


@query("l2_deep_page", PAGE_SQL.format(offset=5000))
def _(spark, sf):
    return sel.report_columns(sel.page_of(measurements(spark, sf, ROW_KEY), 51, 100, "value", "desc", ROW_KEY, shallow_rows=1000))


@query("l2_next_page", from_m("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, value FROM m WHERE l_orderkey > 4000
ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 100"""))
def _(spark, sf):
    rows = measurements(spark, sf, ROW_KEY).frame("value")
    return sel.page_after(rows, ROW_KEY, (4000, 2**31 - 1, 0, 0))


@query("l3_report", from_m("""
SELECT product_id, lot_id, wafer_id, parameter, x, y, value, count(*) OVER () AS total, 2 AS page, 50 AS page_limit
FROM m WHERE wafer_id = 'W02' ORDER BY lot_id DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 50 OFFSET 50"""))
def _(spark, sf):
    return sel.report(
        measurements(spark, sf, ROW_KEY), number=2, limit=50, wafer_id="W02", sort_by="lot_id", direction="desc", tie=ROW_KEY
    )


@query("l3_report_empty", from_m("""
SELECT NULL::VARCHAR AS product_id, NULL::VARCHAR AS lot_id, NULL::VARCHAR AS wafer_id, NULL::VARCHAR AS parameter, NULL::BIGINT AS x, NULL::BIGINT AS y,
       NULL::DOUBLE AS value, count(*) AS total, 1000000000 AS page, 50 AS page_limit FROM m WHERE product_id = 'PRD-3'"""))
def _(spark, sf):
    return sel.report(measurements(spark, sf, ROW_KEY), number=10**9, limit=50, product_id="PRD-3", tie=ROW_KEY)


@query("l4_top_lots", from_m("""
SELECT lot_id, avg(yield) AS yield, min(product_id) AS product_id FROM m GROUP BY lot_id ORDER BY lot_id DESC LIMIT 25"""))
def _(spark, sf):
    return sel.top_lots(summ.lot_yield(measurements(spark, sf).frame("lot_id", "yield"), lots(spark, sf)))


@query("l5_page_links", from_m("""
, t AS (SELECT count(*) AS total FROM m)
SELECT page, least(100, total - (page - 1) * 100)::BIGINT AS page_rows, page > 1 AS has_previous, page * 100 < total AS has_next
FROM t, unnest(range(1, greatest(1, ceil(total / 100.0)::BIGINT) + 1)) AS g(page)"""))
def _(spark, sf):
    return sel.page_links(summ.row_total(measurements(spark, sf).frame("lot_id")))


@query("l6_wafer_order", from_m("SELECT DISTINCT lot_id, wafer_id FROM m"))
def _(spark, sf):
    return sel.ordered_wafers(measurements(spark, sf).frame("lot_id", "wafer_id"))
