"""The driver's star-schema tables read in the roles the operators expect.

Prices are taken in cents and the yield falls by 11/16 per percent of discount, so all sums are
exact in double precision and do not depend on the order of addition.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fabgrain.sources.measurements import Measurements

# Order of the parameters, as first seen on a wafer, and the row key that breaks sorting ties.
PARAMETERS = ["N", "A", "R"]
ROW_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


# Schemas of the stored tables; naming them saves a look into the files per read.
SCHEMAS = {
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "conversations": "conv_id long, turn long, role string, text string",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def _numbered(prefix: str, column: str, digits: int | None = None):
    """Equality on ``prefix || number`` as equality on the stored number."""
    def located(value: str) -> Column:
        found = re.fullmatch(rf"{prefix}(0|[1-9]\d*)" if digits is None else rf"{prefix}(\d{{{digits}}})", value)
        return F.col(column) == int(found[1]) if found else F.lit(False)

    return located


def lots(spark: SparkSession, sf: str) -> DataFrame:
    """Lots are suppliers; a lot's product is the supplier's nation."""
    return table(spark, sf, "supplier").select(
        F.concat(F.lit("Lot"), F.col("s_suppkey").cast("string")).alias("lot_id"),
        F.concat(F.lit("PRD-"), F.col("s_nationkey").cast("string")).alias("product_id"),
    )


def measurements(spark: SparkSession, sf: str, extra: tuple[str, ...] = ()) -> Measurements:
    """Line items as measurements: one row per die, value in cents."""
    return Measurements(
        source=table(spark, sf, "lineitem"),
        columns={
            "lot_id": F.concat(F.lit("Lot"), F.col("l_suppkey").cast("string")),
            "wafer_id": F.concat(F.lit("W"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0")),
            "parameter": F.col("l_returnflag"),
            "x": F.col("l_partkey") % 30 + 1,
            "y": F.col("l_orderkey") % 30 + 1,
            "value": F.rint(F.col("l_extendedprice") * 100),
            "yield": F.lit(100.0) - F.lit(0.6875) * F.rint(F.col("l_discount") * 100),
        },
        locate={"lot_id": _numbered("Lot", "l_suppkey"), "wafer_id": _numbered("W", "l_linenumber", 2)},
        lots=lots(spark, sf),
        extra=extra,
    )


# The same rows for the SQL checks.
MEASURED = """
m AS (
  SELECT 'PRD-' || s_nationkey AS product_id, 'Lot' || l_suppkey AS lot_id,
         'W' || lpad(l_linenumber::VARCHAR, 2, '0') AS wafer_id, l_returnflag AS parameter,
         l_partkey % 30 + 1 AS x, l_orderkey % 30 + 1 AS y,
         round(l_extendedprice * 100) AS value,
         100.0::DOUBLE - 0.6875::DOUBLE * round(l_discount * 100) AS yield,
         l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey
)"""


def users(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as users; the household segment has no group."""
    segment = F.col("c_mktsegment")
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("username"),
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
        segment.alias("name"),
        F.when(segment == "MACHINERY", "admin").when(segment == "BUILDING", "demo01").when(segment != "HOUSEHOLD", "user").alias("user_group"),
        F.when(segment != "HOUSEHOLD", F.col("c_nationkey")).alias("group_id"),
    )


def shown(df: DataFrame, *columns: str) -> DataFrame:
    """Missing numbers as -1, so that they compare alike whatever reads the result."""
    return df.withColumns({c: F.coalesce(c, F.lit(-1)) for c in columns})


USERS = """
users AS (
  SELECT c_custkey AS id, c_name AS username, lower(c_name) || '@example.com' AS email, c_mktsegment AS name,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN 'admin' WHEN c_mktsegment = 'BUILDING' THEN 'demo01'
              WHEN c_mktsegment <> 'HOUSEHOLD' THEN 'user' END AS user_group,
         CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN c_nationkey END AS group_id
  FROM customer
)"""


def groups(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as groups."""
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))


def menus(spark: SparkSession, sf: str) -> DataFrame:
    """Brands as menus; every fifth has no sort position."""
    brands = table(spark, sf, "part").select("p_brand").distinct()
    number = F.split("p_brand", "#")[1].cast("int")
    return brands.select(
        number.alias("id"),
        F.col("p_brand").alias("name"),
        F.lower("p_brand").alias("code"),
        F.when(number % 5 != 0, (number * 7) % 10).cast("int").alias("sort_order"),
    )


def menu_grants(spark: SparkSession, sf: str) -> DataFrame:
    """A nation is granted a brand where its mean discount on the brand is above 5 percent."""
    from fabgrain.functions.skew import attach

    nation = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("group_id"))
    brand = table(spark, sf, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.split("p_brand", "#")[1].cast("int").alias("menu_id")
    )
    sold = table(spark, sf, "lineitem").select(
        "l_suppkey", "l_partkey", F.rint(F.col("l_discount") * 100).cast("long").alias("percent")
    )
    pairs = attach(attach(sold, nation, ["l_suppkey"], "inner"), brand, ["l_partkey"], "inner")
    totals = pairs.groupBy("group_id", "menu_id").agg(F.sum("percent").alias("percent"), F.count("*").alias("n"))
    return totals.where(F.col("percent") > 5 * F.col("n")).select("group_id", "menu_id")


ACCESS = USERS + """,
groups AS (SELECT n_nationkey AS id, n_name AS name FROM nation),
menus AS (
  SELECT n AS id, p_brand AS name, lower(p_brand) AS code, CASE WHEN n % 5 <> 0 THEN (n * 7) % 10 END AS sort_order
  FROM (SELECT DISTINCT p_brand, split_part(p_brand, '#', 2)::INTEGER AS n FROM part)
),
grants AS (
  SELECT s_nationkey AS group_id, split_part(p_brand, '#', 2)::INTEGER AS menu_id
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
  GROUP BY ALL HAVING sum(round(l_discount * 100)::BIGINT) > 5 * count(*)
)"""


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Events as requests."""
    return as_requests(table(spark, sf, "events"))


def as_requests(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.select(
        "event_id",
        "ts",
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("trace_id"),
        kind.alias("service"),
        F.col("user_id").alias("caller"),
        F.when(kind.isin("purchase", "signup"), "POST").otherwise("GET").alias("method"),
        F.concat(F.lit("/k/"), F.get_json_object("props", "$.k")).alias("route"),
        F.when(kind == "error", 500).when(kind == "signup", 201).otherwise(200).alias("status_code"),
        (F.col("value") / 100).alias("duration_s"),
    )


REQUESTS = """
requests AS (
  SELECT event_id, ts, 'u' || user_id || '-' || strftime(ts, '%Y%m%d') AS trace_id, event_type AS service, user_id AS caller,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS method,
         '/k/' || json_extract_string(props, '$.k') AS route,
         CASE WHEN event_type = 'error' THEN 500 WHEN event_type = 'signup' THEN 201 ELSE 200 END AS status_code,
         value / 100 AS duration_s
  FROM events
)"""


def licenses(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as license requests: urgent ones name an expiry date, low-priority ones a period of
    their own, unspecified ones never expire."""
    from fabgrain.operators.licenses import expiry_time, local_time

    order = table(spark, sf, "orders")
    priority = F.col("o_orderpriority")
    asked = order.select(
        F.col("o_orderkey").alias("license_id"),
        F.concat(F.lit("Customer#"), F.col("o_custkey").cast("string")).alias("customer"),
        F.concat(F.lit("M-"), F.col("o_orderkey").cast("string")).alias("machine_id"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("issued"),
        F.when(priority == "1-URGENT", F.date_format(F.date_add("o_orderdate", 30), "yyyy-MM-dd")).alias("expiry_date"),
        F.when(priority == "5-LOW", 90).alias("expiry_days"),
        priority,
        F.col("o_orderstatus"),
    )
    due = expiry_time("issued", "expiry_date", "expiry_days")
    return asked.withColumn("due", due).withColumns({
        "expiry": F.when(priority != "4-NOT SPECIFIED", local_time(F.col("due"))),
        "features": F.array(F.lit("core"), F.lower(F.col("o_orderstatus"))),
        "issued_at": local_time(F.col("issued")),
    })


def license_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Encoded licenses; those of pending orders are cut off and cannot be decoded."""
    from fabgrain.operators.licenses import base64_line, encode_key

    signature = F.concat(F.lit("vault:v1:"), base64_line(F.col("machine_id")))
    keys = encode_key(licenses(spark, sf), signature)
    broken = F.when(F.col("o_orderstatus") == "P", F.concat(F.substring("license_key", 1, 20), F.lit("!!"))).otherwise(F.col("license_key"))
    return keys.select("license_id", broken.alias("license_key"))


LICENSES = """
asked AS (
  SELECT o_orderkey AS license_id, 'Customer#' || o_custkey AS customer, 'M-' || o_orderkey AS machine_id, o_orderdate AS issued,
         o_orderpriority, o_orderstatus,
         CASE WHEN o_orderpriority = '1-URGENT' THEN strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') END AS expiry_date,
         CASE WHEN o_orderpriority = '5-LOW' THEN 90 END AS expiry_days
  FROM orders
),
licenses AS (
  SELECT *, CASE WHEN expiry_date IS NOT NULL THEN (expiry_date || ' 23:59:59')::TIMESTAMP
                 ELSE issued + to_days(coalesce(expiry_days, 365)) END AS due
  FROM asked
)"""
