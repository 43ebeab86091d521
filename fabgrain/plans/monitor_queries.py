"""Queries over request events, in batch and as streams.

The events are sparse, 10,000 per 30 days at the smallest, so windows of hours stand in for minutes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabgrain.operators import monitor as mon
from fabgrain.plans.driver_tables import REQUESTS, as_requests, requests, table
from fabgrain.plans.registry import query
from fabgrain.session import new_path
from fabgrain.streaming import requests as streams
from fabgrain.streaming import state

HOUR, DAY = 3600, 86400


@query("a13_request_counts", f"WITH {REQUESTS} SELECT method, route, status_code, count(*) AS requests FROM requests GROUP BY ALL")
def _(spark, sf):
    return mon.request_counts(requests(spark, sf))


BUCKETS = ", ".join(f"count(*) FILTER (duration_s <= {b}) AS le_{i}" for i, b in enumerate(mon.LATENCY_BOUNDS)) + ", count(*) AS le_6"


@query("a14_latency_histogram", f"""
WITH {REQUESTS},
h AS (SELECT method, route, status_code, {BUCKETS}, round(sum(duration_s), 4) AS duration_sum, count(*) AS duration_count FROM requests GROUP BY ALL)
SELECT method, route, status_code, duration_sum, duration_count, unnest(['0.01', '0.05', '0.1', '0.5', '1', '5', '+Inf']) AS le,
       unnest([le_0, le_1, le_2, le_3, le_4, le_5, le_6]) AS cumulative
FROM h""")
def _(spark, sf):
    return mon.latency_histogram(requests(spark, sf)).withColumn("duration_sum", F.round("duration_sum", 4))


@query("a15_trace_summary", f"""
WITH {REQUESTS}
SELECT trace_id, string_agg(DISTINCT service, ',' ORDER BY service) AS services, count(*) AS requests, round(sum(duration_s), 4) AS total_duration_s,
       max(duration_s) AS max_duration_s, min(ts) AS first_ts
FROM requests GROUP BY trace_id""")
def _(spark, sf):
    traces = mon.trace_summary(requests(spark, sf))
    return traces.withColumns({"services": F.array_join("services", ","), "total_duration_s": F.round("total_duration_s", 4)})


def sliding_sql(keys: str, measures: dict[str, str], hours: int, step: int) -> str:
    keyed = f"{keys}, " if keys else ""
    made = ", ".join(f"{e} AS {n}" for n, e in measures.items())
    summed = ", ".join(f"sum({n})::BIGINT AS {n}" for n in measures)
    return f"""
steps AS (SELECT {keyed}time_bucket(INTERVAL '{step} hours', ts) AS st, {made} FROM requests GROUP BY ALL),
w AS (SELECT {keyed}st - to_hours(k * {step}) AS window_start, st - to_hours(k * {step}) + to_hours({hours}) AS window_end, {summed}
      FROM steps, range({hours // step}) AS g(k) GROUP BY ALL)"""


T1_SQL = f"WITH {REQUESTS}, " + sliding_sql("method, status_code", {"requests": "count(*)"}, 24, 6) + """
SELECT method, status_code, window_start, window_end, requests, requests / 86400 AS rate FROM w"""


@query("t1_request_rate", T1_SQL)
def _(spark, sf):
    return mon.request_rate(requests(spark, sf), ["method", "status_code"], DAY, 6 * HOUR)


def _quantile_sql() -> str:
    cases = ""
    for i, high in enumerate(mon.LATENCY_BOUNDS):
        low, below = (mon.LATENCY_BOUNDS[i - 1], f"le_{i - 1}") if i else (0, "0")
        cases += (
            f"WHEN le_{i} >= 0.95::DOUBLE * le_6 THEN {low}::DOUBLE + ({high}::DOUBLE - {low}::DOUBLE)"
            f" * ((0.95::DOUBLE * le_6 - {below}) / nullif(le_{i} - {below}, 0)) "
        )
    return f"CASE {cases}ELSE 5 END::DOUBLE"


MEASURES = {f"le_{i}": f"count(*) FILTER (duration_s <= {b})" for i, b in enumerate(mon.LATENCY_BOUNDS)} | {"le_6": "count(*)"}
T2_SQL = f"WITH {REQUESTS}, " + sliding_sql("service", MEASURES, 6, 1) + f"""
, q AS (SELECT service, window_start, window_end, {_quantile_sql()} AS latency FROM w)
SELECT service, window_start, window_end, latency, latency > 1 AS active FROM q"""


@query("t2_slow_windows", T2_SQL)
def _(spark, sf):
    return mon.slow_windows(requests(spark, sf), ["service"], 6 * HOUR, HOUR)


ERRORS = {"errors": "count(*) FILTER (status_code BETWEEN 500 AND 599)", "requests": "count(*)"}
T3_CTE = f"WITH {REQUESTS}, " + sliding_sql("", ERRORS, 6, 1) + """
, e AS (SELECT window_start, window_end, errors, requests, errors / requests AS error_ratio, errors / requests > 0.25::DOUBLE AS active FROM w)"""


@query("t3_error_windows", T3_CTE + " SELECT * FROM e")
def _(spark, sf):
    return mon.error_windows(requests(spark, sf), (), 6 * HOUR, HOUR, threshold=0.25)


ISLANDS = """
, a AS (SELECT window_end AS w_end, window_end - to_hours(row_number() OVER (ORDER BY window_end)::INTEGER) AS island FROM {rows} WHERE active),
i AS (SELECT min(w_end) AS active_from, max(w_end) AS active_until FROM a GROUP BY island)"""


@query("t4_held_alerts", T3_CTE + ISLANDS.format(rows="e") + """
SELECT active_from, active_from + to_hours(3) AS fires_at, active_until FROM i WHERE active_until >= active_from + to_hours(3)""")
def _(spark, sf):
    evaluations = mon.error_windows(requests(spark, sf), (), 6 * HOUR, HOUR, threshold=0.25)
    return mon.held_alerts(evaluations, hold=3 * HOUR, step=HOUR)


@query("t5_down_periods", """
WITH g AS (SELECT user_id AS caller, ts AS down_from, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts), TIMESTAMP '2024-02-01') AS down_until FROM events)
SELECT caller, down_from, down_until, epoch_us(down_until - down_from) / 1000000 AS seconds_down FROM g
WHERE down_until - down_from >= INTERVAL 12 HOURS""")
def _(spark, sf):
    as_of = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    return mon.down_periods(requests(spark, sf), ["caller"], 12 * HOUR, as_of)


T6_SQL = """
WITH v AS (SELECT event_id, ts, event_type AS service, round(value * 100) AS counter FROM events),
d AS (SELECT *, time_bucket(INTERVAL '6 hours', ts) AS st, lag(counter) OVER (PARTITION BY service ORDER BY ts, event_id) AS before FROM v),
r AS (SELECT service, st, count(*) AS samples,
             sum(CASE WHEN before IS NULL THEN 0 WHEN counter < before THEN counter ELSE counter - before END) AS increase FROM d GROUP BY ALL),
w AS (SELECT service, st - to_hours(k * 6) AS window_start, st - to_hours(k * 6) + to_hours(24) AS window_end, sum(increase) AS increase,
             sum(samples)::BIGINT AS samples FROM r, range(4) AS g(k) GROUP BY ALL)"""


def _samples(spark, sf) -> DataFrame:
    # whole numbers, so that sums do not depend on the order of addition
    counter = F.rint(F.col("value") * 100).alias("counter")
    return table(spark, sf, "events").select("event_id", "ts", F.col("event_type").alias("service"), counter)


@query("t6_counter_rate", T6_SQL + " SELECT *, increase / 86400 AS rate, increase / 86400 > 3 AS active FROM w")
def _(spark, sf):
    return mon.counter_rate(_samples(spark, sf), ["service"], "counter", ["ts", "event_id"], DAY, 6 * HOUR, threshold=3.0)


@query("t6_held", T6_SQL + """
, a AS (SELECT service, window_end AS w_end, window_end - to_hours((6 * row_number() OVER (PARTITION BY service ORDER BY window_end))::INTEGER) AS island
        FROM w WHERE increase / 86400 > 3),
i AS (SELECT service, min(w_end) AS active_from, max(w_end) AS active_until FROM a GROUP BY service, island)
SELECT service, active_from, active_from + to_hours(12) AS fires_at, active_until FROM i WHERE active_until >= active_from + to_hours(12)""")
def _(spark, sf):
    return mon.busy_alerts(_samples(spark, sf), ["service"], "counter", ["ts", "event_id"], DAY, 6 * HOUR, 3.0, 12 * HOUR)


@query("t7_callers_over_limit", """
SELECT user_id AS caller, time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS requests, count(*) - 3 AS rejected
FROM events GROUP BY ALL HAVING count(*) > 3""")
def _(spark, sf):
    return mon.callers_over_limit(requests(spark, sf), DAY, 3)


T8_SQL = """
WITH c AS (SELECT event_id, user_id AS caller, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS recent FROM events),
b AS (SELECT *, recent > 4 AS over_limit, max(CASE WHEN recent > 4 THEN ts END) OVER (PARTITION BY caller ORDER BY ts RANGE BETWEEN INTERVAL 2 DAYS PRECEDING AND CURRENT ROW) AS last_over FROM c)
SELECT event_id, caller, {ts} AS ts, recent, over_limit, coalesce(ts < last_over + INTERVAL 2 DAYS, false) AS blocked FROM b"""


@query("t8_sliding_limiter", T8_SQL.format(ts="ts"))
def _(spark, sf):
    rows = requests(spark, sf).select("event_id", "caller", "ts")
    return mon.sliding_limiter(rows, "caller", DAY, 4, 2 * DAY, slice_seconds=5 * DAY)


# --- streams over the same events

def request_stream(spark, sf) -> DataFrame:
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    # the stored times are UTC, whatever the session's zone
    return as_requests(stream).withColumn("ts", F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))


def _plain(df: DataFrame) -> DataFrame:
    """Timestamps without zone, as the stored events have them."""
    utc = {c: F.to_utc_timestamp(c, F.current_timezone()) for c, t in df.dtypes if t == "timestamp"}
    return df.withColumns({c: t.cast("timestamp_ntz") for c, t in utc.items()})


CLOSED = "window_end <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES"


@query("t1_rate_stream", T1_SQL + f" WHERE {CLOSED}")
def _(spark, sf):
    return _plain(streams.drain(streams.rate_stream(request_stream(spark, sf), ["method", "status_code"], DAY, 6 * HOUR), "t1"))


@query("t2_slow_stream", T2_SQL + f" WHERE {CLOSED}")
def _(spark, sf):
    return _plain(streams.drain(streams.slow_stream(request_stream(spark, sf), ["service"], 6 * HOUR, HOUR), "t2"))


@query("t3_error_stream", T3_CTE + f" SELECT * FROM e WHERE {CLOSED}")
def _(spark, sf):
    return _plain(streams.drain(streams.error_stream(request_stream(spark, sf), (), 6 * HOUR, HOUR, threshold=0.25), "t3"))


@query("t4_held_stream", T3_CTE + f", f AS (SELECT * FROM e WHERE {CLOSED})" + ISLANDS.format(rows="f") + """
SELECT 'all' AS series, active_from, active_from + to_hours(3) AS fires_at FROM i WHERE active_until >= active_from + to_hours(3)""")
def _(spark, sf):
    path = new_path(spark, "t4-windows")
    windows = streams.error_stream(request_stream(spark, sf), (), 6 * HOUR, HOUR, threshold=0.25)
    schema = streams.drain(windows.withColumn("series", F.lit("all")), "t4", path).schema
    evaluations = spark.readStream.schema(schema).parquet(f"{path}/rows")
    return _plain(streams.drain(state.held_alert_stream(evaluations, "series", 3 * HOUR, HOUR), "t4-alerts"))


@query("t5_down_stream", """
WITH g AS (SELECT user_id AS caller, ts AS down_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS next_ts FROM events)
SELECT caller, down_from, down_from + INTERVAL 12 HOURS AS alert_at FROM g
WHERE coalesce(next_ts, (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES) - down_from >= INTERVAL 12 HOURS""")
def _(spark, sf):
    heartbeats = request_stream(spark, sf).select("caller", "ts")
    return _plain(streams.drain(state.down_stream(heartbeats, "caller", 12 * HOUR), "t5"))


@query("t6_busy_stream", T6_SQL + f"""
, a AS (SELECT service, window_end AS w_end, window_end - to_hours((6 * row_number() OVER (PARTITION BY service ORDER BY window_end))::INTEGER) AS island
        FROM w WHERE increase / 86400 > 3 AND {CLOSED}),
i AS (SELECT service, min(w_end) AS active_from, max(w_end) AS active_until FROM a GROUP BY service, island)
SELECT service, active_from, active_from + to_hours(12) AS fires_at FROM i WHERE active_until >= active_from + to_hours(12)""")
def _(spark, sf):
    schema = table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    utc = F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())
    samples = events.select("event_id", utc.alias("ts"), F.col("event_type").alias("service"), F.rint(F.col("value") * 100).alias("counter"))
    with state.rocksdb(spark):
        return _plain(streams.drain(state.busy_stream(samples, "service", "counter", "event_id", DAY, 6 * HOUR, 3.0, 12 * HOUR), "t6"))


@query("t7_over_limit_stream", f"""
WITH w AS (SELECT user_id AS caller, time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end,
                  count(*) AS requests, count(*) - 3 AS rejected FROM events GROUP BY ALL)
SELECT * FROM w WHERE requests > 3 AND {CLOSED}""")
def _(spark, sf):
    return _plain(streams.drain(streams.over_limit_stream(request_stream(spark, sf), DAY, 3), "t7"))


@query("t8_limiter_stream", T8_SQL.format(ts="ts"))
def _(spark, sf):
    rows = request_stream(spark, sf).select("event_id", "caller", "ts")
    return _plain(streams.drain(state.limiter_stream(rows, "event_id", "caller", DAY, 4, 2 * DAY, 5 * DAY), "t8"))
