"""Request measures in batch, and the streams against their batch twins over several micro-batches."""

import os
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fabgrain.functions.timeslice import SECOND
from fabgrain.operators import monitor as mon
from fabgrain.streaming import requests as streams
from fabgrain.streaming import state

START = datetime(2026, 1, 1)
REQUEST = "event_id long, ts timestamp, trace_id string, service string, caller string, method string, route string, status_code int, duration_s double"


def at(seconds):
    return START + timedelta(seconds=seconds)


def request(i, seconds, caller="a", status=200, duration=0.02, trace="t", service="s"):
    return (i, at(seconds), trace, service, caller, "GET", "/r", status, float(duration))


def rows_of(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_histogram_bounds_are_inclusive(spark):
    durations = [0.01, 0.010001, 0.05, 0.1, 0.5, 1, 5, 7]
    df = spark.createDataFrame([request(i, i, duration=d) for i, d in enumerate(durations)], REQUEST)
    got = mon.latency_histogram(df).collect()
    assert [(r.le, r.cumulative) for r in got] == [("0.01", 1), ("0.05", 3), ("0.1", 4), ("0.5", 5), ("1", 6), ("5", 7), ("+Inf", 8)]
    assert got[0].duration_count == 8 and got[0].duration_sum == pytest.approx(sum(durations))
    assert rows_of(mon.request_counts(df)) == [("GET", "/r", 200, 8)]


@pytest.mark.parametrize("counts, q, wanted", [
    ([10, 10, 10, 10, 10, 10, 10], 0.5, 0.005), ([0, 0, 0, 0, 10, 10, 10], 0.95, 0.975),
    ([0, 0, 0, 0, 0, 0, 10], 0.95, 5.0), ([0, 4, 4, 4, 4, 8, 8], 0.75, 3.0), ([0] * 7, 0.95, None),
])
def test_bucket_quantile(spark, counts, q, wanted):
    df = spark.createDataFrame([tuple(counts)], ", ".join(f"le_{i} long" for i in range(7)))
    got = df.select(mon.bucket_quantile(q)).first()[0]
    assert got == (pytest.approx(wanted) if wanted is not None else None)


def test_trace_summary(spark):
    rows = [request(1, 5, trace="x", service="b", duration=1), request(2, 3, trace="x", service="a", duration=2), request(3, 9, trace="x", service="b", duration=4)]
    got = mon.trace_summary(spark.createDataFrame(rows, REQUEST)).first()
    assert (got.services, got.requests, got.total_duration_s, got.max_duration_s, got.first_ts) == (["a", "b"], 3, 7.0, 4.0, at(3))


def test_sliding_windows_match_counting(spark):
    times = [0, 14, 15, 200, 299, 300, 301, 1000]
    df = spark.createDataFrame([request(i, t) for i, t in enumerate(times)], REQUEST)
    got = {r.window_start: (r.requests, r.rate) for r in mon.request_rate(df).collect()}
    wanted = {}
    for start in range(-300, 1001, 15):
        n = sum(start <= t < start + 300 for t in times)
        if n:
            wanted[at(start)] = (n, n / 300)
    assert got == wanted


def evaluations(spark, active):
    return spark.createDataFrame([("x", at(15 * i), a) for i, a in enumerate(active)], "series string, window_end timestamp, active boolean")


def test_alerts_fire_after_holding(spark):
    # true for 4 minutes, false, then true for 6 minutes
    active = [True] * 17 + [False] + [True] * 25 + [False]
    got = mon.held_alerts(evaluations(spark, active), ["series"])
    assert rows_of(got) == [("x", at(18 * 15), at(18 * 15 + 300), at(42 * 15))]
    missing = evaluations(spark, [True] * 40).where(F.col("window_end") != F.lit(at(300)))
    assert rows_of(mon.held_alerts(missing, ["series"]), "active_from") == []


@pytest.mark.parametrize("slice_steps", [1, 3, 1000])
def test_islands_join_across_slices(spark, slice_steps):
    from fabgrain.functions.timeslice import islands

    steps = [0, 1, 2, 5, 6, 7, 8, 9, 10, 20]
    df = spark.createDataFrame([("k", s) for s in steps], "k string, s long")
    assert rows_of(islands(df, ["k"], "s", slice_steps)) == [("k", 0, 2), ("k", 5, 10), ("k", 20, 20)]


def test_error_ratio_and_slow_windows(spark):
    rows = [request(i, i, status=500 if i % 10 == 0 else 200, duration=2 if i < 40 else 0.02) for i in range(100)]
    df = spark.createDataFrame(rows, REQUEST)
    errors = mon.error_windows(df, length=300, step=300).first()
    assert (errors.errors, errors.requests, errors.error_ratio, errors.active) == (10, 100, 0.1, True)
    slow = mon.slow_windows(df, length=300, step=300).first()
    # 60 of 100 within 0.05 s, the rest between 1 and 5 s: rank 95 lies at 35/40 of that bucket
    assert slow.latency == pytest.approx(1 + 4 * 35 / 40) and slow.active


def test_down_periods(spark):
    beats = [0, 100, 400, 699, 2000]
    df = spark.createDataFrame([request(i, t) for i, t in enumerate(beats)] + [request(9, 50, caller="b")], REQUEST)
    got = mon.down_periods(df, ["caller"], as_of=F.lit(at(2100)))
    assert rows_of(got) == [("a", at(100), at(400), 300.0), ("a", at(699), at(2000), 1301.0), ("b", at(50), at(2100), 2050.0)]
    assert rows_of(mon.down_periods(df, ["caller"]), "caller", "down_from") == [("a", at(100)), ("a", at(699))]


@pytest.mark.parametrize("step", [15, 60, 300])
def test_counter_rate_survives_restarts_and_crosses_windows(spark, step):
    samples = [(0, 100.0), (60, 160.0), (61, 170.0), (120, 5.0), (180, 25.0), (299, 25.0), (300, 1000.0), (310, 1300.0)]
    df = spark.createDataFrame([("p", at(t), v) for t, v in samples], "process string, ts timestamp, cpu double")
    got = {r.window_start: r for r in mon.counter_rate(df, ["process"], "cpu", step=step).collect()}
    first, second = got[at(0)], got[at(300)]
    assert (first.increase, first.samples, first.active) == (70 + 5 + 20, 6, False) and first.rate == pytest.approx(95 / 300)
    assert (second.increase, second.samples, second.active) == (975 + 300, 2, True)


@pytest.mark.parametrize("rate, fires", [(0.82, True), (0.78, False)])
def test_busy_alert_needs_the_rate_for_ten_minutes(spark, rate, fires):
    df = spark.createDataFrame([("p", at(t), t * rate) for t in range(0, 1801, 15)], "process string, ts timestamp, cpu double")
    got = mon.busy_alerts(df, ["process"], "cpu").collect()
    assert [r.fires_at - r.active_from for r in got] == ([timedelta(seconds=600)] if fires else [])
    short = df.where(F.col("ts") < F.lit(at(800)))
    assert mon.busy_alerts(short, ["process"], "cpu").collect() == []


def test_fixed_window_limit_is_strict(spark):
    df = spark.range(1000).select(F.lit("ok").alias("caller"), F.lit(at(30)).alias("ts"))
    over = spark.range(1001).select(F.lit("over").alias("caller"), F.lit(at(30)).alias("ts"))
    assert rows_of(mon.callers_over_limit(df.union(over)), "caller", "requests", "rejected") == [("over", 1001, 1)]


def bursts():
    rng = np.random.default_rng(3)
    times = np.sort(np.concatenate([rng.uniform(0, 9000, 300), rng.uniform(3500, 3700, 60), rng.uniform(7190, 7230, 50)]))
    return [request(i, float(t), caller="busy") for i, t in enumerate(times)] + [request(1000 + i, i * 40, caller="calm") for i in range(200)]


def limiter_by_hand(rows):
    out = []
    for caller in {r[4] for r in rows}:
        mine = sorted((r for r in rows if r[4] == caller), key=lambda r: r[1])
        recent = {r[0]: sum(r[1] - timedelta(seconds=60) <= o[1] <= r[1] for o in mine) for r in mine}
        for r in mine:
            over = [o[1] for o in mine if recent[o[0]] > 30 and o[1] <= r[1]]
            out.append((r[0], recent[r[0]], recent[r[0]] > 30, bool(over) and r[1] < max(over) + timedelta(seconds=600)))
    return sorted(out)


@pytest.mark.parametrize("slice_seconds", [50, 700, 100000])
def test_sliding_limiter(spark, slice_seconds):
    rows = bursts()
    got = mon.sliding_limiter(spark.createDataFrame(rows, REQUEST), slice_seconds=slice_seconds)
    wanted = limiter_by_hand(rows)
    assert rows_of(got, "event_id", "recent", "over_limit", "blocked") == wanted
    assert any(w[3] for w in wanted) and not all(w[3] for w in wanted)


def test_batch_results_do_not_depend_on_the_time_zone(spark):
    rows = [request(i, i * 1800) for i in range(100)]
    df = spark.createDataFrame(rows, REQUEST).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    plans = lambda: [mon.down_periods(df, ["caller"], 900), mon.sliding_limiter(df, limit=1).select("event_id", "recent", "blocked")]
    wanted = [rows_of(p) for p in plans()]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        ntz = df.select("ts").first()[0]
        got = [rows_of(p) for p in plans()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == wanted and ntz is not None


# --- streams


def as_stream(spark, folder, rows, schema, cuts, order="ts"):
    """A file stream that delivers the rows in several batches, in time order."""
    path = f"{folder}/in"
    bounds = [None, *cuts, None]
    for i, (low, high) in enumerate(zip(bounds, bounds[1:])):
        df = spark.createDataFrame(rows, schema)
        df = df.where(F.col(order) >= F.lit(low)) if low else df
        df = df.where(F.col(order) < F.lit(high)) if high else df
        df.coalesce(1).write.mode("append").parquet(path)
        for name in os.listdir(path):
            full = os.path.join(path, name)
            if name.endswith(".parquet") and os.path.getmtime(full) > 10**9:
                os.utime(full, (1000 + i * 100, 1000 + i * 100))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


CUTS = [at(1500), at(3600), at(7200)]


@pytest.fixture
def traffic(spark, folder):
    rng = np.random.default_rng(11)
    rows = [
        request(i, float(t), caller=f"c{i % 3}", status=500 if rng.random() < (0.5 if 2000 < t < 4000 else 0.02) else 200, duration=float(rng.exponential(0.8)))
        for i, t in enumerate(np.sort(rng.uniform(0, 9000, 900)))
    ]
    newest = max(r[1] for r in rows)
    return spark.createDataFrame(rows, REQUEST), as_stream(spark, folder, rows, REQUEST, CUTS), F.lit(newest - timedelta(minutes=10))


@pytest.mark.parametrize("name", ["rate", "slow", "error", "limit"])
def test_window_streams_match_batch(spark, folder, traffic, name):
    batch, stream, closed = traffic
    wanted, got = {
        "rate": lambda: (mon.request_rate(batch, step=60), streams.rate_stream(stream, step=60)),
        "slow": lambda: (mon.slow_windows(batch, ["caller"], step=60), streams.slow_stream(stream, ["caller"], step=60)),
        "error": lambda: (mon.error_windows(batch, step=60), streams.error_stream(stream, step=60)),
        "limit": lambda: (mon.callers_over_limit(batch, limit=3).withColumn("window_end", F.col("window_start") + mon.seconds(60)), streams.over_limit_stream(stream, limit=3)),
    }[name]()
    got = streams.drain(got, name, f"{folder}/{name}")
    columns = sorted(wanted.columns)
    wanted = rows_of(wanted.where(F.col("window_end") <= closed), *columns)
    assert rows_of(got, *columns) == wanted and wanted


def test_held_alert_stream_matches_batch(spark, folder):
    rng = np.random.default_rng(2)
    active = np.repeat(rng.random(40) < 0.6, rng.integers(1, 40, 40)).tolist()
    rows = [("x", at(15 * i), a) for i, a in enumerate(active)]
    schema = "series string, window_end timestamp, active boolean"
    stream = as_stream(spark, folder, rows, schema, [at(1000), at(1015), at(4000)], "window_end")
    got = streams.drain(state.held_alert_stream(stream, "series"), "held", f"{folder}/held")
    wanted = mon.held_alerts(spark.createDataFrame(rows, schema), ["series"])
    assert rows_of(got) == rows_of(wanted, "series", "active_from", "fires_at") and wanted.count() > 1


def test_down_stream_matches_batch(spark, folder):
    rng = np.random.default_rng(4)
    rows = [(c, at(float(t))) for c in ("a", "b", "c") for t in np.sort(rng.uniform(0, 9000, 40))] + [("gone", at(10))] + [("a", at(9300))]
    schema = "caller string, ts timestamp"
    stream = as_stream(spark, folder, rows, schema, CUTS)
    got = streams.drain(state.down_stream(stream, "caller", 300), "down", f"{folder}/down")
    # a silence still going on is known once the watermark, ten minutes behind, has passed its limit
    batch = mon.down_periods(spark.createDataFrame(rows, schema), ["caller"], 300, F.lit(at(8700)))
    wanted = batch.select("caller", "down_from", (F.col("down_from") + mon.seconds(300)).alias("alert_at"))
    assert rows_of(got) == rows_of(wanted) and ("gone", at(10), at(310)) in rows_of(got)


def test_limiter_stream_matches_batch(spark, folder):
    rows = bursts()
    stream = as_stream(spark, folder, rows, REQUEST, CUTS)
    got = streams.drain(state.limiter_stream(stream, "event_id", slice_seconds=2000), "limiter", f"{folder}/limiter")
    assert rows_of(got, "event_id", "recent", "over_limit", "blocked") == limiter_by_hand(rows)


@pytest.mark.parametrize("slice_seconds", [100, 100_000])
def test_limiter_stream_counts_late_rows_at_their_time(spark, folder, slice_seconds):
    times = np.random.default_rng(6).integers(0, 400, 90).tolist()
    rows = [request(i + 1, float(t), caller="ab"[i % 2]) for i, t in enumerate(times)]
    seen, overs, wanted = [], set(), []
    for batch in (rows[:30], rows[30:60], rows[60:]):
        seen += batch
        recent = {r[0]: sum(o[4] == r[4] and r[1] - timedelta(seconds=60) <= o[1] <= r[1] for o in seen) for r in seen}
        overs |= {(r[4], r[1]) for r in seen if recent[r[0]] > 7}
        wanted += [(r[0], recent[r[0]], recent[r[0]] > 7, any(c == r[4] and o <= r[1] < o + timedelta(seconds=30) for c, o in overs)) for r in batch]
    stream = as_stream(spark, folder, rows, REQUEST, [31, 61], "event_id")
    got = state.limiter_stream(stream, "event_id", limit=7, block_seconds=30, slice_seconds=slice_seconds)
    got = rows_of(streams.drain(got, "late", f"{folder}/late"), "event_id", "recent", "over_limit", "blocked")
    assert got == sorted(wanted) and 0 < sum(w[3] and not w[2] for w in wanted)


def test_busy_stream_matches_batch(spark, folder):
    """Samples in shuffled files, one file per batch, with restarts and pauses."""
    rng = np.random.default_rng(7)
    rows = []
    for process in ("a", "b"):
        at_s, total = 0.0, 0.0
        for i in range(900):
            at_s += float(rng.choice([3, 15, 40])) + (2000 if i in (200, 500) else 0)
            total = 0.0 if rng.random() < 0.01 else total + float(rng.integers(0, 60 if (i // 80) % 2 else 15))
            rows.append((process, at(at_s), i, total))
    order = np.arange(len(rows)) + rng.integers(0, 25, len(rows))  # a little out of order, within the delay
    rows = [rows[i] for i in np.argsort([r[1].timestamp() for r in rows], kind="stable")]
    rows = [rows[i] for i in np.argsort(order, kind="stable")]
    schema = "process string, ts timestamp, n long, cpu double"
    for part in range(4):
        cut = rows[part * len(rows) // 4 : (part + 1) * len(rows) // 4]
        spark.createDataFrame(cut, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    with state.rocksdb(spark):
        got = streams.drain(state.busy_stream(stream, "process", "cpu", "n", delay="30 minutes"), "busy", f"{folder}/busy")
    newest = max(r[1] for r in rows) - timedelta(minutes=30)
    wanted = mon.busy_alerts(spark.createDataFrame(rows, schema), ["process"], "cpu", ["ts", "n"]).where(F.col("fires_at") <= F.lit(newest))
    assert rows_of(got) == rows_of(wanted, "process", "active_from", "fires_at") and wanted.count() > 2


def test_one_callers_hour_spreads_over_groups(spark):
    rows = [request(i, i * 3600 / 9000, caller="busy") for i in range(9000)] + [request(9000 + i, i * 3.6, caller=f"c{i}") for i in range(1000)]
    df = spark.createDataFrame(rows, REQUEST).select("event_id", "caller", F.unix_micros("ts").alias("at"))
    sizes = [r["count"] for r in state.dealt(df, "caller", 660 * SECOND, 300 * SECOND, 4).groupBy("deal", "slice").count().collect()]
    assert max(sizes) < 0.12 * sum(sizes)
