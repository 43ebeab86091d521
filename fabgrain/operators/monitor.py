"""Request counters, latency, alert conditions and request limits over event tables.

A request row has ``ts, trace_id, service, caller, method, route, status_code, duration_s``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabgrain.functions.timeslice import SECOND, islands, micros, trailing, with_history

LABELS = ["method", "route", "status_code"]

# Histogram bounds in seconds; alert windows, evaluation step, thresholds and holding
# times in seconds; request limits.
LATENCY_BOUNDS = [0.01, 0.05, 0.1, 0.5, 1, 5]
RATE_SECONDS = 300
EVALUATION_SECONDS = 15
SLOW_QUANTILE = 0.95
SLOW_SECONDS = 1.0
ERROR_SHARE = 0.05
BUSY_RATE = 0.8
HOLD_SECONDS = 300
BUSY_HOLD_SECONDS = 600
CALLER_WINDOW_SECONDS = 60
CALLER_LIMIT = 1000
SLIDING_SECONDS = 60
SLIDING_LIMIT = 30
BLOCK_SECONDS = 600


def seconds(n: int | Column) -> Column:
    """An interval of ``n`` seconds."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.make_dt_interval(secs=n.cast("decimal(18,6)"))


def moment(df: DataFrame, ts: str, at: Column) -> Column:
    """Microseconds since 1970 as a timestamp of the same type as ``ts``."""
    if dict(df.dtypes)[ts] == "timestamp":
        return F.timestamp_micros(at)
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(at.cast("decimal(24,0)") / SECOND).cast("decimal(18,6)"))


def request_counts(requests: DataFrame, labels: Sequence[str] = tuple(LABELS)) -> DataFrame:
    """Requests per label combination."""
    return requests.groupBy(*labels).agg(F.count("*").alias("requests"))


def bound_counts(duration: str = "duration_s", bounds: Sequence[float] = tuple(LATENCY_BOUNDS)) -> dict[str, Column]:
    """Cumulative counts ``le_0 .. le_n``: durations up to each bound, the last one unbounded."""
    counts = {f"le_{i}": F.count_if(F.col(duration) <= b) for i, b in enumerate(bounds)}
    return {**counts, f"le_{len(bounds)}": F.count(duration)}


def latency_histogram(
    requests: DataFrame, labels: Sequence[str] = tuple(LABELS), bounds: Sequence[float] = tuple(LATENCY_BOUNDS)
) -> DataFrame:
    """Cumulative request counts per bound, with sum and count of durations, per label combination."""
    totals = {"duration_sum": F.sum("duration_s"), "duration_count": F.count("duration_s")}
    counts = bound_counts("duration_s", bounds)
    wide = requests.groupBy(*labels).agg(*[c.alias(n) for n, c in {**counts, **totals}.items()])
    names = [f"{b:g}" for b in bounds] + ["+Inf"]
    rows = F.array(*[F.struct(F.lit(le).alias("le"), F.col(c).alias("cumulative")) for le, c in zip(names, counts)])
    return wide.select(*labels, F.inline(rows), *totals)


def trace_summary(requests: DataFrame) -> DataFrame:
    """Per trace: services touched, requests, total and longest duration, first time.

    Requests are combined per trace and service first, so the list only merges distinct services.
    """
    per_service = requests.groupBy("trace_id", "service").agg(
        F.count("*").alias("n"), F.sum("duration_s").alias("total"), F.max("duration_s").alias("longest"), F.min("ts").alias("first")
    )
    return per_service.groupBy("trace_id").agg(
        F.array_sort(F.collect_list("service")).alias("services"),
        F.sum("n").alias("requests"),
        F.sum("total").alias("total_duration_s"),
        F.max("longest").alias("max_duration_s"),
        F.min("first").alias("first_ts"),
    )


def sliding(
    df: DataFrame, keys: Sequence[str], measures: Mapping[str, Column], length: int, step: int, ts: str = "ts"
) -> DataFrame:
    """Sums of additive ``measures`` over sliding windows ``[start, start+length)`` every ``step`` seconds.

    Rows are counted once per step; only these counts are repeated for the windows they belong to.
    """
    if length % step:
        raise ValueError("the window length must be a multiple of the step")
    at_step = F.window(ts, f"{step} seconds")["start"].alias("_step")
    counted = df.groupBy(*keys, at_step).agg(*[c.alias(n) for n, c in measures.items()])
    return _over_windows(counted, keys, list(measures), length, step)


def _over_windows(counted: DataFrame, keys: Sequence[str], names: Sequence[str], length: int, step: int) -> DataFrame:
    """Sums over sliding windows of what was counted per step, in rows ``(*keys, _step, *names)``."""
    starts = F.sequence(F.col("_step") - seconds(length - step), F.col("_step"), seconds(step))
    return (
        counted.withColumn("window_start", F.explode(starts))
        .groupBy(*keys, "window_start")
        .agg(*[F.sum(n).alias(n) for n in names])
        .withColumn("window_end", F.col("window_start") + seconds(length))
    )


def request_rate(
    requests: DataFrame, labels: Sequence[str] = tuple(LABELS), length: int = RATE_SECONDS, step: int = EVALUATION_SECONDS
) -> DataFrame:
    """Requests per second over sliding windows, per label combination."""
    counted = sliding(requests, labels, {"requests": F.count("*")}, length, step)
    return counted.withColumn("rate", F.col("requests") / length)


def bucket_quantile(q: float, bounds: Sequence[float] = tuple(LATENCY_BOUNDS)) -> Column:
    """Quantile from cumulative counts ``le_0 .. le_n``, linear inside the bucket.

    Buckets start at 0; in the unbounded bucket the answer is the largest bound.
    """
    rank = F.lit(q) * F.col(f"le_{len(bounds)}")
    answer = F.lit(float(bounds[-1]))
    for i in reversed(range(len(bounds))):
        low, below = (float(bounds[i - 1]), F.col(f"le_{i - 1}")) if i else (0.0, F.lit(0))
        inside = low + (float(bounds[i]) - low) * ((rank - below) / F.nullif(F.col(f"le_{i}") - below, F.lit(0)))
        answer = F.when(F.col(f"le_{i}") >= rank, inside).otherwise(answer)
    return F.when(F.col(f"le_{len(bounds)}") > 0, answer)


def slow_windows(
    requests: DataFrame, keys: Sequence[str] = (), length: int = RATE_SECONDS, step: int = EVALUATION_SECONDS,
    q: float = SLOW_QUANTILE, threshold: float = SLOW_SECONDS,
) -> DataFrame:
    """Latency quantile per sliding window and whether it exceeds the threshold."""
    counted = sliding(requests, keys, bound_counts(), length, step)
    return counted.withColumn("latency", bucket_quantile(q)).select(
        *keys, "window_start", "window_end", "latency", (F.col("latency") > threshold).alias("active")
    )


def error_windows(
    requests: DataFrame, keys: Sequence[str] = (), length: int = RATE_SECONDS, step: int = EVALUATION_SECONDS,
    threshold: float = ERROR_SHARE,
) -> DataFrame:
    """Share of 5xx requests per sliding window and whether it exceeds the threshold."""
    measures = {"errors": F.count_if(is_error()), "requests": F.count("*")}
    counted = sliding(requests, keys, measures, length, step)
    share = F.col("errors") / F.col("requests")
    return counted.withColumn("error_ratio", share).select(
        *keys, "window_start", "window_end", "errors", "requests", "error_ratio", (share > threshold).alias("active")
    )


def is_error() -> Column:
    """Whether the status code is 5xx."""
    return F.col("status_code").between(500, 599)


def held_alerts(
    evaluations: DataFrame, keys: Sequence[str] = (), hold: int = HOLD_SECONDS, step: int = EVALUATION_SECONDS,
    at: str = "window_end",
) -> DataFrame:
    """Alerts that fire: the condition was ``active`` at every step for ``hold`` seconds.

    One row per firing run: ``active_from``, ``fires_at`` and ``active_until`` (last active step). A
    step without a row counts as inactive.
    """
    width = step * SECOND
    # evaluations sit on the step grid; the offset keeps their exact time
    points = evaluations.where("active").select(
        *keys, F.floor(micros(evaluations, at) / width).alias("_step_no"), F.pmod(micros(evaluations, at), F.lit(width)).alias("_offset")
    )
    runs = islands(points, [*keys, "_offset"], "_step_no").where(F.col("last_step") - F.col("first_step") >= -(-hold // step))
    time = lambda n: moment(evaluations, at, n * width + F.col("_offset"))
    return runs.select(
        *keys,
        time(F.col("first_step")).alias("active_from"),
        time(F.col("first_step") + (-(-hold // step))).alias("fires_at"),
        time(F.col("last_step")).alias("active_until"),
    )


def down_periods(
    heartbeats: DataFrame, keys: Sequence[str], threshold: int = HOLD_SECONDS, as_of: Column | None = None, ts: str = "ts"
) -> DataFrame:
    """Gaps of at least ``threshold`` seconds between heartbeats: ``down_from, down_until, seconds_down``.

    Heartbeats are reduced to the first and last per threshold-long slot before being put in order;
    a gap inside a slot is always too short. With ``as_of`` the time since the last heartbeat counts.
    """
    slot = F.floor(micros(heartbeats, ts) / (threshold * SECOND)).alias("_slot")
    slots = heartbeats.groupBy(*keys, slot).agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"))
    following = F.lead("_first").over(Window.partitionBy(*keys).orderBy("_slot"))
    gaps = slots.withColumn("down_until", F.coalesce(following, as_of) if as_of is not None else following)
    apart = micros(gaps, "down_until") - micros(gaps, "_last")
    return gaps.where(apart >= threshold * SECOND).select(
        *keys, F.col("_last").alias("down_from"), "down_until", (apart / SECOND).alias("seconds_down")
    )


def counter_rate(
    samples: DataFrame, keys: Sequence[str], value: str, order: Sequence[str] = ("ts",), length: int = RATE_SECONDS,
    step: int = EVALUATION_SECONDS, threshold: float = BUSY_RATE, ts: str = "ts",
) -> DataFrame:
    """Increase per second of a counter over sliding windows; a drop counts as a restart from 0.

    Each sample's increase over the one before it counts at the sample's time, whichever windows the two lie in; the
    first sample of a counter has none. Rates are not extrapolated to the window's borders. Samples are worked off in
    evaluation steps; the second ordering, over one row per step, joins a step's first sample to the last one before.
    """
    keys = list(keys)
    placed = samples.withColumn("_step", F.window(ts, f"{step} seconds")["start"])
    inside = Window.partitionBy(*keys, "_step").orderBy(*order)
    now, before = F.col(value), F.lag(value).over(inside)
    place = F.struct(*order)
    steps = (
        placed.withColumn("_grown", _growth(now, before))
        .groupBy(*keys, "_step")
        .agg(
            F.sum("_grown").alias("_grown"), F.count("*").alias("samples"),
            F.min_by(value, place).alias("_first"), F.max_by(value, place).alias("_last"),
        )
    )
    previous = F.lag("_last").over(Window.partitionBy(*keys).orderBy("_step"))
    counted = steps.select(*keys, "_step", (F.col("_grown") + _growth(F.col("_first"), previous)).alias("increase"), "samples")
    rate = F.col("increase") / length
    return _over_windows(counted, keys, ["increase", "samples"], length, step).withColumn("rate", rate).withColumn("active", rate > threshold)


def _growth(now: Column, before: Column) -> Column:
    """Increase of a counter from one sample to the next."""
    return F.when(before.isNull(), 0.0).when(now < before, now).otherwise(now - before)


def busy_alerts(
    samples: DataFrame, keys: Sequence[str], value: str, order: Sequence[str] = ("ts",), length: int = RATE_SECONDS,
    step: int = EVALUATION_SECONDS, threshold: float = BUSY_RATE, hold: int = BUSY_HOLD_SECONDS, ts: str = "ts",
) -> DataFrame:
    """Alerts of counters whose rate exceeded the threshold at every step for ``hold`` seconds."""
    return held_alerts(counter_rate(samples, keys, value, order, length, step, threshold, ts), keys, hold, step)


def callers_over_limit(
    requests: DataFrame, window_seconds: int = CALLER_WINDOW_SECONDS, limit: int = CALLER_LIMIT
) -> DataFrame:
    """Callers with more than ``limit`` requests in a fixed window, with the surplus."""
    at = F.window("ts", f"{window_seconds} seconds")["start"].alias("window_start")
    counted = requests.groupBy("caller", at).agg(F.count("*").alias("requests"))
    return counted.where(F.col("requests") > limit).withColumn("rejected", F.col("requests") - limit)


def sliding_limiter(
    requests: DataFrame, key: str = "caller", window_seconds: int = SLIDING_SECONDS, limit: int = SLIDING_LIMIT,
    block_seconds: int = BLOCK_SECONDS, slice_seconds: int = 3600, ts: str = "ts",
) -> DataFrame:
    """Every request with the caller's requests in the window ending at it, and whether it is blocked.

    More than ``limit`` requests block the caller for ``block_seconds`` from then on; blocked requests
    still count. A caller's requests are worked off in time slices that carry the history they need,
    so a busy caller spreads over many tasks.
    """
    history = (window_seconds + block_seconds) * SECOND
    copies = with_history(requests.withColumn("_at", micros(requests, ts)), "_at", history, slice_seconds * SECOND)
    counted = copies.withColumn("recent", F.count("*").over(trailing([key], "_at", window_seconds * SECOND)))
    counted = counted.withColumn("over_limit", F.col("recent") > limit)
    last_over = F.max(F.when(F.col("over_limit"), F.col("_at"))).over(trailing([key], "_at", block_seconds * SECOND))
    return (
        counted.withColumn("_last_over", last_over)
        .where("own")
        .withColumn("blocked", F.coalesce(F.col("_at") < F.col("_last_over") + block_seconds * SECOND, F.lit(False)))
        .drop("_at", "_last_over", "slice", "own")
    )
