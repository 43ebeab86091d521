"""Stateful stream operators: held alerts, liveness, busy counters and the sliding request limiter.

Each keeps a small state per key with ``applyInPandasWithState``, or several states and timers with
``transformWithStateInPandas``; the batch twins are in :mod:`fabgrain.operators.monitor`. Time columns are TIMESTAMPs.
"""

from __future__ import annotations

import contextlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from fabgrain.functions.timeslice import SECOND, with_history
from fabgrain.operators.monitor import (
    BLOCK_SECONDS, BUSY_HOLD_SECONDS, BUSY_RATE, EVALUATION_SECONDS, HOLD_SECONDS, RATE_SECONDS, SLIDING_LIMIT, SLIDING_SECONDS,
)

DELAY = "10 minutes"


def held_alert_stream(
    evaluations: DataFrame, key: str, hold: int = HOLD_SECONDS, step: int = EVALUATION_SECONDS, at: str = "window_end"
) -> DataFrame:
    """Alerts ``(key, active_from, fires_at)``, each written once, when the condition has held.

    ``evaluations`` has ``active`` per key and step, arriving in time order.
    """
    needed = -(-hold // step) * step * SECOND
    # helpers live inside: functions sent to the tasks must not need this package there
    times = lambda micros: pd.to_datetime(pd.Series(micros, dtype="int64"), unit="us", utc=True)

    def advance(group, batches, state):
        start, last, fired = state.get if state.exists else (-1, -1, False)
        seen = pd.concat([b[["at", "active"]] for b in batches]).sort_values("at")
        alerts = []
        for now, active in zip(seen["at"].tolist(), seen["active"].tolist()):
            if not active:
                start, fired = -1, False
                continue
            if start < 0 or now - last != step * SECOND:
                start, fired = now, False
            last = now
            if not fired and now - start >= needed:
                alerts.append((group[0], start, now))
                fired = True
        state.update((start, last, fired))
        if alerts:
            yield pd.DataFrame({
                key: [a[0] for a in alerts], "active_from": times([a[1] for a in alerts]), "fires_at": times([a[2] for a in alerts]),
            })

    key_type = dict(evaluations.dtypes)[key]
    return (
        evaluations.select(key, F.unix_micros(at).alias("at"), F.coalesce("active", F.lit(False)).alias("active"))
        .groupBy(key)
        .applyInPandasWithState(
            advance, f"`{key}` {key_type}, active_from timestamp, fires_at timestamp",
            "start long, last long, fired boolean", "append", GroupStateTimeout.NoTimeout,
        )
    )


def down_stream(heartbeats: DataFrame, key: str, threshold: int = HOLD_SECONDS, delay: str = DELAY, ts: str = "ts") -> DataFrame:
    """Alerts ``(key, down_from, alert_at)`` once a target has been silent for ``threshold`` seconds.

    A silence is reported by the next heartbeat, or by a timeout when the watermark passes its end.
    Each batch is reduced to the first and last heartbeat per threshold-long slot as it is read.
    """
    gap = threshold * SECOND
    times = lambda micros: pd.to_datetime(pd.Series(micros, dtype="int64"), unit="us", utc=True)

    def advance(group, batches, state):
        (last,) = state.get if state.exists else (-1,)
        silences = []
        if state.hasTimedOut:
            silences.append(last)
            # nothing more to wait for; the next heartbeat starts over
            state.remove()
        else:
            slots: dict[int, tuple[int, int]] = {}
            for batch in batches:
                at = np.sort(batch["at"].to_numpy())
                cuts = np.unique(at // gap, return_index=True)
                for slot, part in zip(cuts[0].tolist(), np.split(at, cuts[1][1:])):
                    low, high = slots.get(slot, (int(part[0]), int(part[-1])))
                    slots[slot] = (min(low, int(part[0])), max(high, int(part[-1])))
            for slot in sorted(slots):
                low, high = slots[slot]
                if 0 <= last and low - last >= gap:
                    silences.append(last)
                last = max(last, high)
            state.update((last,))
            # not before the watermark: a timeout in the past is refused
            state.setTimeoutTimestamp(max((last + gap) // 1000, state.getCurrentWatermarkMs() + 1))
        if silences:
            yield pd.DataFrame({
                key: [group[0]] * len(silences), "down_from": times(silences), "alert_at": times([s + gap for s in silences]),
            })

    key_type = dict(heartbeats.dtypes)[key]
    return (
        heartbeats.withWatermark(ts, delay)
        .select(key, ts, F.unix_micros(ts).alias("at"))
        .groupBy(key)
        .applyInPandasWithState(
            advance, f"`{key}` {key_type}, down_from timestamp, alert_at timestamp",
            "last long", "append", GroupStateTimeout.EventTimeTimeout,
        )
    )


def dealt(requests: DataFrame, key: str, span: int, width: int, deals: int) -> DataFrame:
    """Rows with the group they are worked off in: ``deal``, a share of the callers, and ``slice``, a stretch of time.

    Many callers share a deal, so groups are few; one busy caller's rows spread over its slices. Rows near the end of a slice
    appear in the following ones too, within ``span``.
    """
    return with_history(requests, "at", span, width).withColumn("deal", F.pmod(F.xxhash64(key), F.lit(deals)).cast("int"))


def limiter_stream(
    requests: DataFrame, request_id: str, key: str = "caller", window_seconds: int = SLIDING_SECONDS,
    limit: int = SLIDING_LIMIT, block_seconds: int = BLOCK_SECONDS, slice_seconds: int = 900, delay: str = DELAY, ts: str = "ts",
    deals: int | None = None,
) -> DataFrame:
    """Every request with ``recent``, ``over_limit`` and ``blocked``, as it arrives.

    State is kept per share of the callers and time slice (:func:`dealt`; as many shares as shuffle partitions), and dropped
    once the watermark has passed the slice. It holds a count per caller and moment and the moments over the limit, back to
    the watermark, so that a late request counts what had come before its own time. Answers already given do not change.
    """
    window, block, width = window_seconds * SECOND, block_seconds * SECOND, slice_seconds * SECOND
    deals = deals or int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def advance(group, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        callers, times, counts, over_callers, over_times = (list(x) for x in state.get) if state.exists else ([], [], [], [], [])
        new = pd.concat(list(batches)).sort_values(["at", request_id])
        code, names = pd.factorize(pd.Series([*callers, *over_callers, *new[key].tolist()], dtype="object"), use_na_sentinel=False)
        old, gone = len(callers), len(callers) + len(over_callers)
        # one number per caller and moment, in whose order a caller's window is a range
        base = min([*times, *over_times, int(new["at"].min())]) - window - block
        room = max([*times, *over_times, int(new["at"].max())]) - base + 1
        place = lambda codes, at: codes.astype("int64") * room + (np.asarray(at, dtype="int64") - base)
        now = place(code[gone:], new["at"])
        spots, where = np.unique(np.concatenate([place(code[:old], times), now]), return_inverse=True)
        count = np.bincount(where, np.concatenate([counts, np.ones(len(now))]), len(spots)).astype("int64")
        upto = np.concatenate([[0], np.cumsum(count)])
        # rows at the same time count each other, as in a range frame
        recent = upto[1:] - upto[np.searchsorted(spots, spots - window, side="left")]
        over = np.union1d(place(code[old:gone], over_times), spots[recent > limit])
        last_over = np.concatenate([[np.iinfo("int64").min // 2], over])[np.searchsorted(over, now, side="right")]
        counted = recent[np.searchsorted(spots, now)]
        # the last one of another caller lies too far back, as there is room for a window and a block between callers
        out = new[[request_id, key, ts]].assign(recent=counted, over_limit=counted > limit, blocked=now < last_over + block)
        own = new["own"].to_numpy()
        if own.any():
            yield out[own]
        since = min(max([*times, int(new["at"].max())]), state.getCurrentWatermarkMs() * 1000)
        at, over_at = spots % room + base, over % room + base
        held, kept = at >= since - window, over_at >= since - block
        state.update((names[(spots // room)[held]].tolist(), at[held].tolist(), count[held].tolist(), names[(over // room)[kept]].tolist(), over_at[kept].tolist()))
        end_ms = (int(group[1]) + 1) * width // 1000
        state.setTimeoutTimestamp(max(end_ms, state.getCurrentWatermarkMs() + 1))

    types = dict(requests.dtypes)
    prepared = requests.withWatermark(ts, delay).select(request_id, key, ts, F.unix_micros(ts).alias("at"))
    return (
        dealt(prepared, key, window + block, width, deals)
        .groupBy("deal", "slice")
        .applyInPandasWithState(
            advance,
            f"`{request_id}` {types[request_id]}, `{key}` {types[key]}, `{ts}` timestamp, recent long, over_limit boolean, blocked boolean",
            f"callers array<{types[key]}>, times array<long>, counts array<long>, over_callers array<{types[key]}>, over_times array<long>",
            "append", GroupStateTimeout.EventTimeTimeout,
        )
    )


def busy_stream(
    samples: DataFrame, key: str, value: str, tie: str, length: int = RATE_SECONDS, step: int = EVALUATION_SECONDS,
    threshold: float = BUSY_RATE, hold: int = BUSY_HOLD_SECONDS, delay: str = DELAY, ts: str = "ts",
) -> DataFrame:
    """Alerts ``(key, active_from, fires_at)`` of counters whose rate exceeded the threshold at every step for ``hold`` seconds,
    each written once: :func:`fabgrain.operators.monitor.busy_alerts` as a stream.

    Samples wait in a list per counter until the watermark has passed the end of their step; a timer then puts them in order
    of time and ``tie`` (a whole number), adds up what the counter grew, and evaluates the windows that end there. Of a
    counter stay its last value, the growth per step of one window, and how long it has been busy. Needs the state store that
    holds several states per key; :func:`rocksdb` selects it.
    """
    if length % step:
        raise ValueError("the window length must be a multiple of the step")
    width, needed, steps = step * SECOND, -(-hold // step) * step * SECOND, length // step

    class Busy(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.waiting = handle.getListState("waiting", "at long, tie long, value double")
            self.past = handle.getValueState("past", "held string")

        def handleInputRows(self, key, rows, timerValues):
            first = None
            for frame in rows:
                if len(frame):
                    self.waiting.appendList(list(zip(frame["at"].tolist(), frame["tie"].tolist(), frame["value"].tolist())))
                    least = int(frame["at"].min())
                    first = least if first is None else min(first, least)
            if first is not None:
                self.handle.registerTimer(((first // width + 1) * width) // 1000)
            return iter([])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            closed = timerValues.getCurrentWatermarkInMs() * 1000 // width  # steps before this one are complete
            rows = sorted(self.waiting.get())
            ready, later = [r for r in rows if r[0] // width < closed], [r for r in rows if r[0] // width >= closed]
            # last value, growth by step, next step to evaluate, start of the busy run and whether it has fired
            last, grown, upto, since, fired = json.loads(self.past.get()[0]) if self.past.exists() else (None, {}, None, None, False)
            grown = {int(k): v for k, v in grown.items()}
            for at, _, now in ready:
                more = 0.0 if last is None else now if now < last else now - last
                grown[at // width] = grown.get(at // width, 0.0) + more
                last = now
            alerts = []
            current = min(grown, default=closed) if upto is None else upto
            while current < closed and grown:
                grown = {k: v for k, v in grown.items() if k > current - steps}
                if not any(k <= current for k in grown):  # nothing in this window
                    since, fired, current = None, False, min(grown, default=closed)
                    continue
                end = (current + 1) * width
                if sum(v for k, v in grown.items() if k <= current) / length > threshold:
                    since = end if since is None else since
                    if not fired and end - since >= needed:
                        alerts.append((since, end))
                        fired = True
                else:
                    since, fired = None, False
                current += 1
            if not grown:
                since, fired, current = None, False, None
            if later:
                self.waiting.put(later)
                self.handle.registerTimer(((later[0][0] // width + 1) * width) // 1000)
            else:
                self.waiting.clear()
            if grown:
                self.handle.registerTimer(((closed + 1) * width) // 1000)
            self.past.update((json.dumps((last, grown, current, since, fired)),))
            if alerts:
                moments = lambda micros: pd.to_datetime(pd.Series(micros, dtype="int64"), unit="us", utc=True)
                yield pd.DataFrame({name: [key[0]] * len(alerts), "active_from": moments([a for a, _ in alerts]), "fires_at": moments([e for _, e in alerts])})

        def close(self):
            pass

    name, kind = key, dict(samples.dtypes)[key]
    return (
        samples.withWatermark(ts, delay)
        .select(key, ts, F.unix_micros(ts).alias("at"), F.col(tie).cast("long").alias("tie"), F.col(value).cast("double").alias("value"))
        .groupBy(key)
        .transformWithStateInPandas(Busy(), f"`{key}` {kind}, active_from timestamp, fires_at timestamp", "Append", "EventTime")
    )


@contextlib.contextmanager
def rocksdb(spark: SparkSession):
    """Streams started inside use the state store that :func:`busy_stream` needs."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(setting, before) if before is not None else spark.conf.unset(setting)
