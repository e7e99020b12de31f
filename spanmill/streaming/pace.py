"""Rolling pace over a live sequence: the batch forms, and their Structured Streaming twins."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanmill.functions.text import parsed_seconds

SPAN, SILENCE, SIZE = 15.0, 2.0, 2.0


def rolling_pace(points: DataFrame, keys: Sequence[str], at: str, count: str, span: float = SPAN, silence: float = SILENCE, size: float = SIZE) -> DataFrame:
    """Adds `rate` (null where the count is below `silence`) and `pace`, the mean rate over (t - span, t].

    `at` is in seconds. The range frame is in whole microseconds, so that the open lower end is exact.
    """
    micros = F.round(F.col(at) * 1_000_000).cast("long")
    frame = Window.partitionBy(*keys).orderBy("__us").rangeBetween(-int(span * 1_000_000) + 1, 0)
    rated = points.withColumn("__us", micros).withColumn("rate", F.when(F.col(count) >= silence, F.col(count) / size))
    return rated.withColumn("pace", F.avg("rate").over(frame)).drop("__us")


def scheduled(arrivals: DataFrame, keys: Sequence[str], order: Sequence[str], total: str, busy: Column, first: int, hop: int) -> DataFrame:
    """Which tick each arrival runs, and how many ticks it skips.

    tick = floor((total - first) / hop), -1 before `first`. An arrival acts if its tick is newer than all before it: if
    busy it skips every tick up to its own, else it runs its own and skips those between. Adds tick, run, skipped and
    window_end (of the run).
    """
    tick = F.when(F.col(total) < first, F.lit(-1)).otherwise(F.floor((F.col(total) - first) / hop)).cast("long")
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.coalesce(F.max("tick").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    out = arrivals.withColumn("tick", tick).withColumn("__before", before).withColumn("__busy", busy)
    new = F.col("tick") > F.col("__before")
    out = out.withColumn("run", new & ~F.col("__busy"))
    gap = F.col("tick") - F.col("__before") - F.when(F.col("__busy"), F.lit(0)).otherwise(F.lit(1))
    out = out.withColumn("skipped", F.when(new, gap).otherwise(F.lit(0)).cast("long"))
    return out.withColumn("window_end", F.when(F.col("run"), F.lit(first) + F.col("tick") * hop)).drop("__before", "__busy")


def pruned(points: DataFrame, keys: Sequence[str], at: str, now: Column, span: float) -> DataFrame:
    """Points from now - span on, and the one before them. One grouping and a join, no ordering of all points."""
    start = now - span
    edge = points.groupBy(*keys).agg(F.max(F.when(F.col(at) < start, F.col(at))).alias("__edge"))
    joined = points.join(edge, list(keys)) if keys else points.withColumn("__edge", F.lit(edge.first()["__edge"]))
    return joined.where((F.col(at) >= start) | (F.col(at) == F.col("__edge"))).drop("__edge")


def axis_top(values: DataFrame, value: str, least: float = 10.0, keys: Sequence[str] = ()) -> DataFrame:
    """The axis limit: the largest finite value, at least `least`, rounded up to an even number."""
    finite = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.col(value))
    return values.groupBy(*keys).agg((F.ceil(F.greatest(F.coalesce(F.max(finite), F.lit(least)), F.lit(least)) / 2) * 2).alias("axis_top"))


def latest_window(samples: DataFrame, keys: Sequence[str], at: str, size: int, held: int) -> DataFrame:
    """The newest `size` samples of each key, if they are complete and among the `held` newest positions (what a ring
    buffer of that length still has): (keys, end, window)."""
    last = samples.groupBy(*keys).agg((F.max(at) + 1).alias("end"))
    cut = samples.join(last, list(keys)).where((F.col(at) >= F.col("end") - size) & (F.col(at) >= F.col("end") - held))
    got = cut.groupBy(*keys, "end").agg(F.array_sort(F.collect_list(F.struct(at, "sample"))).alias("__w"))
    return got.where(F.size("__w") == size).select(*keys, "end", F.col("__w.sample").alias("window"))


def ring_read(samples: DataFrame, keys: Sequence[str], at: str, end: Column, size: int, held: int) -> DataFrame:
    """Samples [end - size, end) of each key from a ring of the `held` newest positions: (keys, window), the window null
    where part of it was never written or is overwritten already."""
    last = samples.groupBy(*keys).agg(F.max(at).alias("__last"))
    inside = (F.col(at) >= end - size) & (F.col(at) < end) & (F.col(at) > F.col("__last") - held)
    marked = samples.join(last, list(keys)).withColumn("__s", F.when(inside, F.struct(F.col(at).alias("at"), F.col("sample").alias("sample"))))
    got = marked.groupBy(*keys).agg(F.array_sort(F.collect_list("__s")).alias("__w"))
    return got.select(*keys, F.when(F.size("__w") == size, F.col("__w.sample")).alias("window"))


# Fixed values of a countdown: levels of the time left, the time up to which it warns, and the longest that can be set.
LEVELS = ("over", "warn", "normal")
WARN_MS = 60_000
LONGEST_SEC = 180 * 60


def time_left(ms: Column) -> Column:
    """A struct (text, level) of milliseconds left. Whole seconds are rounded up, so that time that has run out counts
    its full seconds; past time reads as +m:ss."""
    seconds = F.ceil(ms / 1000)
    sign = F.when(seconds < 0, F.lit("+")).otherwise(F.lit(""))
    text = F.concat(sign, F.floor(F.abs(seconds) / 60).cast("string"), F.lit(":"), F.lpad((F.abs(seconds) % 60).cast("string"), 2, "0"))
    level = F.get(F.array(*map(F.lit, LEVELS)), (ms >= 0).cast("int") + (ms > WARN_MS).cast("int"))
    return F.struct(text.alias("text"), level.alias("level"))


def settable_ms(entry: Column) -> Column:
    """Milliseconds of an entry in minutes, of up to three digits, or minutes and seconds; null if it is none, not
    positive or longer than can be set."""
    fields = F.split(F.trim(entry), ":")
    seconds = F.when((F.size(fields) <= 2) & (F.length(fields[0]) <= 3), parsed_seconds(entry))
    return F.when(seconds.between(1, LONGEST_SEC), seconds.cast("long") * 1000)


def countdown(events: DataFrame, keys: Sequence[str], at: str, action: str, order: Sequence[str], set_ms: str) -> DataFrame:
    """Adds `running` and `left`, in milliseconds, after each event of a timer.

    Actions are start, pause, toggle, reset (back to the full time, stopped) and set (as reset, to the time in `set_ms`);
    any other is a look at the timer. `at` is in milliseconds. A timer starts stopped; before the first set its time is
    null. Starting a running timer and pausing a stopped one change nothing. One sorted pass a key.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    fresh = F.col(action).isin("reset", "set")
    out = events.withColumn("__life", F.count_if(fresh).over(w)).withColumn("__set", F.last(F.when(F.col(action) == "set", F.col(set_ms)), ignorenulls=True).over(w))
    # A life's running state after an event: its last start, pause or reset, turned by each toggle since.
    life = Window.partitionBy(*keys, "__life").orderBy(*order)
    fixed = F.when(F.col(action) == "start", F.lit(1)).when(F.col(action).isin("pause", "reset", "set"), F.lit(0))
    out = out.withColumn("__fixed", F.last(fixed, ignorenulls=True).over(life)).withColumn("__since", F.count_if(fixed.isNotNull()).over(life))
    turns = F.count_if(F.col(action) == "toggle").over(Window.partitionBy(*keys, "__life", "__since").orderBy(*order))
    out = out.withColumn("running", (F.coalesce("__fixed", F.lit(0)) + turns) % 2 == 1)
    ran = F.when(F.lag("running").over(life), F.col(at) - F.lag(at).over(life)).otherwise(F.lit(0))
    out = out.withColumn("__ran", ran).withColumn("left", F.col("__set") - F.sum("__ran").over(life))
    return out.drop("__life", "__set", "__fixed", "__since", "__ran")


def _timeout(idle: str | None) -> tuple[int, str]:
    """Milliseconds after which a key's state is forgotten, 0 for never, and the timeout that does it."""
    if idle is None:
        return 0, GroupStateTimeout.NoTimeout
    return int(pd.Timedelta(idle).total_seconds() * 1000), GroupStateTimeout.ProcessingTimeTimeout


def _paced(t: np.ndarray, rate: np.ndarray, span: float) -> np.ndarray:
    """The mean of the known rates over (t - span, t] for each of the ascending times."""
    micros = np.round(t * 1e6).astype(np.int64)
    known = ~np.isnan(rate)
    sums, counts = (np.concatenate(([0.0], np.cumsum(x))) for x in (np.where(known, rate, 0.0), known))
    first, last = np.searchsorted(micros, micros - int(span * 1e6), side="right"), np.searchsorted(micros, micros, side="right")
    n = counts[last] - counts[first]
    return np.where(n > 0, (sums[last] - sums[first]) / np.maximum(n, 1), np.nan)


def stream_pace(
    points: DataFrame, key: str, at: str, count: str, span: float = SPAN, silence: float = SILENCE, size: float = SIZE, late: float = 0.0, idle: str | None = None
) -> DataFrame:
    """rolling_pace() over a stream: the same (key, at, count, rate, pace) rows, each emitted once, from the points that
    have arrived by then.

    The state of a key is its points of the last `span + late` seconds: a point at most `late` behind its key's newest
    is averaged as it should be, an older one is emitted without a pace. A key without points for `idle` of processing
    time, if given, is forgotten; such a query has no end of its own, so it is not for triggers that end.
    """
    fields = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    forget, timeout = _timeout(idle)

    def advance(name, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        new = pd.concat(list(frames))[[at, count]].astype("float64")
        t, rate = new[at].to_numpy(), np.where(new[count] >= silence, new[count] / size, np.nan)
        held_t, held_rate = (np.array(x, np.float64) for x in state.get) if state.exists else (np.empty(0), np.empty(0))
        edge = held_t.max() - late if held_t.size else -np.inf
        every_t, every_rate = np.concatenate((held_t, t)), np.concatenate((held_rate, rate))
        order = np.argsort(every_t, kind="stable")
        pace = np.empty(every_t.size)
        pace[order] = _paced(every_t[order], every_rate[order], span)
        pace = np.where(t >= edge, pace[held_t.size :], np.nan)
        yield pd.DataFrame({key: name[0], at: t, count: new[count].to_numpy(), "rate": rate, "pace": pace})
        keep = order[every_t[order] > every_t.max() - span - late]
        state.update((every_t[keep].tolist(), every_rate[keep].tolist()))
        if forget:
            state.setTimeoutDuration(forget)

    return points.groupBy(key).applyInPandasWithState(
        advance,
        f"{key} {fields[key]}, {at} double, {count} double, rate double, pace double",
        "t array<double>, r array<double>",
        "append",
        timeout,
    )


def stream_scheduled(arrivals: DataFrame, key: str, at: str, total: str, busy: str, first: int, hop: int, idle: str | None = None) -> DataFrame:
    """scheduled() over a stream: (key, at, tick, run, skipped, window_end) of each arrival, in order of time within a
    micro-batch. The state of a key is its newest tick."""
    fields = {f.name: f.dataType.simpleString() for f in arrivals.schema.fields}
    forget, timeout = _timeout(idle)

    def advance(name, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        new = pd.concat(list(frames)).sort_values(at, kind="stable")
        tick = np.where(new[total] < first, -1, (new[total].to_numpy() - first) // hop).astype(np.int64)
        start = state.get[0] if state.exists else -1
        top = np.maximum.accumulate(np.concatenate(([start], tick)))
        newer, taken = tick > top[:-1], new[busy].to_numpy(bool)
        run = newer & ~taken
        skipped = np.where(newer, tick - top[:-1] - ~taken, 0)
        end = pd.array(np.where(run, first + tick * hop, 0), dtype="Int64")
        end[~run] = pd.NA
        yield pd.DataFrame({key: name[0], at: new[at].to_numpy(), "tick": tick, "run": run, "skipped": skipped, "window_end": end})
        state.update((int(top[-1]),))
        if forget:
            state.setTimeoutDuration(forget)

    schema = f"{key} {fields[key]}, {at} {fields[at]}, tick long, run boolean, skipped long, window_end long"
    return arrivals.groupBy(key).applyInPandasWithState(advance, schema, "newest long", "append", timeout)


def stream_ring(samples: DataFrame, key: str, at: str, value: str, size: int, held: int, idle: str | None = None) -> DataFrame:
    """latest_window() over a stream: after each micro-batch the newest `size` samples of each key that got new ones,
    (key, end, window), if they are complete and among the `held` newest positions, which are the state."""
    fields = {f.name: f.dataType.simpleString() for f in samples.schema.fields}
    forget, timeout = _timeout(idle)

    def advance(name, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        new = pd.concat(list(frames))
        old = pd.DataFrame({at: state.get[0], value: state.get[1]}) if state.exists else new.iloc[:0][[at, value]]
        ring = pd.concat([old, new[[at, value]]]).drop_duplicates(at, keep="last").sort_values(at)
        end = int(ring[at].iloc[-1]) + 1
        ring = ring[ring[at] >= end - held]
        window = ring[ring[at] >= end - size]
        if len(window) == size and size <= held:
            yield pd.DataFrame({key: [name[0]], "end": [end], "window": [window[value].astype("float64").tolist()]})
        state.update((ring[at].astype("int64").tolist(), ring[value].astype("float64").tolist()))
        if forget:
            state.setTimeoutDuration(forget)

    schema = f"{key} {fields[key]}, end long, window array<double>"
    return samples.groupBy(key).applyInPandasWithState(advance, schema, "at array<long>, v array<double>", "append", timeout)


def stream_counts(events: DataFrame, at: str, key: str, window: str = "5 minutes", hop: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Counts by sliding event-time window and key with a bound on lateness: state is dropped behind the watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, window, hop), key).agg(F.count(F.lit(1)).alias("n"))


def stream_sessions(events: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count(F.lit(1)).alias("n"))
