"""Fixed windows over sources, fractional-overlap labels, concatenation, time scaling and shifting.

A source is a timeline of some length that starts at 0. A span [start, end) lies on one source. A window of length W
starts at every multiple of the hop; only windows that lie wholly on the source exist.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmill.functions.numeric import stretched_length


def window_count(length: Column, size: float, hop: float) -> Column:
    return F.when(length >= size, F.floor((length - size) / hop).cast("long") + 1).otherwise(F.lit(0).cast("long"))


def window_starts(sources: DataFrame, size: float, hop: float, length: str = "length") -> DataFrame:
    """One row per window of each source, with `window` (from 0) and `window_start`; sources that are too short have none."""
    n = window_count(F.col(length), size, hop)
    fits = sources.where(F.col(length) >= size)
    return fits.withColumn("window", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).withColumn("window_start", F.col("window") * hop)


def tumbling_starts(sources: DataFrame, size: float, length: str = "length") -> DataFrame:
    """Adjacent windows; what is left at the end is dropped."""
    return window_starts(sources, size, size, length)


def overlap_fraction(start: Column, end: Column, window_start: Column, size: float) -> Column:
    """The part of a span that lies in a window, at most 1. A span without length counts 1 iff it starts in the window."""
    stop = window_start + size
    part = F.greatest(F.least(end, stop) - F.greatest(start, window_start), F.lit(0.0)) / (end - start)
    inside = (start >= window_start) & (start < stop)
    return F.when(end > start, F.least(part, F.lit(1.0))).otherwise(F.when(inside, 1.0).otherwise(0.0))


def candidate_windows(start: Column, end: Column, size: float, hop: float) -> Column:
    """The windows that a span can touch, as an array of numbers: about W / hop + length / hop of them."""
    first = F.greatest(F.floor((start - size) / hop).cast("long"), F.lit(0).cast("long"))
    last = F.floor(F.greatest(start, end) / hop).cast("long")
    return F.when(last >= first, F.sequence(first, last))


def window_sums(
    sources: DataFrame, spans: DataFrame, size: float, hop: float, sums: Mapping[str, Column] | None = None, keys: Sequence[str] = ("source_id",)
) -> DataFrame:
    """One row per window: keys, window, window_start and each named sum over the spans, weighted by their fraction.

    `sums` maps names to weights of a span (default: `label`, weight 1). An unweighted count of the spans that start in
    the window is `starts`. Windows without spans have sums of 0.

    The range join is one equality grouping: spans are exploded to the windows they can touch and windows add a row of
    zeros each, so everything meets in a single partially aggregated shuffle on (keys, window), and a span beyond the
    last window falls into a group without a window and is dropped.
    """
    sums = sums or {"label": F.lit(1.0)}
    start, end = F.col("start").cast("double"), F.col("end").cast("double")
    touched = spans.withColumn("window", F.explode(candidate_windows(start, end, size, hop)))
    at = F.col("window") * F.lit(float(hop))
    part = overlap_fraction(start, end, at, size)
    begun = ((start >= at) & (start < at + size)).cast("long")
    hits = touched.select(*keys, "window", F.lit(0).alias("__is"), *((part * w).cast("double").alias(n) for n, w in sums.items()), begun.alias("starts"))
    empty = window_starts(sources, size, hop).select(*keys, "window", F.lit(1).alias("__is"), *(F.lit(0.0).alias(n) for n in sums), F.lit(0).cast("long").alias("starts"))
    grouped = hits.unionByName(empty).groupBy(*keys, "window").agg(F.max("__is").alias("__is"), *(F.sum(n).alias(n) for n in sums), F.sum("starts").alias("starts"))
    return grouped.where("__is = 1").drop("__is").withColumn("window_start", F.col("window") * F.lit(float(hop)))


def shifted_spans(spans: DataFrame, shift: float, length: str = "length") -> DataFrame:
    """Spans moved by `shift` and held within [0, length]; `clamped` tells which had to be held."""
    hold = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.col(length).cast("double"))
    a, b = F.col("start") + shift, F.col("end") + shift
    out = (a < 0) | (b < 0) | (a > F.col(length)) | (b > F.col(length))
    return spans.withColumn("clamped", out).withColumn("__a", hold(a)).withColumn("end", hold(b)).withColumn("start", F.col("__a")).drop("__a")


def scaled(spans: DataFrame, speed: float) -> DataFrame:
    """Span times at `speed` times the speed."""
    return spans.withColumn("start", F.col("start") * (1.0 / speed)).withColumn("end", F.col("end") * (1.0 / speed))


def scaled_sources(sources: DataFrame, speed: float, length: str = "length") -> DataFrame:
    """Lengths (in samples or other whole units) at `speed` times the speed, rounded half to even."""
    return sources.withColumn(length, stretched_length(F.col(length), F.lit(float(speed))))


def offsets(items: DataFrame, keys: Sequence[str], order: Sequence[str], length: str, gap: Column | int = 0) -> DataFrame:
    """Adds `offset`, where each item begins in its concatenation: the lengths and gaps before it."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    step = F.col(length) + (F.lit(gap) if isinstance(gap, int) else gap)
    return items.withColumn("offset", F.coalesce(F.sum(step).over(before), F.lit(0)))


def concatenated_length(items: DataFrame, keys: Sequence[str], length: str) -> DataFrame:
    """From offsets() rows the length of each concatenation: its last item's end."""
    return items.groupBy(*keys).agg(F.max(F.col("offset") + F.col(length)).alias("length"), F.count(F.lit(1)).alias("items"))


def array_offsets(lengths: Column, gaps: Column) -> Column:
    """The same for one row: arrays of n lengths and n - 1 gaps."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct((acc["at"] + x).cast("long").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    steps = F.transform(lengths, lambda n, i: (n + F.coalesce(F.get(gaps, i), F.lit(0))).cast("long"))
    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def moved_to_source(spans: DataFrame, items: DataFrame, item_key: str = "item_id") -> DataFrame:
    """Spans of items on the timeline of their source: (source_id, start, end) plus the spans' other columns."""
    placed = spans.join(items.select(item_key, "source_id", "offset"), item_key)
    return placed.withColumn("start", F.col("start") + F.col("offset")).withColumn("end", F.col("end") + F.col("offset")).drop("offset")


def windows_touching(windows: DataFrame, parts: DataFrame, size: float, hop: float) -> DataFrame:
    """Windows that share at least a point with one of the parts (source_id, start, end): a semi-join on numbers."""
    a, b = F.col("start").cast("double"), F.col("end").cast("double")
    hit = parts.withColumn("window", F.explode(candidate_windows(a, b, size, hop)))
    at = F.col("window") * F.lit(float(hop))
    hit = hit.where((at < b) & (a < at + size)).select("source_id", "window")
    return windows.join(hit, ["source_id", "window"], "left_semi")


def windows_of_items(windows: DataFrame, sources: DataFrame, targets: DataFrame, flag: str = "flagged") -> DataFrame:
    """Adds whether a window's source contains one of the target items (sources has `item_ids`)."""
    held = sources.select("source_id", F.explode("item_ids").alias("item_id")).join(targets.select("item_id"), "item_id", "left_semi")
    marked = held.select("source_id").distinct().withColumn(flag, F.lit(True))
    return windows.join(marked, "source_id", "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def window_ranges(windows: DataFrame) -> DataFrame:
    """Each source's first and last window and their number; windows of a source must be gapless to be a range."""
    out = windows.groupBy("source_id").agg(F.min("window").alias("first"), F.max("window").alias("last"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("gapless", F.col("last") - F.col("first") + 1 == F.col("n"))


def isolation(spans: Column, threshold: float) -> Column:
    """Whether the first two or the last two starts are more than `threshold` apart; false below two spans."""
    far = lambda i, j: F.try_element_at(spans, F.lit(i))["start"] - F.try_element_at(spans, F.lit(j))["start"] > threshold
    enough = F.size(spans) >= 2
    return F.struct((enough & far(2, 1)).alias("head"), (enough & far(-1, -2)).alias("tail"))


def stretch_plan(length: Column, stretch: Column, start: Column, window: int, margin: int) -> Column:
    """The excerpt [excerpt_start, excerpt_end) of a source that covers one window at `start` of the stretched source,
    with margins, and where the window begins in the stretched excerpt."""
    stretched = F.bround(length * stretch, 0).cast("long")
    a = F.greatest(F.floor((start - margin) / stretch).cast("long"), F.lit(0).cast("long"))
    b = F.least(F.ceil((start + window + margin) / stretch).cast("long"), length.cast("long"))
    inside = window_in_excerpt(start, a, stretch, F.bround((b - a) * stretch, 0).cast("long"), window)
    return F.struct(stretched.alias("stretched_length"), a.alias("excerpt_start"), b.alias("excerpt_end"), inside.alias("window_start"))


def window_in_excerpt(start: Column, excerpt_start: Column, stretch: Column, excerpt_length: Column, window: int) -> Column:
    at = start - F.bround(excerpt_start * stretch, 0).cast("long")
    return F.greatest(F.least(at, excerpt_length - window), F.lit(0).cast("long"))


def excerpt_labels(spans: DataFrame, plans: DataFrame, window: int) -> DataFrame:
    """Labels of windows of stretched excerpts: of each span the part inside the window, summed.

    plans: one row a window, with source_id, stretch and stretch_plan()'s excerpt_start and window_start; spans:
    source_id, start, end, in samples of the source. Spans are moved and stretched as the excerpt is. One equi-join and
    one partially aggregated sum by plan; a window without spans has 0.
    """
    keys = plans.columns
    at = lambda c: (F.col(c) - F.col("excerpt_start")) * F.col("stretch")
    moved = plans.join(spans.select("source_id", "start", "end"), "source_id", "left").withColumn("start", at("start")).withColumn("end", at("end"))
    part = overlap_fraction(F.col("start"), F.col("end"), F.col("window_start"), window)
    return moved.groupBy(*keys).agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("label"))


def least_stretch(low: float, length: Column, window: int) -> Column:
    """The least stretch from `low` on that leaves room for a window."""
    return F.greatest(F.lit(low), F.lit(float(window)) / length)


def kept_position(start: Column, old_room: Column, new_room: Column) -> Column:
    """A window's start after a new draw of the stretch: the same relative place among the possible starts."""
    return F.when(old_room > 0, F.bround(start * new_room / F.greatest(old_room, F.lit(1)), 0)).otherwise(F.lit(0)).cast("long")


def first_passing(candidates: DataFrame, keys: Sequence[str], passes: Column, attempt: str = "attempt") -> DataFrame:
    """Per key the first attempt that passes, else attempt 0, the base draw; ties by the other columns."""
    rest = [c for c in candidates.columns if c not in keys]
    able = candidates.where(passes | (F.col(attempt) == 0)).withColumn("__late", (~passes).cast("int"))
    best = able.groupBy(*keys).agg(F.min(F.struct("__late", attempt, F.struct(*rest).alias("row"))).alias("__best"))
    return best.select(*keys, "__best.row.*")


def window_rates(rows: DataFrame, size: float, rate: int, start: str = "window_start", value: str = "pred") -> DataFrame:
    """Windows' predictions as times and rates: start_sec, end_sec and per_sec; `size` in seconds, starts in samples."""
    begin = F.col(start) / rate
    return rows.withColumn("start_sec", begin).withColumn("end_sec", begin + size).withColumn("per_sec", F.col(value) / size)


def split_consistency(windows: DataFrame, whole: DataFrame) -> DataFrame:
    """Sums of window predictions against the prediction of the whole: (source_id, windows, total, whole, difference)."""
    sums = windows.groupBy("source_id").agg(F.count(F.lit(1)).alias("windows"), F.sum("pred").alias("total"))
    return sums.join(whole.select("source_id", F.col("pred").alias("whole")), "source_id").withColumn("difference", F.col("total") - F.col("whole"))


def concat_additivity(pairs: DataFrame) -> DataFrame:
    """P(AB) against P(A) + P(gap) + P(B), in total and a second; pairs has pair, first, second, gap, total_sec."""
    signed = F.col("pair") - F.col("first") - F.col("second") - F.col("gap")
    return pairs.withColumn("difference", signed).withColumn("error_per_sec", F.abs(signed) / F.col("total_sec"))


def neighbour_pairs(items: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Items 1 and 2, 3 and 4, ... of each key, side by side; an odd last one is dropped."""
    at = Window.partitionBy(*keys).orderBy(*order)
    both = items.withColumn("__n", F.row_number().over(at)).withColumn("next", F.lead(value).over(at))
    return both.where("__n % 2 = 1 and next is not null").withColumn("pair", (F.col("__n") + 1) / 2).drop("__n")
