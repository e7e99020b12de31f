"""Ordered label sequences as rows: islands, collapsing, adjacency, best-so-far."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ordered(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def collapse(rows: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, blank) -> DataFrame:
    """The rows that remain when repeats are merged and blanks dropped."""
    before = F.lag(label).over(_ordered(keys, order))
    return rows.withColumn("__before", before).where((F.col("__before").isNull() | (F.col(label) != F.col("__before"))) & (F.col(label) != F.lit(blank))).drop("__before")


def label_spans(rows: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, blank) -> DataFrame:
    """Islands of equal neighbouring labels as [start, end) of positions from 0; blanks divide and are dropped."""
    w = _ordered(keys, order)
    marked = rows.withColumn("__at", F.row_number().over(w) - 1)
    marked = marked.withColumn("__new", F.coalesce((F.col(label) != F.lag(label).over(w)).cast("int"), F.lit(1)))
    marked = marked.withColumn("span", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = marked.groupBy(*keys, "span", label).agg(F.min("__at").alias("start"), (F.max("__at") + 1).alias("end"))
    return out.where(F.col(label) != F.lit(blank))


def frames_needed(rows: DataFrame, keys: Sequence[str], order: Sequence[str], label: str) -> DataFrame:
    """Tokens plus equal neighbours: the least frames that hold them with blanks between repeats."""
    same = (F.lag(label).over(_ordered(keys, order)) == F.col(label)).cast("long")
    marked = rows.withColumn("__same", F.coalesce(same, F.lit(0).cast("long")))
    return marked.groupBy(*keys).agg((F.count(F.lit(1)) + F.sum("__same")).alias("frames"))


def intervals(rows: DataFrame, keys: Sequence[str], order: Sequence[str], start: str) -> DataFrame:
    """Each start's distance to the next; null for the last."""
    w = _ordered(keys, order)
    return rows.withColumn("interval", F.lead(start).over(w) - F.col(start))


def end_intervals(rows: DataFrame, keys: Sequence[str], order: Sequence[str], start: str) -> DataFrame:
    """The first and last interval and the longest of each sequence."""
    gaps = intervals(rows, keys, order, start).where("interval is not null")
    at = F.struct(*order)
    return gaps.groupBy(*keys).agg(F.min_by("interval", at).alias("first"), F.max_by("interval", at).alias("last"), F.max("interval").alias("longest"), F.count(F.lit(1)).alias("n"))


def best_so_far(rows: DataFrame, keys: Sequence[str], order: Sequence[str], metric: str, mode: str = "min", delta: float = 0.0, patience: int = 3) -> DataFrame:
    """Adds the best earlier value, whether a row improves on it by more than delta, the rows since the last
    improvement, and whether patience has run out."""
    w = _ordered(keys, order)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    agg = F.min if mode == "min" else F.max
    out = rows.withColumn("best_before", agg(metric).over(earlier))
    better = F.col(metric) < F.col("best_before") - delta if mode == "min" else F.col(metric) > F.col("best_before") + delta
    out = out.withColumn("improved", F.coalesce(better, F.lit(True))).withColumn("__n", F.row_number().over(w))
    last = F.max(F.when(F.col("improved"), F.col("__n"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("stale", (F.col("__n") - last).cast("int")).withColumn("stop", F.col("stale") >= patience).drop("__n")
