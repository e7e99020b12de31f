"""Global order numbers and prefix sums from per-partition totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanmill.llm.shared import Staging

ROW, PART = "__row", "__part"


def with_prefix(staging: Staging, df: DataFrame, order: Sequence[str], measure: str | None, parts: int, tag: str) -> DataFrame:
    """Adds ROW, the global 0-based order number, `__before`, the sum of `measure` over all earlier rows, and `__total`,
    that over all rows.

    Range partitions are written once, so that partition numbers stay as they are if executors are lost. The totals
    have one row per partition (at most `parts`): only those are summed in one task and broadcast. `order` should
    name all columns of `df`; rows alike in all of them are interchangeable.
    """
    amount = F.col(measure) if measure else F.lit(0).cast("long")
    ranged = df.repartitionByRange(parts, *order).withColumn(PART, F.spark_partition_id())
    fixed = staging.write(ranged, tag)
    totals = fixed.groupBy(PART).agg(F.count(F.lit(1)).alias("__n"), F.sum(amount).alias("__sum"))
    earlier = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        PART,
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n0"),
        F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__sum0"),
        F.sum("__sum").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__total"),
    )
    local = Window.partitionBy(PART).orderBy(*order)
    so_far = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = fixed.withColumn("__local", F.row_number().over(local)).withColumn("__upto", F.sum(amount).over(so_far))
    return (
        numbered.join(F.broadcast(offsets), PART)
        .withColumn(ROW, F.col("__n0") + F.col("__local") - 1)
        .withColumn("__before", F.col("__sum0") + F.col("__upto") - amount)
        .drop("__n0", "__sum0", "__local", "__upto", PART)
    )
