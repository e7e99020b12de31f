"""Order numbers and running sums over whole tables, by range partitions and their totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmill.workers import shared_folder


def numbered(rows: DataFrame, order: Sequence[Column | str], name: str, amount: Column | None = None, upto: str = "") -> DataFrame:
    """Adds `name`, the row's number from 0 in the total order, and, if asked, `upto`, the sum of `amount` up to the row.

    Rows are dealt to range partitions, which are written once, so that they stay as they are; a window runs inside each
    partition. Only the partitions' totals, a row each, are summed in one task and broadcast. Rows alike in all of
    `order` are interchangeable.
    """
    spark = rows.sparkSession
    keys = [f"__o{i}" for i in range(len(order))]
    keyed = rows.withColumns({k: F.col(o) if isinstance(o, str) else o for k, o in zip(keys, order, strict=True)})
    keyed = keyed.withColumn("__a", amount if amount is not None else F.lit(0))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = shared_folder(spark, "numbered")
    keyed.repartitionByRange(parts, *keys).withColumn("__p", F.spark_partition_id()).write.mode("overwrite").parquet(at)
    fixed = spark.read.parquet(at)
    totals = fixed.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"), F.sum("__a").alias("__s"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__s0"))
    inside = Window.partitionBy("__p").orderBy(*keys)
    out = fixed.withColumn("__i", F.row_number().over(inside) - 1).withColumn("__u", F.sum("__a").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = out.join(F.broadcast(starts), "__p").withColumn(name, F.col("__n0") + F.col("__i"))
    out = out.withColumn(upto, F.col("__s0") + F.col("__u")) if upto else out
    return out.select(*rows.columns, name, *([upto] if upto else []))
