"""Writers: resumable, schema-checked, deterministic."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.functions.text import one_line
from spanmill.operators.registry import _exists


def records(df: DataFrame, path: str, form: str = "parquet") -> None:
    if form not in ("parquet", "json"):
        raise ValueError("records are written as parquet or json")
    df.write.mode("overwrite").format(form).save(path)


def split_documents(assignment: DataFrame, path: str, unit: str = "speaker", seed: int = 42, method: str = "greedy") -> None:
    """One JSON document per split, its ids in order."""
    docs = assignment.groupBy("split").agg(F.array_sort(F.collect_list("client_id")).alias("client_ids"))
    docs = docs.select("split", F.lit(unit).alias("unit"), F.lit(seed).cast("long").alias("seed"), F.lit(method).alias("method"), "client_ids")
    docs.repartition("split").write.mode("overwrite").json(path)


def window_set(windows: DataFrame, sources: DataFrame, path: str) -> None:
    """Windows, sources and, last, a row that says the set is complete."""
    windows.write.mode("overwrite").parquet(f"{path}/windows")
    sources.write.mode("overwrite").parquet(f"{path}/sources")
    kinds = windows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    kinds.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("windows")).withColumn("complete", F.lit(True)).write.mode("overwrite").json(f"{path}/meta")


def resumed(spark: SparkSession, rows: DataFrame, path: str, key: str, schema) -> DataFrame:
    """The rows whose key is not yet among the JSON lines at `path`; a cut-off last line counts as not written."""
    if not _exists(spark, path):
        return rows
    done = spark.read.schema(schema).json(path, mode="DROPMALFORMED").select(key).where(F.col(key).isNotNull())
    return rows.join(done, key, "left_anti")


def append_json(spark: SparkSession, rows: DataFrame, path: str, key: str) -> None:
    """Appends the rows that are not there yet, once each."""
    resumed(spark, rows, path, key, rows.schema).write.mode("append").json(path)


def two_outputs(spark: SparkSession, rows: DataFrame, first: tuple[str, Sequence[Column]], second: tuple[str, Sequence[Column]], key: str) -> None:
    """Two projections of one computation, each resumable by itself. The rows are computed once if either lacks some."""
    kept = rows.persist()
    try:
        for path, columns in (first, second):
            append_json(spark, kept.select(*columns), path, key)
    finally:
        kept.unpersist()


def feature_shards(features: DataFrame, path: str, shards: int, failures: str | None = None) -> None:
    """Features by ranges of item id, sorted in each; rows without a feature go to a table of failures."""
    good = features.where("feature is not null")
    good.repartitionByRange(shards, "item_id").sortWithinPartitions("item_id").write.mode("overwrite").parquet(path)
    if failures:
        features.where("feature is null").drop("feature").write.mode("overwrite").json(failures)


def sharded_features(spark: SparkSession, items: DataFrame, compute: Callable[[DataFrame], DataFrame], path: str, shards: int, at_once: int = 64, key: str = "item_id") -> list[int]:
    """Features of `items` in shards dealt by a hash of the id, some shards a job; returns the shards that this call made.

    `compute` maps items (with `shard`, which it keeps) to rows with `feature`, null where there is none. A shard counts
    as done once its line (shard, shards, items, failed) is written, which is after its rows; a call after a crash makes
    only the others, and rows that a crash left behind are replaced. Raises ValueError if the table at `path` was begun
    with another number of shards.
    """
    marks = spark.createDataFrame([], "shard int, shards int, items long, failed long")
    if _exists(spark, f"{path}/done"):
        marks = spark.read.schema(marks.schema).json(f"{path}/done", mode="DROPMALFORMED")
    made = [(r["shard"], r["shards"]) for r in marks.select("shard", "shards").distinct().collect()]
    if any(n != shards for _, n in made):
        raise ValueError(f"{path} was begun with another number of shards")
    todo = sorted(set(range(shards)) - {s for s, _ in made})
    dealt = items.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int"))
    for first in range(0, len(todo), at_once):
        batch = todo[first : first + at_once]
        rows = compute(dealt.where(F.col("shard").isin(batch)))
        rows.repartition("shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(f"{path}/features")
        wanted = spark.createDataFrame([(s, shards) for s in batch], "shard int, shards int")
        found = spark.read.schema(rows.schema).parquet(f"{path}/features").where(F.col("shard").isin(batch))
        counts = found.groupBy("shard").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("feature").isNull()).alias("failed"))
        wanted.join(counts, "shard", "left").fillna(0).coalesce(1).write.mode("append").json(f"{path}/done")
    return todo


def manifest(features: DataFrame, split: str = "split") -> DataFrame:
    """Items, frames and the ranges of ids of each split."""
    return features.groupBy(split).agg(F.count(F.lit(1)).alias("items"), F.sum("frames").alias("frames"), F.min("item_id").alias("first"), F.max("item_id").alias("last"))


def error_table(top: DataFrame, path: str, text_cols: Sequence[str], number_cols: Sequence[str]) -> None:
    """A ranked TSV: one-line texts, numbers with three decimals."""
    for c in text_cols:
        top = top.withColumn(c, one_line(F.col(c)))
    for c in number_cols:
        top = top.withColumn(c, F.format_string("%.3f", F.col(c).cast("double")))
    top.coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True, quote="")
