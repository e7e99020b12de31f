"""Contiguous shards of near-equal bytes, by global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.llm.prefix import ROW, with_prefix
from spanmill.llm.shared import Staging, input_bytes, parts_for

#: Rows of the narrow table (id, size, checksum) in one task; 24 bytes each.
ROWS_PER_PART = 1_000_000


def byte_shards(spark: SparkSession, docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Assigns every row to one of `shards` contiguous shards in id order.

    Size is the text's UTF-8 bytes plus 1 (null text: 1). With T the sum of all sizes, a row whose middle byte lies in
    the k-th of `shards` equal parts of [0, T) belongs to shard k, so a shard's size differs from T / shards by less
    than one row's size. Slots number a shard's rows from 0 in the same order.

    The texts are scanned once and never shuffled; only (id, size, checksum) is range partitioned by id.
    Null ids come first; rows with equal ids follow size and checksum; rows alike in all three are interchangeable.
    An empty table gives an empty result. A text larger than a shard's target has a shard of its own, whole, and
    shards that it covers stay empty.
    """
    staging = Staging(spark, "byte_shards")
    narrow = staging.write(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text_col), F.lit(0)) + F.lit(1)).cast("long").alias("size"),
            F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        ),
        "narrow",
    )
    parts = parts_for(spark, input_bytes(narrow), 24 * ROWS_PER_PART)
    placed = (
        with_prefix(staging, narrow, ["doc_id", "size", "text_crc32"], "size", parts, "ranged")
        .withColumn("shard", F.expr(f"cast((2 * __before + size) * {int(shards)} div (2 * __total) as int)"))
        .select("doc_id", "size", "text_crc32", "shard", ROW)
    )
    placed = staging.write(placed, "placed")
    staging.drop("narrow", "ranged")
    first = F.broadcast(placed.groupBy("shard").agg(F.min(ROW).alias("__first")))
    return placed.join(first, "shard").select("doc_id", "size", "text_crc32", "shard", (F.col(ROW) - F.col("__first")).alias("slot"))
