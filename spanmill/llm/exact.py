"""Exact dedup by deterministic block naming."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.llm.shared import Staging, input_bytes, named, numbered, only, parts_for
from spanmill.llm.textbytes import lower_ascii, sliced, utf8

#: Bytes of a block; part of a name's meaning, not of a result's.
BLOCK_BYTES = 4096
#: Text whose equal blocks travel once.
SLICE_BYTES = 8 << 20
PART_BYTES = 48 << 20
_PLACE = "struct<no:long,doc_id:long,sha:binary,blocks:int,at:int>"


def _blocks(batches):
    """Rows (no, doc_id, text) to the distinct blocks of each slice: a number, the block, and all its places.

    A place is a row's number, its blocks and which of them this is; a row's first place has its id and digest too.
    """
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 33
    for whole in batches:
        for part in sliced(whole, "text", SLICE_BYTES):
            data, bounds = utf8(part.column(2))
            raw = lower_ascii(data).tobytes()
            texts = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            counts = np.maximum(1, -(-np.diff(bounds) // BLOCK_BYTES)).astype(np.int32)
            row = np.repeat(np.arange(part.num_rows), counts)
            at = (np.arange(row.size) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
            first = bounds[row] + at.astype(np.int64) * BLOCK_BYTES
            last = np.minimum(bounds[row + 1], first + BLOCK_BYTES)
            index: dict[bytes, int] = {}
            which = np.array([index.setdefault(raw[a:b], len(index)) for a, b in zip(first.tolist(), last.tolist(), strict=True)])
            order = np.argsort(which, kind="stable")
            ends = np.concatenate(([0], np.cumsum(np.bincount(which, minlength=len(index))))).astype(np.int32)
            row, at = row[order], at[order]
            lead = pa.array(np.where(at == 0, row, -1))
            lead = pc.if_else(pc.less(lead, 0), pa.scalar(None, pa.int64()), lead)
            places = pa.StructArray.from_arrays(
                [part.column(0).take(pa.array(row)), part.column(1).take(lead), pa.array(texts, pa.binary()).take(lead), pa.array(counts[row]), pa.array(at)],
                ["no", "doc_id", "sha", "blocks", "at"],
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(number + np.arange(len(index))), pa.array(list(index), pa.binary()), pa.ListArray.from_arrays(ends, places)], ["lot", "block", "places"]
            )
            number += len(index)


def _number(keys: int, parts: int):
    """Names sorted rows: the i-th distinct key of partition p is i * parts + p. Keys are the first columns, without
    nulls but for the second, where a null is below all values."""

    def run(batches):
        last, count = None, -1
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            cols = [pc.coalesce(c, pa.scalar(-1, c.type)) if pa.types.is_integer(c.type) else c for c in batch.columns[:keys]]
            new = np.zeros(n, np.int64)
            for col in cols:
                new[1:] |= pc.not_equal(col[1:], col[:-1]).to_numpy(zero_copy_only=False).astype(np.int64)
            new[0] = last is None or last != [col[0].as_py() for col in cols]
            index = count + np.cumsum(new)
            last, count = [col[n - 1].as_py() for col in cols], int(index[-1])
            names = index * parts + batch.column(batch.num_columns - 1)[0].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns[keys:-1], pa.array(names)], [*batch.schema.names[keys:-1], "name"])

    return run


def _named(keyed: DataFrame, keys: list[str], out: str, parts: int) -> DataFrame:
    """The other columns and a name: equal keys and only those get equal integers, the same in every run."""
    dealt = keyed.repartition(parts, *keys).sortWithinPartitions(*keys)
    return dealt.withColumn("__pid", F.spark_partition_id()).mapInArrow(_number(len(keys), parts), out)


def identities(spark: SparkSession, staging: Staging, rows: DataFrame, parts: int) -> DataFrame:
    """(no, doc_id, sha, blocks, name) for each row of `rows` (no, doc_id, text): normalised texts are equal iff
    (blocks, name) are.

    A slice's equal blocks are one lot, a task's equal lots travel once to be named, and names come back by the lots'
    numbers, of which none repeats; pairs of names are named once each and joined back, by a join that adaptive
    execution can split. So a block or a pair that a third of all rows share costs no task their number.
    """
    lots = staging.write(rows.mapInArrow(_blocks, f"lot long, block binary, places array<{_PLACE}>"), "lots")
    once = lots.groupBy("block").agg(F.collect_list("lot").alias("lots"))
    names = _named(once, ["block"], "lots array<long>, name long", parts).select(F.explode("lots").alias("lot"), "name")
    first = staging.write(lots.select("lot", "places").join(names, "lot").select(F.explode("places").alias("p"), "name").select("p.*", "name"), "level0")
    staging.drop("lots")
    heads = first.where("at = 0").select("no", "doc_id", "sha")
    done = [first.where("blocks = 1").select("no", "doc_id", "sha", "blocks", "name")]
    more = first.where("blocks > 1").select("no", "blocks", "at", "name")
    longest = more.agg(F.max("blocks")).first()[0] or 1
    level, ends = 0, []
    while (1 << level) < longest:
        level += 1
        # Names of a row meet in one row: as many as it has blocks of its own.
        lists = more.groupBy("no", "blocks").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("names"))
        pair = F.transform(
            F.sequence(F.lit(0), F.floor((F.size("names") - 1) / 2).cast("int")),
            lambda i: F.struct(i.alias("at"), F.get(F.col("names"), 2 * i)["name"].alias("l"), F.coalesce(F.get(F.col("names"), 2 * i + 1)["name"], F.lit(-1)).alias("r")),
        )
        pairs = staging.write(lists.select("no", "blocks", F.explode(pair).alias("p")).select("no", "blocks", "p.*"), f"pairs{level}")
        distinct = pairs.select("l", "r").distinct().select("l", "r", F.col("l").alias("l_"), F.col("r").alias("r_"))
        names = _named(distinct, ["l", "r"], "l_ long, r_ long, name long", parts).withColumnsRenamed({"l_": "l", "r_": "r"})
        names = staging.write(names, f"names{level}")
        here = staging.write(pairs.join(names, ["l", "r"]).select("no", "blocks", "at", "name"), f"level{level}")
        staging.drop(f"pairs{level}", f"names{level}")
        over = F.col("blocks") <= F.lit(1 << level)
        ends.append(here.where(over).select("no", "blocks", "name"))
        more = here.where(~over)
    if ends:
        long = ends[0]
        for end in ends[1:]:
            long = long.unionByName(end)
        done.append(long.join(heads, "no").select("no", "doc_id", "sha", "blocks", "name"))
    return done[0].unionByName(done[1]) if ends else done[0]


def _grouped(spark: SparkSession, staging: Staging, rows: DataFrame, size: int | None) -> DataFrame:
    """no, doc_id, keep_id, group_size, kept, sha for each of `rows` (no, doc_id, text)."""
    named_rows = staging.write(identities(spark, staging, rows, parts_for(spark, size, PART_BYTES, factor=2)), "identities")
    best = F.max(F.struct(F.col("doc_id").isNotNull().alias("some"), F.col("doc_id"), (-F.col("no")).alias("neg")))
    groups = named_rows.groupBy("blocks", "name").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
    # Written, so that the join has two plain sides, of which a hot group's can be split.
    groups = staging.write(groups.select("blocks", "name", "group_size", F.col("best.doc_id").alias("keep_id"), (-F.col("best.neg")).alias("keep_no")), "groups")
    return named_rows.join(groups, ["blocks", "name"]).select("no", "doc_id", "keep_id", "group_size", (F.col("no") == F.col("keep_no")).alias("kept"), "sha")


def exact_groups(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of texts that are equal after lower-casing A-Z; null counts as empty.

    Fixed-size blocks are sorted into integer names, then adjacent pairs of names are named until every document has
    one name. Names stand for contents compared byte by byte, and rows are told apart by numbers of their own, so no
    hash decides anything.

    Returns a row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256. Of each group one row stays: that of
    the largest id, null ids last, and of rows that repeat that id the first as read. Other columns of `docs` are not
    read. An empty table gives an empty result.

    The numbers are those of the input's partitions and rows: `docs` must read alike when a task runs again, as files
    and written tables do.
    """
    staging = Staging(spark, "exact_groups")
    rows = docs.select(F.monotonically_increasing_id().alias("no"), named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    out = _grouped(spark, staging, rows, input_bytes(docs))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def keep_distinct(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that exact_groups() keeps: one of each group of equal texts, all columns as they are.

    Null and empty texts are one group. The one with the largest id stays, null ids last; of rows that repeat that id the
    first as read. An empty table gives an empty result.
    """
    staging = Staging(spark, "keep_distinct")
    rows, no = numbered(staging, docs)
    texts = rows.select(F.col(no).alias("no"), named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    return only(rows, no, _grouped(spark, staging, texts, input_bytes(docs)).where("kept"))
