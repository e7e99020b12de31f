"""What the operators share: tables written to the shared folder, row keys, reading sizes."""

from __future__ import annotations

import contextlib
import math
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.workers import ship

#: Used only where the session names no shared folder (tests on one machine).
LOCAL_SHARED_DIR = "/tmp/checkpoints/spanmill"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, else a local one on local masters only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return LOCAL_SHARED_DIR


class Staging:
    """Tables of one operator run under one folder of the shared store.

    A staged table cuts the lineage: a lost executor recomputes only from the last written table. Tables that later
    steps no longer need are dropped at once; the rest go at the end of released(), else when the JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._path(self.root, lambda fs, path: fs.mkdirs(path) and fs.deleteOnExit(path))
        for opened in _RELEASED:
            opened.append(self)

    def _path(self, at: str, act) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(at)
        act(path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path)

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{tag}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{tag}")

    def drop(self, *tags: str) -> None:
        for tag in tags:
            self._path(f"{self.root}/{tag}", lambda fs, path: fs.delete(path, True))

    def release(self) -> None:
        self._path(self.root, lambda fs, path: fs.delete(path, True))


#: Lists of the staging folders that were opened within released(), the outermost first.
_RELEASED: list[list[Staging]] = []


@contextlib.contextmanager
def released() -> Iterator[None]:
    """Deletes at its end all staging folders opened within it; results that read them must be written by then."""
    opened: list[Staging] = []
    _RELEASED.append(opened)
    try:
        yield
    finally:
        _RELEASED.remove(opened)
        for staging in opened:
            staging.release()


#: More partitions than this cost more to schedule than they save; a partition is then larger, and spills.
MOST_PARTS = 1 << 16
_UNKNOWN = 1 << 60


def input_bytes(df: DataFrame) -> int | None:
    """The optimizer's size of the input, from file sizes; no job runs. None where it knows none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < _UNKNOWN else None


def parts_for(spark: SparkSession, size: int | None, each: int, factor: float = 1, most: int = MOST_PARTS) -> int:
    """Partitions of about `each` bytes of factor * size, never fewer than the session's shuffle partitions, which are
    also the answer for an unknown size."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(most, math.ceil((size or 0) * factor / each)))


def key_hash(*cols: Column | str) -> Column:
    """A 52-bit uniform integer that DuckDB computes alike: the first 13 hex digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, 13), 16, 10).cast("long")


def named(name: str) -> Column:
    """The column of that very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """`wanted`, each led by as many underscores as it takes to clash with no name in `taken`, whatever the case."""
    used, out = {n.lower() for n in taken}, []
    for name in wanted:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def numbered(staging: Staging, rows: DataFrame, tag: str = "rows") -> tuple[DataFrame, str]:
    """`rows`, written with a number of its own for each row, and that column's name.

    The number, not the id and not a hash, tells rows apart, so null and repeated ids and equal texts are safe, and no
    key of a later join is hot. Once written the numbers are fixed, whatever executors are lost.
    """
    (no,) = free_names(rows.columns, "__no")
    return staging.write(rows.withColumn(no, F.monotonically_increasing_id()), tag), no


def only(rows: DataFrame, no: str, kept: DataFrame) -> DataFrame:
    """The rows whose number is in the column `no` of `kept`, without the number."""
    return rows.join(kept.select(F.col("no").alias(no)), no, "left_semi").select(*(named(n) for n in rows.columns if n != no))
