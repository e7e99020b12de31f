"""A results table with a locked schema: checked appends, migrations that only add columns, comparisons by session."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanmill.functions.numeric import BAND_KEYS

IDENTITY = ("experiment_id", "method", "config_path", "split")
MEASURES = ("n", "mae", *(f"mae_{k}" for k in BAND_KEYS), *(f"n_{k}" for k in BAND_KEYS), "r")
PROVENANCE = ("commit", "timestamp")
LATENCY = ("latency_session_id", "latency_ms_median", "latency_ms_max")
PLACE = ("host", "device")
COLUMNS = (*IDENTITY, *MEASURES, *PROVENANCE, *LATENCY, *PLACE)
#: Earlier layouts, each a prefix of the present one, and what an upgrade adds to them.
LAYOUTS = (COLUMNS[: -len(LATENCY) - len(PLACE)], COLUMNS[: -len(PLACE)])


class SchemaDrift(ValueError):
    """Columns that are missing, unknown or in another order."""


class SessionMismatch(ValueError):
    """Measurements that no single session holds."""


def _type(name: str) -> T.DataType:
    if name == "n" or name.startswith("n_"):
        return T.LongType()
    return T.DoubleType() if name in MEASURES or name.startswith("latency_ms") else T.StringType()


SCHEMA = T.StructType([T.StructField(n, _type(n)) for n in COLUMNS])


def results_rows(rows: DataFrame) -> DataFrame:
    """Rows as the table wants them: exactly its columns, in its order and types, NaN as null."""
    missing, unknown = [c for c in COLUMNS if c not in rows.columns], [c for c in rows.columns if c not in COLUMNS]
    if missing or unknown:
        raise SchemaDrift(f"missing {missing}, unknown {unknown}")
    clean = lambda f: F.nanvl(F.col(f.name).cast("double"), F.lit(None).cast("double")) if isinstance(f.dataType, T.DoubleType) else F.col(f.name).cast(f.dataType)
    return rows.select(*(clean(f).alias(f.name) for f in SCHEMA.fields))


def _read(spark: SparkSession, path: str, form: str) -> DataFrame:
    return spark.read.format(form).options(**({"header": "true"} if form == "csv" else {})).load(path)


def _write(rows: DataFrame, path: str, form: str, mode: str) -> None:
    rows.write.mode(mode).format(form).options(**({"header": "true"} if form == "csv" else {})).save(path)


def results(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """The table's rows in their types; CSV holds a missing value as an empty field."""
    return results_rows(_read(spark, path, form))


def append_results(spark: SparkSession, rows: DataFrame, path: str, form: str = "parquet") -> None:
    """Appends to a table at `path`, Parquet or CSV with headers; one of another layout is refused, not adapted."""
    present = existing_columns(spark, path, form)
    if present and present != COLUMNS:
        raise SchemaDrift("an earlier layout: upgrade it first" if present in LAYOUTS else f"unknown layout {present}")
    _write(results_rows(rows), path, form, "append")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def existing_columns(spark: SparkSession, path: str, form: str = "parquet") -> tuple[str, ...]:
    return tuple(_read(spark, path, form).columns) if _exists(spark, path) else ()


def upgrade_results(spark: SparkSession, path: str, form: str = "parquet") -> bool:
    """Adds the missing trailing columns, as nulls; other values stay. False if there is nothing to add.

    The new version is written beside the old one; the old one is renamed aside, the new one into its place, and only
    then is the old one deleted. A crash leaves a whole version at `path` or beside it, which the next call restores.
    """
    jvm = spark.sparkContext._jvm
    place, aside, made = (jvm.org.apache.hadoop.fs.Path(f"{path}{end}") for end in ("", ".replaced", ".upgrading"))
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(place) and fs.exists(aside):
        fs.rename(aside, place)
    present = existing_columns(spark, path, form)
    if present == COLUMNS:
        fs.delete(aside, True)
        return False
    if present not in LAYOUTS:
        raise SchemaDrift(f"unknown layout {present}")
    old = _read(spark, path, form)
    added = {f.name: F.lit(None).cast("string" if form == "csv" else f.dataType) for f in SCHEMA.fields if f.name not in present}
    _write(old.withColumns(added).select(*COLUMNS), f"{path}.upgrading", form, "overwrite")
    fs.delete(aside, True)
    if not fs.rename(place, aside):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(made, place):
        fs.rename(aside, place)
        raise OSError(f"cannot put the new version at {path}")
    fs.delete(aside, True)
    return True


def sessions_with_all(rows: DataFrame, names: Sequence[str], session: str, name: str, at: str) -> DataFrame:
    """Sessions that hold every one of the names (relational division), with their newest time."""
    wanted = sorted(set(names))
    found = rows.where(F.col(name).isin(*wanted) & (F.trim(F.coalesce(F.col(session).cast("string"), F.lit(""))) != ""))
    return found.groupBy(session).agg(F.count_distinct(name).alias("names"), F.max(at).alias("newest")).where(F.col("names") == len(wanted)).drop("names")


def compare_sessions(rows: DataFrame, names: Sequence[str], session: str = "latency_session_id", name: str = "experiment_id", at: str = "timestamp") -> DataFrame:
    """The rows of the names in the newest session that holds them all; raises SessionMismatch if there is none."""
    best = sessions_with_all(rows, names, session, name, at).orderBy(F.desc("newest"), F.desc(session)).limit(1)
    if best.isEmpty():
        raise SessionMismatch(f"no session holds all of {sorted(set(names))}")
    return rows.where(F.col(name).isin(*names)).join(best.select(session), session, "left_semi")


def latency_summary(times: DataFrame, keys: Sequence[str], ms: str, warmup: Column | None = None) -> DataFrame:
    """Median, maximum, mean and count of the times that are not warm-up."""
    kept = times.where(~warmup) if warmup is not None else times
    return kept.groupBy(*keys).agg(F.median(ms).alias("median_ms"), F.max(ms).alias("max_ms"), F.avg(ms).alias("mean_ms"), F.count(F.lit(1)).alias("n"))
