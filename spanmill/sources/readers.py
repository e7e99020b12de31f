"""Readers. Paths are opened by Spark, so any store that Spark reads will do."""

from __future__ import annotations

import dataclasses
import io
import wave
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanmill.functions.signal import resampled, to_mono
from spanmill.operators.catalog import Violation, assert_unique
from spanmill.sources import schemas


class HeldOut(PermissionError):
    """A held-out split that was not explicitly allowed."""


def transcripts(spark: SparkSession, path: str, schema: T.StructType = schemas.TRANSCRIPT) -> DataFrame:
    """A TSV with a header and no quoting: quotes are ordinary characters. Columns are found by name."""
    rows = spark.read.csv(path, sep="\t", quote="", header=True, inferSchema=False)
    return rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields))


def durations(spark: SparkSession, path: str) -> DataFrame:
    """(path, duration in seconds) from a TSV of milliseconds; short rows and non-integers are left out."""
    rows = spark.read.schema(schemas.DURATIONS).csv(path, sep="\t", quote="", header=True, enforceSchema=True)
    return rows.select("path", (F.trim("ms").try_cast("int") / 1000.0).alias("duration")).where("path is not null and duration is not null")


def json_lines(spark: SparkSession, path: str, schema: T.StructType, key: str | None = None, tolerant: bool = False) -> DataFrame:
    """JSON lines under a schema. Blank lines are skipped; a repeated key is an error.

    A malformed line is an error, or, if tolerant, left out (a last line that was cut off, say).
    """
    out = spark.read.schema(schema).json(path, mode="DROPMALFORMED" if tolerant else "FAILFAST")
    return assert_unique(out, [key]) if key else out


def items(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, schemas.ITEM)


def alignments(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    return json_lines(spark, path, schemas.ALIGNMENT, key="item_id", tolerant=tolerant)


def commented_ids(spark: SparkSession, path: str, column: str = "clip_id") -> DataFrame:
    """Distinct ids of a TSV with a header and # comments."""
    return spark.read.csv(path, sep="\t", header=True, comment="#", quote="").select(column).where(f"{column} is not null").distinct()


def id_list(spark: SparkSession, path: str, column: str = "item_id") -> DataFrame:
    """One id a line; blank lines are skipped, a repeated id is an error."""
    rows = spark.read.text(path).select(F.trim("value").alias(column)).where(f"{column} != ''")
    return assert_unique(rows, [column])


def keyed_text(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of `id:text` lines; a line without a separator is an error."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    if not rows.where(~F.col("value").contains(":")).isEmpty():
        raise Violation("a line has no separator")
    parts = F.split("value", ":", 2)
    return rows.select(F.trim(parts[0]).alias("id"), F.trim(parts[1]).alias("text"))


def yaml_map(spark: SparkSession, text: str) -> DataFrame:
    """(id, field, value) of a two-level YAML map, given as text."""
    import yaml

    rows = [(str(k), str(f), None if v is None else str(v)) for k, fields in (yaml.safe_load(text) or {}).items() for f, v in fields.items()]
    return spark.createDataFrame(rows, "id string, field string, value string")


def split_ids(spark: SparkSession, path: str, held_out: Sequence[str] = ("test",), allow_held_out: bool = False) -> DataFrame:
    """(split, client_id) of one or more split documents. A held-out split must be allowed by name of the argument."""
    doc = spark.read.schema(schemas.SPLIT).json(path, multiLine=True)
    if not allow_held_out and not doc.where(F.col("split").isin(*held_out)).isEmpty():
        raise HeldOut("a held-out split was not allowed")
    return doc.select("split", F.explode("client_ids").alias("client_id"))


def waveforms(spark: SparkSession, path: str, rate: int = 16000) -> DataFrame:
    """(path, rate, samples) of WAV files, as mono floats at `rate`. Files are decoded in Arrow batches of a few rows."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for name, content in zip(frame["path"], frame["content"], strict=True):
                with wave.open(io.BytesIO(content)) as f:
                    width, channels, own = f.getsampwidth(), f.getnchannels(), f.getframerate()
                    raw = np.frombuffer(f.readframes(f.getnframes()), {1: np.uint8, 2: "<i2", 4: "<i4"}[width])
                x = (raw.astype(np.float32) - 128) / 128 if width == 1 else raw.astype(np.float32) / float(1 << (8 * width - 1))
                out.append((name, rate, resampled(to_mono(x.reshape(-1, channels)), own, rate).astype(np.float32)))
            yield pd.DataFrame(out, columns=["path", "rate", "samples"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "path string, rate int, samples array<float>")


def grouped_files(spark: SparkSession, root: str, pattern: str = "*.wav") -> DataFrame:
    """(grp, path) of files below a folder, by their first sub-folder. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    below = F.regexp_extract("path", "^.*?" + _quoted(root.rstrip("/").split("://")[-1].rstrip("/")) + "/(.*)$", 1)
    return files.select(below.alias("path")).select(F.substring_index("path", "/", 1).alias("grp"), "path")


def _quoted(s: str) -> str:
    return "\\Q" + s + "\\E"


def features(spark: SparkSession, path: str, ids: DataFrame | None = None, low: int | None = None, high: int | None = None, limit: int | None = None) -> DataFrame:
    """Feature rows, filtered by id and frame bounds (pushed into the scan), the first `limit` by id."""
    out = spark.read.schema(schemas.FEATURE).parquet(path)
    out = out.where(F.col("frames") >= low) if low is not None else out
    out = out.where(F.col("frames") <= high) if high is not None else out
    out = out.join(ids.select("item_id"), "item_id", "left_semi") if ids is not None else out
    return out.orderBy("item_id").limit(limit) if limit is not None else out


def window_set(spark: SparkSession, path: str, complete_only: bool = True) -> DataFrame:
    """The windows of a stored set; a set whose writer did not finish is refused."""
    out = spark.read.schema(schemas.WINDOW).parquet(f"{path}/windows")
    if complete_only and not spark.read.json(f"{path}/meta").select("complete").first()[0]:
        raise Violation("the window set is not complete")
    return out


def sentences(spark: SparkSession, path: str) -> DataFrame:
    """(id, text): a TSV with id and text, or plain lines, numbered in order of their place in one file."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    rows = rows.where(F.trim("line") != "").where(~F.col("line").startswith("#"))
    two = F.split("line", "\t", 2)
    return rows.select(
        F.when(F.size(two) == 2, two[0]).otherwise(F.format_string("%03d", F.col("at") + 1)).alias("id"),
        F.when(F.size(two) == 2, F.get(two, F.lit(1))).otherwise(F.col("line")).alias("text"),
    )


def measured_rows(spark: SparkSession, path: str, session: str = "latency_session_id") -> DataFrame:
    """Rows of a results CSV that name a session."""
    return spark.read.csv(path, header=True, inferSchema=False).where(F.trim(F.coalesce(F.col(session), F.lit(""))) != "")


def file_counts(spark: SparkSession, path: str) -> DataFrame:
    """(file, records, chars) of text files: lines and their characters."""
    return spark.read.text(path).groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("records"), F.sum(F.length("value")).alias("chars"))


def folder_size(spark: SparkSession, path: str) -> DataFrame:
    """(files, bytes, largest) below a folder, from the listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length")
    return files.agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.max("length").alias("largest"))


def configured(kind: type, values: Mapping):
    """A frozen dataclass from a mapping; unknown keys are an error."""
    known = {f.name for f in dataclasses.fields(kind)}
    if unknown := sorted(set(values) - known):
        raise ValueError(f"unknown settings {unknown}")
    return kind(**values)
