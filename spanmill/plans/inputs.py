"""How the driver's tables play the parts of the library's tables, in Spark and, for the oracles, in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanmill.workers import ship

#: Windows of 2 days every 6 hours over the events of a user, from the start of 2024: the ratio of 2 s to 0.25 s.
SIZE, HOP = 172_800.0, 21_600.0
_START = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Doubles (all, or the named ones) to 6 decimals: sums in another order differ behind those."""
    names = names or tuple(n for n, t in df.dtypes if t in ("double", "float"))
    return df.withColumns({n: F.round(F.col(n).cast("double"), 6) for n in names})


def timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id (the user), event_id, event_type, value, at (seconds)."""
    at = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'{_START}', ts)") / 1e6
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), "event_id", "event_type", "value", at.alias("at"))


def event_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans from each event to its user's next; the last event has none."""
    w = Window.partitionBy("source_id").orderBy("at", "event_id")
    rows = timed_events(spark, sf_dir).withColumn("end", F.lead("at").over(w)).where("end is not null")
    return rows.select("source_id", "event_id", "event_type", "value", F.col("at").alias("start"), "end")


def event_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timed_events(spark, sf_dir).groupBy("source_id").agg(F.max("at").alias("length"))


EVENTS_SQL = f"""
ev AS (SELECT user_id AS source_id, event_id, event_type, value, date_diff('microsecond', TIMESTAMP '{_START}', ts) / 1e6 AS "at" FROM events),
spans AS (SELECT * FROM (SELECT source_id, event_id, event_type, value, "at" AS s, lead("at") OVER (PARTITION BY source_id ORDER BY "at", event_id) AS e FROM ev) WHERE e IS NOT NULL),
sources AS (SELECT source_id, max("at") AS length FROM ev GROUP BY 1)"""


def labels_sql(name: str, spans: str, sources: str, extra: str = "") -> str:
    """A naive overlap join: (source_id, w, label, starts) of every window; extra: more sums over f, the fraction."""
    return f"""
{name}_win AS (SELECT source_id, unnest(range(0, (floor((length - {SIZE}) / {HOP}))::BIGINT + 1)) AS w FROM {sources} WHERE length >= {SIZE}),
{name}_hit AS (SELECT q.source_id, q.w, p.*, CASE WHEN p.e > p.s THEN least(greatest(least(p.e, q.w * {HOP} + {SIZE}) - greatest(p.s, q.w * {HOP}), 0) / (p.e - p.s), 1)
    WHEN p.s >= q.w * {HOP} AND p.s < q.w * {HOP} + {SIZE} THEN 1 ELSE 0 END AS f,
    (p.s >= q.w * {HOP} AND p.s < q.w * {HOP} + {SIZE})::INT AS begun
  FROM {name}_win q LEFT JOIN (SELECT source_id AS sid, * EXCLUDE (source_id) FROM {spans}) p ON p.sid = q.source_id AND p.s < q.w * {HOP} + {SIZE} AND greatest(p.s, p.e) >= q.w * {HOP}),
{name} AS (SELECT source_id, w, coalesce(sum(f), 0.0) AS label, coalesce(sum(begun), 0)::BIGINT AS starts{extra} FROM {name}_hit GROUP BY 1, 2)"""


BAND_SQL = "CASE WHEN {0} < 4 THEN 'under4' WHEN {0} < 6 THEN '4to6' WHEN {0} < 8 THEN '6to8' WHEN {0} >= 8 THEN 'over8' END"
BIN_SQL = "CASE WHEN {0} < 6 THEN 'lt6' WHEN {0} >= 14 THEN 'ge14' ELSE floor({0})::INT || 'to' || (floor({0})::INT + 1) END"
BANDS_SQL = "(VALUES ('under4'), ('4to6'), ('6to8'), ('over8')) AS bands(band)"
BINS_SQL = "(VALUES ('lt6'), ('6to7'), ('7to8'), ('8to9'), ('9to10'), ('10to11'), ('11to12'), ('12to13'), ('13to14'), ('ge14')) AS bins(bin)"


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as truth and prediction: quantity / 4, and the same with discount and tax; condition is the return flag."""
    truth = F.col("l_quantity") / 4
    pred = F.col("l_quantity") * (1 - F.col("l_discount")) / 4 + F.col("l_tax")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", F.col("l_returnflag").alias("condition"), F.col("l_linestatus").alias("status"), "l_discount", "l_tax", truth.alias("truth"), pred.alias("pred")
    )


JUDGED_SQL = """
judged AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag AS condition, l_linestatus AS status, l_discount, l_tax, l_quantity / 4 AS truth,
  l_quantity * (1 - l_discount) / 4 + l_tax AS pred FROM lineitem)"""


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as waveforms of 64 samples."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), "label")


WAVES_SQL = "waves AS (SELECT vec_id, embedding::DOUBLE[] AS x, label FROM embeddings)"
