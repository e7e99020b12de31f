"""Array kernels; embeddings are the waveforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.functions import arrays as ar
from spanmill.functions import signal as sg
from spanmill.functions import waveforms as wf
from spanmill.functions.numeric import drawn_between, hash_uniform
from spanmill.operators import stats
from spanmill.plans.inputs import WAVES_SQL, r6, rounded, waves


def energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(waves(spark, sf_dir).select("vec_id", ar.energy(F.col("x"), 8, 6.0, -15.0).alias("e")).select("vec_id", "e.*"))


def waveform_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(waves(spark, sf_dir).select("vec_id", ar.waveform_stats(F.col("x"), 0.05).alias("w")).select("vec_id", "w.*"))


def frame_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.transform("x", F.abs)
    return rounded(waves(spark, sf_dir).select("vec_id", ar.frame_output_stats(x, (0.1, 0.2)).alias("f")).select("vec_id", "f.*"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = waves(spark, sf_dir)
    return w.join(w.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("noise")), "vec_id")


def snr_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each waveform with the next as noise at 10 dB: the sum's power and its residue's."""
    mixed = _pairs(spark, sf_dir).withColumn("y", ar.mixed_at(F.col("x"), F.col("noise"), F.lit(10.0)))
    rest = F.zip_with("y", "x", lambda a, b: a - b)
    return mixed.select("vec_id", r6(ar.power(F.col("y")) * 1000).alias("power"), r6(10 * F.log10(ar.power(F.col("x")) / ar.power(rest))).alias("snr"))


def gain_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = waves(spark, sf_dir)
    loud = ar.gained(F.col("x"), F.lit(20.0), 0.9)
    masked = ar.masked(F.col("x"), F.lit(8), F.lit(16))
    fitted = ar.fitted(F.col("x"), F.lit(100), F.lit(60))
    padded = ar.padded(F.col("x"), F.lit(80))
    heard = ar.listening_level(F.col("x"), 0.5, 4)
    mono = ar.channel_mean(F.array(F.col("x"), F.reverse("x")))
    return rounded(w.select("vec_id", F.array_max(F.transform(loud, F.abs)).alias("loudest"), ar.total(masked).alias("masked"), ar.total(fitted).alias("fitted"), F.size(padded).alias("padded"), F.array_max(F.transform(heard, F.abs)).alias("heard"), F.size(heard).alias("heard_size"), F.get(mono, F.lit(0)).alias("mono")))


def smooth_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ar.smoothed(F.col("x"), 2)
    return rounded(waves(spark, sf_dir).select("vec_id", ar.total(s).alias("smooth"), ar.rising_crossings(F.col("x"), 4).alias("crossings"), ar.local_maxima(F.col("x")).alias("maxima")))


def rms_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rms = ar.frame_rms(F.col("x"), 16, 8)
    return rounded(waves(spark, sf_dir).select("vec_id", F.size(rms).alias("frames"), ar.total(rms).alias("total"), ar.total(ar.log_envelope(rms, -20.0)).alias("log_total")))


def zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waveforms scaled by the means and deviations per dimension: two arrays of 64 numbers, joined to every row."""
    w = waves(spark, sf_dir)
    per = stats.dimension_stats(w, "x").agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "std"))).alias("s")).first()["s"]
    means, stds = (F.array(*(F.lit(float(r[k])) for r in per)) for k in ("mean", "std"))
    z = ar.normalized(F.col("x"), means, stds)
    return rounded(w.select("vec_id", ar.total(z).alias("total"), F.array_max(z).alias("most")))


def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three neighbouring waveforms put together with gaps."""
    rows = waves(spark, sf_dir).groupBy(F.floor(F.col("vec_id") / 3).cast("long").alias("grp")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "x"))).alias("p"))
    whole = ar.pieces_joined(F.col("p.x"), 10)
    return rounded(rows.select("grp", F.size(whole).alias("samples"), ar.total(whole).alias("total")))


def log_mel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectral features of each waveform, tiled to 0.1 s: frames, bands and their mean."""
    tiled = ar.fitted(F.col("x"), F.lit(1600), F.lit(0))
    rows = waves(spark, sf_dir).select("vec_id", sg.log_mel_udf()(tiled).alias("m"))
    return rows.select("vec_id", F.size("m").alias("frames"), F.size(F.get("m", F.lit(0))).alias("bands"), r6(F.aggregate(F.flatten("m"), F.lit(0.0), lambda a, v: a + v)).alias("total"))


def filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Band-pass, reverberation, and syllables of the level."""
    w = _pairs(spark, sf_dir)
    level = ar.log_envelope(ar.frame_rms(F.col("x"), 4, 1), -40.0)
    band = sg.band_pass_udf(5.0, 20.0, 64.0)(F.col("x"))
    wet = sg.reverberated_udf(F.col("x"), F.col("noise"))
    return w.select("vec_id", r6(ar.power(band)).alias("band"), F.size(wet).alias("wet"), sg.syllable_udf(61.0, 2.0, 10.0, 0.5, 0.05)(level).alias("syllables"))


def stretched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each waveform, tiled to 0.1 s, lengthened by a phase vocoder and sped up by overlapping pieces, by factors drawn by
    its id: lengths and powers."""
    factor = F.round(0.7 + F.pmod("vec_id", F.lit(13)) / 20, 2)
    rows = waves(spark, sf_dir).select("vec_id", factor.alias("factor"), ar.fitted(F.col("x"), F.lit(1600), F.lit(0)).alias("y"))
    rows = rows.select("vec_id", "factor", wf.stretched_udf("y", "factor").alias("a"), wf.sped_up_udf("y", "factor").alias("b"))
    return rows.select("vec_id", "factor", F.size("a").alias("stretched"), F.size("b").alias("sped_up"), r6(ar.power(F.col("a"))).alias("a_power"), r6(ar.power(F.col("b"))).alias("b_power"))


def room_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A room for each waveform, drawn by its id: the response's length, its direct sound's place and its power."""
    u = lambda name, low, high: drawn_between(hash_uniform(F.lit(name), F.col("vec_id").cast("string")), low, high)
    size = F.array(u("x", 3.0, 10.0), u("y", 3.0, 10.0), u("z", 2.3, 4.0))
    inside = lambda name: F.transform("size", lambda v, i: 0.5 + u(name, 0.0, 1.0) * (v - 1.0) * (1 - i / 10))
    # An id is little to send and a room much to compute: rows are dealt out anew, however few tasks read them.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    ids = waves(spark, sf_dir).select("vec_id").repartition(tasks, "vec_id")
    rooms = ids.select("vec_id", size.alias("size"), u("rt60", 0.2, 0.7).alias("rt60"))
    rooms = rooms.select("vec_id", "size", inside("source").alias("source"), inside("mic").alias("mic"), "rt60")
    rows = rooms.select("vec_id", "rt60", wf.room_figures_udf()("size", "source", "mic", "rt60").alias("h"))
    return rows.select("vec_id", r6(F.col("rt60")).alias("rt60"), "h.samples", "h.loudest", r6(F.col("h.power")).alias("power"))


def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forced alignment of three tokens to 16 frames of four classes."""
    rows = waves(spark, sf_dir).select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("x", i * 4 + 1, F.lit(4))).alias("e"))
    spans = sg.aligned_udf(0)(F.col("e"), F.array(F.lit(1), F.lit(1), F.lit(3)))
    return rows.select("vec_id", F.size(spans).alias("spans"), F.get(spans, F.lit(0))["start"].alias("first"), F.element_at(spans, -1)["end"].alias("last"))


QUERIES = {
    "q_energy": energy,
    "q_waveform_stats": waveform_stats,
    "q_frame_outputs": frame_outputs,
    "q_snr_mix": snr_mix,
    "q_gain_mask": gain_mask,
    "q_smooth_crossings": smooth_crossings,
    "q_rms_envelope": rms_envelope,
    "q_zscore": zscore,
    "q_excerpts": excerpts,
    "q_log_mel": log_mel,
    "q_filters": filters,
    "q_alignment": alignment,
    "q_stretched": stretched,
    "q_room_responses": room_responses,
}

_P = lambda x: f"(list_sum(list_transform({x}, lambda v: v * v)) / len({x}))"
_DB = "10 * log10({0} + 1e-10)"
_Q = lambda q: f"(SELECT quantile_cont(v, {q}) FROM (SELECT unnest(db) AS v))"
_ABS = "list_transform(x, lambda v: abs(v))"

ORACLES = {
    "q_energy": f"""WITH {WAVES_SQL}, f AS (SELECT vec_id, x, list_transform(range(8), lambda i: {_DB.format("list_sum(list_transform(x[8 * i + 1 : 8 * i + 8], lambda v: v * v)) / 8")}) AS db FROM waves),
q AS (SELECT vec_id, x, db, {", ".join(f"list_aggregate(db, 'quantile_cont', {q / 100}) AS p{q}" for q in (10, 50, 90, 95, 99))} FROM f)
SELECT vec_id, round({_DB.format(_P("x"))}, 6) AS rms_db, round(20 * log10(list_max({_ABS}) + 1e-10), 6) AS peak_db, {", ".join(f"round(p{q}, 6) AS frame_p{q}" for q in (10, 50, 90, 99))}, round(p95 - p10, 6) AS frame_range,
  round(len(list_filter(db, lambda v: v > p10 + 6)) / 8, 6) AS rel_share, round(len(list_filter(db, lambda v: v > -15)) / 8, 6) AS abs_share FROM q""",
    "q_waveform_stats": f"WITH {WAVES_SQL} SELECT vec_id, round(sqrt({_P('x')}), 6) AS rms, round(list_max({_ABS}), 6) AS peak, round(len(list_filter(x, lambda v: abs(v) < 0.05)) / 64, 6) AS silent_share FROM waves",
    "q_frame_outputs": f"""WITH {WAVES_SQL}, a AS (SELECT vec_id, {_ABS} AS x FROM waves)
SELECT vec_id, 64 AS frames, round(list_sum(x), 6) AS sum, round(list_avg(x), 6) AS mean, round(list_median(x), 6) AS median, round(list_aggregate(x, 'quantile_cont', 0.9), 6) AS p90, round(list_aggregate(x, 'quantile_cont', 0.99), 6) AS p99,
  round(list_max(x), 6) AS max, round(list_min(x), 6) AS min, round(list_sum(list_reverse_sort(x)[1:7]) / list_sum(x), 6) AS top_tenth_share, round(len(list_filter(x, lambda v: v > 0.1)) / 64, 6) AS over_0p1, round(len(list_filter(x, lambda v: v > 0.2)) / 64, 6) AS over_0p2 FROM a""",
    "q_snr_mix": f"""WITH {WAVES_SQL}, p AS (SELECT a.vec_id, a.x, b.x AS n FROM waves a JOIN waves b ON b.vec_id = a.vec_id + 1), k AS (SELECT *, sqrt({_P("x")} / ({_P("n")} * 10)) AS s FROM p),
y AS (SELECT vec_id, x, list_transform(range(1, 65), lambda i: x[i] + s * n[i]) AS y FROM k), r AS (SELECT *, list_transform(range(1, 65), lambda i: y[i] - x[i]) AS d FROM y)
SELECT vec_id, round({_P("y")} * 1000, 6) AS power, round(10 * log10({_P("x")} / {_P("d")}), 6) AS snr FROM r""",
    "q_gain_mask": f"""WITH {WAVES_SQL}, m AS (SELECT *, list_max({_ABS}) AS top FROM waves)
SELECT vec_id, round(CASE WHEN top * 10 > 0.9 THEN 0.9 ELSE top * 10 END, 6) AS loudest, round(list_sum(x[1:8]) + list_sum(x[25:64]), 6) AS masked,
  round(list_sum(list_transform(range(100), lambda i: x[(60 + i) % 64 + 1])), 6) AS fitted, 80 AS padded, 0.5 AS heard, 72 AS heard_size, round((x[1] + x[64]) / 2, 6) AS mono FROM m""",
    "q_smooth_crossings": f"""WITH RECURSIVE {WAVES_SQL}, c AS (SELECT vec_id, list_filter(range(2, 65), lambda i: x[i - 1] <= 0 AND x[i] > 0) AS hits FROM waves),
k AS (SELECT vec_id, hits, 1 AS i, 0 AS n, -1000000::BIGINT AS l FROM c UNION ALL SELECT vec_id, hits, i + 1, n + (hits[i] - l >= 4)::INT, CASE WHEN hits[i] - l >= 4 THEN hits[i] ELSE l END FROM k WHERE i <= len(hits)),
d AS (SELECT vec_id, max(n)::INT AS crossings FROM k GROUP BY 1)
SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: (x[greatest(i - 2, 1)] + x[greatest(i - 1, 1)] + x[i] + x[least(i + 1, 64)] + x[least(i + 2, 64)]) / 5)), 6) AS smooth, crossings,
  len(list_filter(range(2, 64), lambda i: x[i] > x[i - 1] AND x[i] >= x[i + 1]))::INT AS maxima FROM waves JOIN d USING (vec_id)""",
    "q_rms_envelope": f"""WITH {WAVES_SQL}, r AS (SELECT vec_id, list_transform(range(7), lambda i: sqrt(list_sum(list_transform(x[8 * i + 1 : 8 * i + 16], lambda v: v * v)) / 16)) AS r FROM waves)
SELECT vec_id, 7 AS frames, round(list_sum(r), 6) AS total, round(list_sum(list_transform(r, lambda v: 20 * log10(greatest(v, greatest(list_max(r), 1e-10) * 0.1)))), 6) AS log_total FROM r""",
    "q_zscore": """WITH c AS (SELECT vec_id, unnest(range(64)) AS d, unnest(embedding::DOUBLE[]) AS x FROM embeddings), s AS (SELECT d, avg(x) AS m, stddev_pop(x) AS s FROM c GROUP BY 1),
z AS (SELECT vec_id, (x - m) / CASE WHEN s > 0 THEN s ELSE 1 END AS z FROM c JOIN s USING (d)) SELECT vec_id, round(sum(z), 6) AS total, round(max(z), 6) AS most FROM z GROUP BY 1""",
    "q_excerpts": f"WITH {WAVES_SQL} SELECT vec_id // 3 AS grp, (count(*) * 64 + (count(*) - 1) * 10)::INT AS samples, round(sum(list_sum(x)), 6) AS total FROM waves GROUP BY 1",
}
