"""Evaluation, statistics and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.functions.arrays import power
from spanmill.functions.numeric import BAND_KEYS, band, digitized
from spanmill.operators import metrics as me
from spanmill.operators import registry, rules, stats
from spanmill.plans.inputs import BAND_SQL, BANDS_SQL, BIN_SQL, BINS_SQL, JUDGED_SQL, event_spans, judged, rounded, table, waves


def segment_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(me.segment_metrics(judged(spark, sf_dir), ["condition"]))


def band_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(me.band_summary(judged(spark, sf_dir), ["condition"]))


def bin_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(me.bin_summary(judged(spark, sf_dir)))


def reported_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(me.reported_bins(judged(spark, sf_dir), "dev", ("10to11", "11to12", "12to13", "13to14", "ge14")))


def pooled_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(me.pooled(judged(spark, sf_dir), "condition"))


def zero_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(me.zero_summary(judged(spark, sf_dir).where("truth < 1").withColumn("pred", F.col("l_discount") * 30), ["condition"]))


def scoped_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    scopes = {"all": F.lit(True), "main": F.col("l_discount") > 0, "single": F.col("status") == "F", "long": F.col("truth") >= 6}
    return rounded(me.scoped_summary(judged(spark, sf_dir), "condition", scopes))


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(spark, sf_dir).withColumn("weight", 1 + F.col("l_tax"))
    return rounded(rows.groupBy("condition").agg(*me.loss_aggregates(weight="weight")))


def ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(spark, sf_dir).withColumn("bias", F.col("pred") - F.col("truth"))
    return rounded(stats.slope(rows, "bias", "l_discount", "truth", ["condition"]), "slope")


def _biased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.adjusted(judged(spark, sf_dir).withColumn("bias", F.col("pred") - F.col("truth")), "truth", "bias")


def adjusted_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_biased(spark, sf_dir).groupBy("condition", "status").agg(F.avg("adjusted").alias("adjusted"), F.max("adjusted").alias("most"), F.count(F.lit(1)).alias("n")))


def group_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.group_table(_biased(spark, sf_dir), digitized(F.col("l_discount"), (0.02, 0.05, 0.08, 0.5)), 5))


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(spark, sf_dir).withColumn("bias", F.col("pred") - F.col("truth"))
    return stats.joint_regression(rows, "bias", ["l_discount", "l_tax", "truth"], "l_suppkey")


def band_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discount and tax by band of the truth, resampled by supplier."""
    rows = judged(spark, sf_dir).withColumn("bias", F.col("pred") - F.col("truth")).withColumn("band", band(F.col("truth")))
    return rounded(stats.band_analysis(rows, "bias", ["l_discount", "l_tax"], "truth", "l_suppkey", "band"))


def regression_coefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full-sample coefficients of the same regression with two columns, which SQL can give too."""
    rows = judged(spark, sf_dir).withColumn("bias", F.col("pred") - F.col("truth"))
    found = stats.joint_regression(rows, "bias", ["l_discount", "truth"], "l_suppkey", reps=1).where("name = 'l_discount'")
    return rounded(found.select("name", "coef"), "coef")


def log_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = event_spans(spark, sf_dir).withColumn("gap", F.col("end") - F.col("start"))
    return rounded(stats.log_fences(spans, "gap", 3.0, ["event_type"]))


def log_fences_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.log_fences(table(spark, sf_dir, "orders"), "o_totalprice"))


def weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.weighted_median(table(spark, sf_dir, "part"), "p_retailprice", "p_size")


def constant_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.constant_baseline(judged(spark, sf_dir), "truth"))


def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.grid_search(judged(spark, sf_dir), [0.9, 0.95, 1.0, 1.05, 1.1], "pred", "truth"))


def mannwhitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.rank_sum(table(spark, sf_dir, "lineitem"), "l_returnflag", "A", "R", "l_quantity", ["l_linestatus"]))


def holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A family a brand: over all parts as one, nearly every adjusted value would be 1."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") % 9 != 0, F.col("p_size") / 2000.0).alias("p"))
    return rounded(stats.holm(rows, "p", ["p_partkey"], ["p_brand"]).drop("p_brand"))


def batch_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_extendedprice")
    out = stats.batch_weights(rows.withColumn("ratio", F.col("l_discount") * 10), "l_orderkey", "ratio", 2.0, 2.5)
    return rounded(out.groupBy("l_linenumber").agg(F.avg("weight").alias("mean"), F.max("weight").alias("most"), F.count(F.lit(1)).alias("n")))


def dimension_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.dimension_stats(waves(spark, sf_dir), "x"))


def application_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.application_rates(20_000, {"noise": 0.5, "reverb": 0.3, "volume": 0.1}, spark=spark))


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as measurements: the hour is the session, the event type the experiment."""
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, sf_dir, "events").select(F.date_format("ts", "yyyyMMddHH").alias("latency_session_id"), F.col("event_type").alias("experiment_id"), at.alias("timestamp"), "event_id", "value")


def session_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.compare_sessions(_measured(spark, sf_dir), ["view", "click"])


def complete_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.sessions_with_all(_measured(spark, sf_dir), ["view", "click", "purchase"], "latency_session_id", "experiment_id", "timestamp")


def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rounded(registry.latency_summary(rows, ["event_type"], "value", F.col("event_id") % 10 == 0))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return waves(spark, sf_dir).select("vec_id", (F.col("label") == 3).alias("known"), power(x).alias("power"), F.array_max(x).alias("peak"), F.aggregate(x, F.lit(0.0), lambda a, v: a + v).alias("total"))


def rule_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = [("peak", ">=", 0.2), ("total", "<", 0.5)]
    return rounded(rules.flagged(_metrics(spark, sf_dir), rule, ["vec_id"]).select("vec_id", "known", "peak", "total"))


def cover_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rules.covering_conditions(_metrics(spark, sf_dir), "known", ["power", "peak", "total"], 0.01))


def rule_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best conjunctions: a top-k report."""
    bounds = [("power", ">=", 0.015), ("peak", ">=", 0.25), ("total", "<=", 1.0), ("total", ">=", -1.0)]
    return rules.candidate_rules(_metrics(spark, sf_dir), "known", bounds)


QUERIES = {
    "q_segment_metrics": segment_metrics,
    "q_band_metrics": band_metrics,
    "q_bin_metrics": bin_metrics,
    "q_reported_bins": reported_bins,
    "q_pooled_metrics": pooled_metrics,
    "q_zero_windows": zero_windows,
    "q_scoped_metrics": scoped_metrics,
    "q_losses": losses,
    "q_ols": ols,
    "q_adjusted_bias": adjusted_bias,
    "q_group_table": group_table,
    "q_bootstrap_ci": bootstrap_ci,
    "q_band_analysis": band_analysis,
    "q_regression_coefs": regression_coefs,
    "q_log_fences": log_fences,
    "q_log_fences_all": log_fences_all,
    "q_weighted_median": weighted_median,
    "q_constant_baseline": constant_baseline,
    "q_grid_search": grid_search,
    "q_mannwhitney_u": mannwhitney,
    "q_holm": holm,
    "q_batch_weights": batch_weights,
    "q_dimension_stats": dimension_stats,
    "q_application_rates": application_rates,
    "q_session_compare": session_compare,
    "q_complete_sessions": complete_sessions,
    "q_latency_summary": latency_summary,
    "q_rule_filter": rule_filter,
    "q_cover_conditions": cover_conditions,
    "q_rule_search": rule_search,
}

_R = "CASE WHEN count(*) >= 2 AND var_pop(truth) > 0 AND var_pop(pred) > 0 THEN round(covar_pop(truth, pred) / sqrt(var_pop(truth) * var_pop(pred)), 6) END AS r"
_ERR = f"count(*) AS n, round(avg(abs(pred - truth)), 6) AS mae, round(avg(pred - truth), 6) AS bias, {_R}, round(avg(truth), 6) AS truth_mean, round(avg(pred), 6) AS pred_mean"
_B = BAND_SQL.format("truth")
_FENCE = """{0} lg AS (SELECT {1} AS k, ln({2}) AS l FROM {3} WHERE {2} > 0), md AS (SELECT k, median(l) AS m FROM lg GROUP BY 1), sg AS (SELECT k, any_value(m) AS m, 1.4826 * median(abs(l - m)) AS s FROM lg JOIN md USING (k) GROUP BY 1)
SELECT {4} round(exp(m - 3 * s), 6) AS lower, round(exp(m + 3 * s), 6) AS upper, round(exp(m), 6) AS middle, round(s, 6) AS sigma FROM sg"""
_ADJ = "adj AS (SELECT *, pred - truth AS bias, (pred - truth) - avg(pred - truth) OVER (PARTITION BY floor(truth / 0.5)) AS adjusted FROM judged)"
_MEAS = "m AS (SELECT strftime(ts, '%Y%m%d%H') AS latency_session_id, event_type AS experiment_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, event_id, value FROM events)"
_W = """w AS (SELECT vec_id, label = 3 AS known, list_sum(list_transform(x, lambda v: v * v)) / len(x) AS power, list_max(x) AS peak, list_reduce(x, lambda a, b: a + b) AS total FROM (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings))"""
_U = "(('0x' || substr(sha256('42:' || nm || ':' || id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"

ORACLES = {
    "q_segment_metrics": f"""WITH {JUDGED_SQL}, j AS (SELECT *, {_B} AS band, abs(pred - truth) AS e FROM judged)
SELECT condition, count(*) AS n, round(avg(e), 6) AS mae, {", ".join(f"round(avg(e) FILTER (band = '{k}'), 6) AS mae_{k}, count(*) FILTER (band = '{k}') AS n_{k}" for k in BAND_KEYS)}, {_R} FROM j GROUP BY 1""",
    "q_band_metrics": f"""WITH {JUDGED_SQL}, g AS (SELECT condition, {_B} AS band, count(*) AS n, round(avg(abs(pred - truth)), 6) AS mae, round(avg(pred - truth), 6) AS bias FROM judged GROUP BY 1, 2)
SELECT condition, band, coalesce(n, 0) AS n, mae, bias FROM (SELECT DISTINCT condition FROM judged) CROSS JOIN {BANDS_SQL} LEFT JOIN g USING (condition, band)""",
    "q_bin_metrics": f"""WITH {JUDGED_SQL}, g AS (SELECT {BIN_SQL.format("truth")} AS bin, count(*) AS n, round(avg(truth), 6) AS truth_mean, round(avg(pred), 6) AS pred_mean, round(quantile_cont(pred, 0.1), 6) AS pred_p10,
  round(quantile_cont(pred, 0.9), 6) AS pred_p90, round(avg(pred - truth), 6) AS bias, round(avg(abs(pred - truth)), 6) AS mae FROM judged GROUP BY 1)
SELECT bin, coalesce(n, 0) AS n, truth_mean, pred_mean, pred_p10, pred_p90, bias, mae FROM {BINS_SQL} LEFT JOIN g USING (bin)""",
    "q_reported_bins": f"""WITH {JUDGED_SQL}, g AS (SELECT {BIN_SQL.format("truth")} AS bin, grouping({BIN_SQL.format("truth")}) AS whole, count(*) AS n, round(avg(abs(pred - truth)), 6) AS mae, {_R}
  FROM judged GROUP BY GROUPING SETS (({BIN_SQL.format("truth")}), ()))
SELECT CASE WHEN whole = 1 THEN 'dev' ELSE 'dev_bin_' || bin END AS split, n, mae, r FROM g WHERE whole = 1 OR bin IN ('10to11', '11to12', '12to13', '13to14', 'ge14')""",
    "q_pooled_metrics": f"WITH {JUDGED_SQL} SELECT CASE WHEN grouping(condition) = 1 THEN 'pooled' ELSE condition END AS scope, {_ERR} FROM judged GROUP BY ROLLUP (condition)",
    "q_zero_windows": f"""WITH {JUDGED_SQL}, z AS (SELECT condition, l_discount * 30 AS p FROM judged WHERE truth < 1)
SELECT condition, count(*) AS n, round(avg(p), 6) AS mean, round(avg(p) / 2, 6) AS mean_rate, round(max(p), 6) AS max,
  {", ".join(f"round(avg((p >= {t})::INT), 6) AS ge_{n}" for t, n in ((0.5, "0p5"), (1, "1"), (2, "2")))}, {", ".join(f"round(quantile_cont(p, {q}), 6) AS q{int(q * 100):02d}" for q in (0.05, 0.25, 0.5, 0.75, 0.95))} FROM z GROUP BY 1""",
    "q_scoped_metrics": f"""WITH {JUDGED_SQL}, s AS (SELECT *, 'all' AS scope FROM judged UNION ALL SELECT *, 'main' FROM judged WHERE l_discount > 0 UNION ALL SELECT *, 'single' FROM judged WHERE status = 'F' UNION ALL SELECT *, 'long' FROM judged WHERE truth >= 6)
SELECT condition, scope, {_ERR} FROM s GROUP BY 1, 2""",
    "q_losses": f"""WITH {JUDGED_SQL} SELECT condition, round(avg((pred - truth) ** 2), 6) AS mse, round(avg(pred - truth * ln(pred + 1e-8)), 6) AS poisson, round(avg((1 + l_tax) * (pred - truth) ** 2), 6) AS weighted_mse FROM judged GROUP BY 1""",
    "q_ols": f"""WITH {JUDGED_SQL}, c AS (SELECT condition, count(*) AS n, var_pop(l_discount) AS xx, var_pop(truth) AS zz, covar_pop(l_discount, truth) AS xz, covar_pop(l_discount, pred - truth) AS xy, covar_pop(truth, pred - truth) AS zy FROM judged GROUP BY 1)
SELECT condition, n, CASE WHEN n >= 10 THEN round((xy * zz - zy * xz) / (xx * zz - xz * xz), 6) END AS slope FROM c""",
    "q_adjusted_bias": f"WITH {JUDGED_SQL}, {_ADJ} SELECT condition, status, round(avg(adjusted), 6) AS adjusted, round(max(adjusted), 6) AS most, count(*) AS n FROM adj GROUP BY 1, 2",
    "q_group_table": f"""WITH {JUDGED_SQL}, {_ADJ}, g AS (SELECT (l_discount >= 0.02)::INT + (l_discount >= 0.05)::INT + (l_discount >= 0.08)::INT + (l_discount >= 0.5)::INT AS grp, count(*) AS n,
  round(avg(truth), 6) AS truth_mean, round(avg(bias), 6) AS bias, round(avg(adjusted), 6) AS adj_bias FROM adj GROUP BY 1)
SELECT i::INT AS grp, coalesce(n, 0) AS n, truth_mean, bias, adj_bias FROM range(5) t(i) LEFT JOIN g ON g.grp = i""",
    "q_regression_coefs": f"""WITH {JUDGED_SQL}, c AS (SELECT var_pop(l_discount) AS xx, var_pop(truth) AS zz, covar_pop(l_discount, truth) AS xz, covar_pop(l_discount, pred - truth) AS xy, covar_pop(truth, pred - truth) AS zy FROM judged)
SELECT 'l_discount' AS name, round((xy * zz - zy * xz) / (xx * zz - xz * xz), 6) AS coef FROM c""",
    "q_band_analysis": f"""WITH {JUDGED_SQL}, l AS (SELECT {BAND_SQL.format("truth")} AS band, l_suppkey AS c, truth AS z, pred - truth AS y, unnest(['l_discount', 'l_tax']) AS variable, unnest([l_discount, l_tax]) AS x FROM judged),
per AS (SELECT band, variable, c, count(*)::DOUBLE AS n, sum(x) AS x, sum(z) AS z, sum(y) AS y, sum(x * x) AS xx, sum(z * z) AS zz, sum(x * z) AS xz, sum(x * y) AS xy, sum(z * y) AS zy,
  row_number() OVER (PARTITION BY band, variable ORDER BY c) - 1 AS i, count(*) OVER (PARTITION BY band, variable) AS k FROM l GROUP BY 1, 2, 3),
d AS (SELECT band, variable, rep, floor(('0x' || substr(sha256('42:' || band || ':' || variable || ':' || rep || ':' || i), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * k)::BIGINT AS i FROM per, range(1, 201) t(rep)),
w AS (SELECT band, variable, rep, i, count(*) AS w FROM d GROUP BY ALL UNION ALL SELECT band, variable, 0, i, 1 FROM per),
b AS (SELECT band, variable, rep, {", ".join(f"sum(w * {v}) AS {v}" for v in ("n", "x", "z", "y", "xx", "zz", "xz", "xy", "zy"))} FROM w JOIN per USING (band, variable, i) GROUP BY ALL),
m AS (SELECT band, variable, rep, xx - x * x / n AS xx, zz - z * z / n AS zz, xz - x * z / n AS xz, xy - x * y / n AS xy, zy - z * y / n AS zy FROM b),
f AS (SELECT band, variable, rep, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS v FROM m),
g AS (SELECT band, variable, max(v) FILTER (rep = 0) AS slope, quantile_cont(v, 0.025) FILTER (rep > 0) AS low, quantile_cont(v, 0.975) FILTER (rep > 0) AS high FROM f GROUP BY ALL)
SELECT band, variable, count(*) AS n, round(avg(y), 6) AS bias, round(avg(x), 6) AS mean, round(corr(x, z), 6) AS corr, round(any_value(slope), 6) AS slope, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high
FROM l JOIN g USING (band, variable) GROUP BY 1, 2""",
    "q_log_fences": _FENCE.format("WITH g AS (SELECT event_type, date_diff('microsecond', ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap FROM events),", "event_type", "gap", "g", "k AS event_type,"),
    "q_log_fences_all": _FENCE.format("WITH", "1", "o_totalprice", "orders", ""),
    "q_weighted_median": """WITH v AS (SELECT p_retailprice AS v, sum(p_size) AS w FROM part WHERE p_size > 0 GROUP BY 1), r AS (SELECT v, sum(w) OVER (ORDER BY v) AS run, sum(w) OVER () AS t FROM v) SELECT min(v) AS weighted_median FROM r WHERE run >= 0.5 * t""",
    "q_constant_baseline": f"WITH {JUDGED_SQL}, m AS (SELECT median(truth) AS v FROM judged) SELECT any_value(v) AS value, round(avg(abs(truth - v)), 6) AS mae FROM judged, m",
    "q_grid_search": f"WITH {JUDGED_SQL} SELECT f::DOUBLE AS factor, round(avg(abs(pred * f::DOUBLE - truth)), 6) AS mae FROM judged, (VALUES (0.9), (0.95), (1.0), (1.05), (1.1)) t(f) GROUP BY 1",
    "q_mannwhitney_u": """WITH s AS (SELECT l_linestatus, l_returnflag = 'A' AS a, l_quantity AS v FROM lineitem WHERE l_returnflag IN ('A', 'R')),
r AS (SELECT *, rank() OVER (PARTITION BY l_linestatus ORDER BY v) + (count(*) OVER (PARTITION BY l_linestatus, v) - 1) / 2.0 AS rk FROM s),
g AS (SELECT l_linestatus, count(*) FILTER (a) AS n1, count(*) FILTER (NOT a) AS n2, sum(rk) FILTER (a) AS r1 FROM r GROUP BY 1),
t AS (SELECT l_linestatus, sum(c ** 3 - c) AS ties FROM (SELECT l_linestatus, v, count(*)::DOUBLE AS c FROM s GROUP BY 1, 2) GROUP BY 1),
z AS (SELECT l_linestatus, n1, n2, (r1 - n1 * (n1 + 1) / 2)::DOUBLE AS u, CASE WHEN n1 * n2 > 0 THEN (abs(r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) END AS z FROM g JOIN t USING (l_linestatus)),
q AS (SELECT *, greatest(z, 0) AS y, 1 / (1 + 0.2316419 * greatest(z, 0)) AS k FROM z)
SELECT l_linestatus, n1, n2, round(u, 6) AS u, round(z, 6) AS z, round(least(2 * exp(-y * y / 2) / sqrt(2 * pi()) * k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429)))), 1), 6) AS p FROM q""",
    "q_holm": """WITH r AS (SELECT p_partkey, p_brand, CASE WHEN p_size % 9 != 0 THEN p_size / 2000.0::DOUBLE END AS p FROM part),
s AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY p_brand) - row_number() OVER (PARTITION BY p_brand ORDER BY p, p_partkey) + 1) * p) AS st FROM r WHERE p IS NOT NULL),
a AS (SELECT p_partkey, max(st) OVER (PARTITION BY p_brand ORDER BY p, p_partkey ROWS UNBOUNDED PRECEDING) AS adjusted FROM s) SELECT p_partkey, round(p, 6) AS p, round(adjusted, 6) AS adjusted FROM r LEFT JOIN a USING (p_partkey)""",
    "q_batch_weights": """WITH r AS (SELECT l_orderkey, l_linenumber, least(1 + 2.0 * least(greatest(l_discount * 10, 0), 1), 2.5) AS raw FROM lineitem), w AS (SELECT l_linenumber, raw / avg(raw) OVER (PARTITION BY l_orderkey) AS weight FROM r)
SELECT l_linenumber, round(avg(weight), 6) AS mean, round(max(weight), 6) AS most, count(*) AS n FROM w GROUP BY 1""",
    "q_dimension_stats": """WITH c AS (SELECT unnest(range(64))::INT AS dim, unnest(embedding::DOUBLE[]) AS x FROM embeddings) SELECT dim, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max FROM c GROUP BY 1""",
    "q_application_rates": f"SELECT nm AS name, p::DOUBLE AS designed, round(avg(({_U} < p)::INT), 6) AS selected, count(*) AS trials FROM range(20000) t(id), (VALUES ('noise', 0.5), ('reverb', 0.3), ('volume', 0.1)) v(nm, p) GROUP BY 1, 2",
    "q_session_compare": f"""WITH {_MEAS}, c AS (SELECT latency_session_id, max(timestamp) AS newest FROM m WHERE experiment_id IN ('view', 'click') GROUP BY 1 HAVING count(DISTINCT experiment_id) = 2)
SELECT latency_session_id, experiment_id, timestamp, event_id, value FROM m WHERE experiment_id IN ('view', 'click') AND latency_session_id = (SELECT latency_session_id FROM c ORDER BY newest DESC, latency_session_id DESC LIMIT 1)""",
    "q_complete_sessions": f"""WITH {_MEAS} SELECT latency_session_id, max(timestamp) AS newest FROM m WHERE experiment_id IN ('view', 'click', 'purchase') GROUP BY 1 HAVING count(DISTINCT experiment_id) = 3""",
    "q_latency_summary": "SELECT event_type, round(median(value), 6) AS median_ms, round(max(value), 6) AS max_ms, round(avg(value), 6) AS mean_ms, count(*) AS n FROM events WHERE event_id % 10 != 0 GROUP BY 1",
    "q_rule_filter": f"WITH {_W} SELECT vec_id, known, round(peak, 6) AS peak, round(total, 6) AS total FROM w WHERE peak >= 0.2 AND total < 0.5",
    "q_cover_conditions": f"""WITH {_W}, u AS (SELECT known, metric, x FROM w UNPIVOT (x FOR metric IN (power, peak, total))),
g AS (SELECT metric, median(x) FILTER (known) AS mp, median(x) FILTER (NOT known) AS mn, min(x) FILTER (known) AS lo, max(x) FILTER (known) AS hi FROM u GROUP BY 1)
SELECT metric, CASE WHEN mp >= mn THEN '>=' ELSE '<=' END AS op, round(CASE WHEN mp >= mn THEN floor(lo / 0.01::DOUBLE + 1e-9) * 0.01::DOUBLE ELSE ceil(hi / 0.01::DOUBLE - 1e-9) * 0.01::DOUBLE END, 6) AS threshold FROM g""",
    "q_rule_search": f"""WITH {_W}, f AS (SELECT known, [power >= 0.015, peak >= 0.25, total <= 1, total >= -1] AS c FROM w),
i AS (SELECT [a] AS s FROM range(1, 5) t(a) UNION ALL SELECT [a, b] FROM range(1, 5) t(a), range(1, 5) u(b) WHERE a < b UNION ALL SELECT [a, b, d] FROM range(1, 5) t(a), range(1, 5) u(b), range(1, 5) v(d) WHERE a < b AND b < d),
h AS (SELECT s, known, len(list_filter(s, lambda j: NOT c[j])) = 0 AS hit FROM f, i)
SELECT array_to_string(list_transform(s, lambda j: ['power>=0.015', 'peak>=0.25', 'total<=1', 'total>=-1'][j]), '&') AS rule, (count(*) FILTER (hit AND NOT known))::BIGINT AS hits, (count(*) FILTER (hit AND known))::BIGINT AS covered FROM h GROUP BY s""",
}
