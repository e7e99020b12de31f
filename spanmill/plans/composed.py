"""Composed relations over the driver's tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.functions.arrays import fitted, power
from spanmill.operators import augmenting as au
from spanmill.operators import catalog as ca
from spanmill.operators import composed as co
from spanmill.operators import splitting as sp
from spanmill.operators import windows as wi
from spanmill.plans.inputs import BAND_SQL, EVENTS_SQL, HOP, JUDGED_SQL, SIZE, WAVES_SQL, event_sources, event_spans, judged, labels_sql, r6, rounded, table, timed_events, waves
from spanmill.streaming import pace

BLOCK, GAP = 1_296_000.0, 43_200.0
FAR = 129_600.0


def _blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A user's 15-day blocks as items, the events' spans cut to them; an item is ok unless its number is a multiple of 11."""
    spans = event_spans(spark, sf_dir)
    block = F.floor(F.col("start") / BLOCK).cast("int")
    cut = spans.withColumn("block", block).withColumn("item_id", F.concat_ws("-", "source_id", "block"))
    local = cut.select("item_id", "source_id", "block", (F.col("start") - F.col("block") * BLOCK).alias("start"), F.least(F.col("end") - F.col("block") * BLOCK, F.lit(BLOCK)).alias("end"))
    items = local.select("item_id", F.col("source_id").alias("grp"), ((F.col("source_id") * 7 + F.col("block")) % 11 != 0).alias("ok")).distinct().withColumn("length", F.lit(BLOCK))
    return items, local.select("item_id", "start", "end")


def _window_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, spans = _blocks(spark, sf_dir)
    good = co.eligibility(items, spans, FAR).where("excluded is null")
    grouping = sp.fixed_groups(good.select("grp", "item_id"), "grp", "item_id", 3).withColumn("gap", F.lit(GAP))
    return co.build_windows(items, spans, grouping, "grp", SIZE, HOP, FAR)


def build_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _window_set(spark, sf_dir).select("source_id", "kind", "window", r6("label").alias("label"), "starts")


def exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, spans = _blocks(spark, sf_dir)
    return co.eligibility(items, spans, FAR).groupBy(F.coalesce("excluded", F.lit("eligible")).alias("why")).agg(F.count(F.lit(1)).alias("n"))


def window_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.window_report(_window_set(spark, sf_dir)).withColumn("total", F.round("total", 3))


def training_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An epoch of 50 single and 50 joined sources: a sampling operator."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_id"), "n_chars")
    talks = table(spark, sf_dir, "conversations").groupBy(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("source_id")).agg(F.sum(F.length("text")).alias("n_chars"))
    return co.training_relation(docs, talks, 50).select("source_id", "kind", "n_chars")


def silence_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("duration")).distinct()
    return co.silence_relation(base, 0.1, {"digital": 1.0, "quiet": 2.0, "noise": 4.0}, "duration")


def augmentation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey")
    out = co.augmentation_plan(rows, "c_custkey", {"stretch": 0.7, "reverb": 0.3, "noise": 0.5, "volume": 0.4}, skip_noise_below=0.8)
    return out.select("c_custkey", r6("stretch").alias("stretch"), *(F.array_join(c, "+").alias(c) for c in ("selected", "skipped", "applied")))


def degraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = waves(spark, sf_dir)
    response = F.array(F.lit(1.0), F.lit(0.5), F.lit(0.25))
    noises = w.select(F.col("vec_id").alias("index"), F.col("x").alias("noise"))
    out = co.degraded(w.withColumn("response", response), noises, "vec_id", "x", "response", 10.0)
    quiet = co.quiet_noise(F.col("vec_id"), F.lit(32), F.lit(-40.0))
    return out.select("vec_id", r6(power(F.col("degraded"))).alias("power"), r6(10 * F.log10(power(quiet))).alias("quiet_db"))


def augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan applied to waveforms: power and size of what comes out."""
    w = waves(spark, sf_dir)
    rows = w.join(w.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("noise")), "vec_id").withColumn("response", F.array(F.lit(1.0), F.lit(0.5)))
    planned = co.augmentation_plan(rows, "vec_id", {"reverb": 0.3, "noise": 0.5, "band": 0.3, "volume": 0.4})
    out = co.augmented(planned, "vec_id", "x", "response", "noise", 64.0)
    return out.select("vec_id", F.array_join("applied", "+").alias("applied"), F.size("augmented").alias("samples"), r6(power(F.col("augmented"))).alias("power"))


CHAIN = {"stretch": au.Step(0.5, {"factor": (0.5, 2.0)}), "noise": au.Step(0.5, {"snr": (0.0, 20.0)}), "volume": au.Step(0.4, {"db": (-6.0, 6.0)})}
MASK = au.Step(0.6, {"masks": (1, 2), "width": (0, 2)})


def augmentation_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checked chain with stretches over waveforms tiled to 0.05 s: steps and lengths."""
    w = waves(spark, sf_dir).select("vec_id", fitted(F.col("x"), F.lit(800), F.lit(0)).alias("x"))
    out = au.run(w.withColumn("response", F.array(F.lit(1.0), F.lit(0.5))).withColumn("noise", F.reverse("x")), CHAIN, "vec_id", "x", "response", "noise", 16000.0)
    return out.select("vec_id", F.array_join("applied", "+").alias("applied"), F.size("augmented").alias("samples"), "seconds")


def feature_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waveforms as 16 frames of four bands, some of them masked."""
    frames = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("x", i * 4 + 1, F.lit(4)))
    out = au.feature_masked(waves(spark, sf_dir).select("vec_id", frames.alias("e")), "vec_id", "e", MASK)
    return out.select("vec_id", F.size("masks").alias("masks"), r6(F.aggregate(F.flatten("masked_features"), F.lit(0.0), lambda a, v: a + v)).alias("total"))


def stretch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = co.augmentation_plan(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", {"stretch": 1.1})
    return rounded(co.stretch_report(rows, "stretch", 0.5, 2.0, (0.6, 0.8, 1.0, 1.4, 1.9)))


def window_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wi.window_ranges(_window_set(spark, sf_dir).where("label > 0"))


def ring_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.sum("l_quantity").alias("sample")).withColumn("pos", (F.col("l_linenumber") - 1).cast("long"))
    out = pace.ring_read(rows, ["l_suppkey"], "pos", F.lit(5), 3, 4)
    return out.select("l_suppkey", F.aggregate("window", F.lit(0.0), lambda a, v: a + v).alias("total"))


def _level(batch):
    return [float(np.sqrt(np.mean(x**2)) * 40) for x in batch]


def evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch estimator over waveforms, and its metrics by label parity and pooled, as rows of the results table."""
    rows = waves(spark, sf_dir).withColumn("truth", F.col("label").cast("double")).withColumn("parity", F.when(F.col("label") % 2 == 0, "even").otherwise("odd"))
    scored = co.estimated(rows, _level, "x", "vec_id")
    out = co.evaluation_rows(scored, "dev", {"experiment_id": "level", "method": "rms"}, "parity")
    return rounded(out.select("experiment_id", "method", "split", "n", "mae", "mae_under4", "n_over8", "r"))


def epoch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("status") == "F", co.SINGLE).otherwise(co.CONCAT)
    rows = judged(spark, sf_dir).withColumn("kind", kind).withColumn("label", F.floor("truth")).withColumn("stretch", 1 + F.col("l_tax"))
    return rounded(co.epoch_stats(rows, "condition", "kind", "stretch", "label", (4.0, 8.0)))


def emission_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = waves(spark, sf_dir).select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("x", i * 4 + 1, F.lit(4))).alias("e"), F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(1)).alias("ref"))
    out = co.emission_metrics(rows, "e", "ref", 0)
    return rounded(out.select("vec_id", F.array_join("hyp", ",").alias("hyp"), "nonblank", "cer"))


def emission_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same frames as scores of three tokens, one of them twice in a row: likelihood a token."""
    rows = waves(spark, sf_dir).select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("x", i * 4 + 1, F.lit(4))).alias("e"), F.array(F.lit(1), F.lit(1), F.lit(3)).alias("ref"))
    return rounded(co.emission_metrics(rows, "e", "ref", 0, likelihood=True).select("vec_id", "token_nll"))


def rule_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = [("l_discount", ">=", 0.05), ("l_tax", "<", 0.04)]
    rows = judged(spark, sf_dir).withColumn("known", F.col("condition") == "R")
    return co.rule_report(rows, rule, "known", "truth")


def span_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(co.span_inspection(event_spans(spark, sf_dir), event_sources(spark, sf_dir)))


def log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("value"))
    return ca.log_counts(lines, {"secret": "token = ", "license": "License", "loud": "!!", "table": " | "})


def stream_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event counts a user and type, and the share of each type: what a dashboard holds."""
    n = timed_events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_id").alias("users"))
    total = n.agg(F.sum("n")).first()[0]
    return rounded(n.withColumn("share", F.col("n") / F.lit(total)))


QUERIES = {
    "q_build_windows": build_windows,
    "q_exclusions": exclusions,
    "q_window_report": window_report,
    "q_training_relation": training_relation,
    "q_silence_relation": silence_relation,
    "q_augmentation_plan": augmentation_plan,
    "q_degraded": degraded,
    "q_augmented": augmented,
    "q_augmentation_chain": augmentation_chain,
    "q_feature_masks": feature_masks,
    "q_stretch_report": stretch_report,
    "q_window_ranges": window_ranges,
    "q_ring_read": ring_read,
    "q_evaluate": evaluate,
    "q_epoch_stats": epoch_stats,
    "q_emission_metrics": emission_metrics,
    "q_emission_likelihood": emission_likelihood,
    "q_rule_report": rule_report,
    "q_span_inspection": span_inspection,
    "q_log_counts": log_counts,
    "q_event_shares": stream_log,
}

_SET = f"""{EVENTS_SQL},
cut AS (SELECT source_id AS grp, floor(s / {BLOCK})::INT AS block, s, e FROM spans),
loc AS (SELECT grp, block, grp || '-' || block AS item_id, s - block * {BLOCK} AS s, least(e - block * {BLOCK}, {BLOCK}) AS e FROM cut),
ends AS (SELECT item_id, any_value(grp) AS grp, any_value((grp * 7 + block) % 11 != 0) AS ok, list(s ORDER BY s, e) AS x FROM loc GROUP BY 1),
flag AS (SELECT item_id, grp, ok, len(x) >= 2 AND coalesce(x[2] - x[1] > {FAR}, false) AS h, len(x) >= 2 AND coalesce(x[-1] - x[-2] > {FAR}, false) AS t FROM ends),
why AS (SELECT *, CASE WHEN NOT ok THEN 'failed' WHEN h AND t THEN 'both' WHEN h THEN 'head' WHEN t THEN 'tail' END AS excluded FROM flag),
rk AS (SELECT item_id, grp, row_number() OVER (PARTITION BY grp ORDER BY sha256('42:' || item_id), item_id) - 1 AS k, count(*) OVER (PARTITION BY grp) AS n FROM why WHERE excluded IS NULL),
src AS (SELECT item_id, item_id AS source_id, 0.0::DOUBLE AS off FROM rk UNION ALL SELECT item_id, 'concat-' || grp || '-' || k // 3, (k % 3) * {BLOCK + GAP}::DOUBLE FROM rk WHERE k < n // 3 * 3),
allspans AS (SELECT source_id, s + off AS s, e + off AS e FROM loc JOIN src USING (item_id)),
allsources AS (SELECT source_id, max(off) + {BLOCK} AS length FROM src GROUP BY 1),
{labels_sql("lab", "allspans", "allsources")},
ws AS (SELECT source_id, CASE WHEN starts_with(source_id, 'concat-') THEN 'concat' ELSE 'single' END AS kind, w, label, starts FROM lab)"""
_VU = lambda n, more="''": f"(('0x' || substr(sha256('42.0:{n}:' || vec_id || {more}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"
_HU = lambda n: f"(('0x' || substr(sha256('42.0:{n}:' || c_custkey), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"
_BEST = "list_transform(range(16), lambda i: list_position(x[4 * i + 1 : 4 * i + 4], list_max(x[4 * i + 1 : 4 * i + 4])) - 1)"

ORACLES = {
    "q_build_windows": f'WITH {_SET} SELECT source_id, kind, w AS "window", round(label, 6) AS label, starts FROM ws',
    "q_exclusions": f"WITH {_SET} SELECT coalesce(excluded, 'eligible') AS why, count(*) AS n FROM why GROUP BY 1",
    "q_window_report": f"""WITH {_SET}, b AS (SELECT kind, {BAND_SQL.format("round(label, 9)")} AS band, label FROM ws)
SELECT CASE WHEN grouping(kind) = 1 THEN 'all' ELSE kind END AS kind, CASE WHEN grouping(band) = 1 THEN 'all' ELSE band END AS band, count(*) AS n, round(sum(label), 3) AS total FROM b GROUP BY CUBE (kind, band)""",
    "q_training_relation": """SELECT * FROM (SELECT 'd' || doc_id AS source_id, 'single' AS kind, n_chars FROM documents ORDER BY sha256('42:d' || doc_id), 1 LIMIT 50)
UNION ALL SELECT * FROM (SELECT 'c' || conv_id AS source_id, 'concat' AS kind, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY conv_id ORDER BY sha256('42:c' || conv_id), 1 LIMIT 50)""",
    "q_silence_relation": """WITH v AS (SELECT duration, row_number() OVER (ORDER BY duration) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT c_acctbal AS duration FROM customer)),
t AS (SELECT floor(0.1::DOUBLE * max(n) + 0.5)::BIGINT AS total FROM v), m AS (SELECT * FROM (VALUES ('digital', 1), ('quiet', 2), ('noise', 4)) x(kind, w)),
e AS (SELECT kind, total * w / 7::DOUBLE AS x, total FROM m, t), a AS (SELECT kind, (floor(x) + (row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, kind) <= total - sum(floor(x)) OVER ())::INT)::BIGINT AS c FROM e),
i AS (SELECT 'silence-' || kind || '-' || k AS item_id, kind FROM (SELECT kind, unnest(range(c)) AS k FROM a)),
u AS (SELECT *, ('0x' || substr(sha256('42:' || item_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM i)
SELECT item_id, kind, duration, 0 AS units FROM u JOIN v ON v.k = floor(u * v.n)::BIGINT + 1""",
    "q_augmentation_chain": f"""WITH {WAVES_SQL}, d AS (SELECT vec_id, CASE WHEN {_VU("stretch")} < 0.5 THEN exp(ln(0.5) + {_VU("factor")} * ln(4.0)) ELSE 1 END AS f,
  array_to_string(list_filter([CASE WHEN {_VU("stretch")} < 0.5 THEN 'stretch' END, CASE WHEN {_VU("noise")} < 0.5 THEN 'noise' END, CASE WHEN {_VU("volume")} < 0.4 THEN 'volume' END], lambda v: v IS NOT NULL), '+') AS applied FROM waves)
SELECT vec_id, applied, round_even(800 * f, 0)::INT AS samples, round_even(800 * f, 0) / 16000 AS seconds FROM d""",
    "q_feature_masks": f"""WITH {WAVES_SQL}, i AS (SELECT vec_id, x, CASE WHEN {_VU("mask")} < 0.6 THEN 1 + floor({_VU("masks", "':0'")} * 2) ELSE 0 END AS n FROM waves),
m AS (SELECT vec_id, n, k, floor({_VU("width", "':' || k")} * 3)::INT AS width, {_VU("first", "':' || k")} AS u FROM i, (VALUES (1), (2)) t(k) WHERE k <= n),
p AS (SELECT vec_id, floor(u * (5 - width))::INT AS first, width FROM m WHERE width > 0),
h AS (SELECT vec_id, b, bool_or(first IS NOT NULL) AS held FROM waves CROSS JOIN range(4) t(b) LEFT JOIN p USING (vec_id) WHERE first IS NULL OR (b >= first AND b < first + width) GROUP BY 1, 2),
g AS (SELECT vec_id, list(b) FILTER (held) AS b FROM h GROUP BY 1), c AS (SELECT vec_id, count(*)::INT AS masks FROM p GROUP BY 1)
SELECT vec_id, coalesce(masks, 0) AS masks, round(list_sum(list_transform(range(64), lambda t: CASE WHEN list_contains(coalesce(b, []), t % 4) THEN 0 ELSE x[t + 1] END)), 6) AS total FROM waves LEFT JOIN g USING (vec_id) LEFT JOIN c USING (vec_id)""",
    "q_augmentation_plan": f"""WITH c AS (SELECT c_custkey, CASE WHEN {_HU("stretch")} < 0.7 THEN exp(ln(0.5) + {_HU("factor")} * ln(4.0)) ELSE 1 END AS f,
  list_filter([{", ".join(f"CASE WHEN {_HU(n)} < {p} THEN '{n}' END" for n, p in (("stretch", 0.7), ("reverb", 0.3), ("noise", 0.5), ("volume", 0.4)))}], lambda x: x IS NOT NULL) AS s FROM customer)
SELECT c_custkey, round(f, 6) AS stretch, array_to_string(s, '+') AS selected, CASE WHEN f < 0.8 AND list_contains(s, 'noise') THEN 'noise' ELSE '' END AS skipped,
  array_to_string(list_filter(s, lambda x: NOT (x = 'noise' AND f < 0.8)), '+') AS applied FROM c""",
    "q_stretch_report": f"""WITH c AS (SELECT exp(ln(0.5) + {_HU("factor")} * ln(4.0)) AS f FROM customer)
SELECT e::DOUBLE AS edge, round(avg((f < e::DOUBLE)::INT), 6) AS drawn, count(*) AS n, round(ln(e::DOUBLE / 0.5) / ln(4.0), 6) AS nominal FROM c, (VALUES (0.6), (0.8), (1.0), (1.4), (1.9)) t(e) GROUP BY e""",
    "q_window_ranges": f'WITH {_SET} SELECT source_id, min(w) AS first, max(w) AS "last", count(*) AS n, max(w) - min(w) + 1 = count(*) AS gapless FROM ws WHERE label > 0 GROUP BY 1',
    "q_ring_read": """WITH s AS (SELECT l_suppkey, l_linenumber - 1 AS p, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), m AS (SELECT *, max(p) OVER (PARTITION BY l_suppkey) AS l FROM s)
SELECT l_suppkey, CASE WHEN count(*) FILTER (p BETWEEN 2 AND 4 AND p > l - 4) = 3 THEN sum(v) FILTER (p BETWEEN 2 AND 4) END AS total FROM m GROUP BY 1""",
    "q_evaluate": f"""WITH {WAVES_SQL}, s AS (SELECT label::DOUBLE AS truth, sqrt(list_sum(list_transform(x, lambda v: v * v)) / 64) * 40 AS pred, CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END AS parity FROM waves),
g AS (SELECT *, parity AS scope FROM s UNION ALL SELECT *, 'pooled' FROM s)
SELECT 'level' AS experiment_id, 'rms' AS method, 'dev_' || scope AS split, count(*) AS n, round(avg(abs(pred - truth)), 6) AS mae, round(avg(abs(pred - truth)) FILTER (truth < 4), 6) AS mae_under4, count(*) FILTER (truth >= 8) AS n_over8,
  round(covar_pop(truth, pred) / sqrt(var_pop(truth) * var_pop(pred)), 6) AS r FROM g GROUP BY scope""",
    "q_epoch_stats": f"""WITH {JUDGED_SQL}, e AS (SELECT condition, status, 1 + l_tax AS k, floor(truth) AS label FROM judged)
SELECT condition, count(*) AS n, count(*) FILTER (status = 'F') AS n_single, count(*) FILTER (status != 'F') AS n_concat, round(min(k), 6) AS stretch_min, round(avg(k), 6) AS stretch_mean, round(max(k), 6) AS stretch_max,
  round(avg(label), 6) AS label_mean, round(avg((label = 0)::INT), 6) AS zero_share, round(avg((label >= 4)::INT), 6) AS ge_4, round(avg((label >= 8)::INT), 6) AS ge_8 FROM e GROUP BY 1""",
    "q_emission_metrics": f"""WITH {WAVES_SQL}, b AS (SELECT vec_id, {_BEST} AS b FROM waves), h AS (SELECT vec_id, b, list_filter(list_transform(range(1, 17), lambda i: CASE WHEN i > 1 AND b[i] = b[i - 1] THEN 0 ELSE b[i] END), lambda v: v != 0) AS h FROM b)
SELECT vec_id, array_to_string(h, ',') AS hyp, round(len(list_filter(b, lambda v: v != 0)) / 16, 6) AS nonblank, round(levenshtein('BCDB', array_to_string(list_transform(h, lambda v: chr((v + 65)::INT)), '')) / 4, 6) AS cer FROM h""",
    # The forward recursion over the states blank, 1, blank, 1, blank, 3, blank; only the last token may skip its blank.
    "q_emission_likelihood": f"""WITH RECURSIVE {WAVES_SQL}, s AS (SELECT vec_id, x, [0, 1, 0, 1, 0, 3, 0] AS s FROM waves),
r AS (SELECT vec_id, x, s, 1 AS t, list_transform(range(1, 8), lambda j: CASE WHEN j <= 2 THEN exp(x[s[j] + 1]) ELSE 0.0::DOUBLE END) AS p FROM s UNION ALL
  SELECT vec_id, x, s, t + 1, list_transform(range(1, 8), lambda j: (p[j] + CASE WHEN j > 1 THEN p[j - 1] ELSE 0 END + CASE WHEN j = 6 THEN p[4] ELSE 0 END) * exp(x[4 * t + s[j] + 1])) FROM r WHERE t < 16)
SELECT vec_id, round(-ln(p[6] + p[7]) / 3, 6) AS token_nll FROM r WHERE t = 16""",
    "q_rule_report": f"""WITH {JUDGED_SQL}, f AS (SELECT {BAND_SQL.format("truth")} AS band, l_discount >= 0.05 AND l_tax < 0.04 AS h, condition = 'R' AS k FROM judged)
SELECT band, count(*) AS n, count(*) FILTER (h) AS flagged, count(*) FILTER (k) AS known, count(*) FILTER (h AND NOT k) AS new, count(*) FILTER (k AND NOT h) AS missed FROM f GROUP BY 1""",
    "q_span_inspection": f"""WITH {EVENTS_SQL}, g AS (SELECT *, lead(s) OVER (PARTITION BY source_id ORDER BY s, e) - s AS gap FROM spans)
SELECT source_id, count(*) AS n, round(avg(e - s), 6) AS mean_length, round(max(gap), 6) AS longest_gap, round(min(s), 6) AS lead, round(any_value(length), 6) AS length, round(any_value(length) - max(e), 6) AS trail FROM g JOIN sources USING (source_id) GROUP BY 1""",
    "q_log_counts": r"""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS v FROM documents), k AS (SELECT CASE WHEN contains(v, 'token = ') THEN 'secret' WHEN contains(v, 'License') THEN 'license' WHEN contains(v, '!!') THEN 'loud' WHEN contains(v, ' | ') THEN 'table' END AS kind FROM l)
SELECT kind, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY 1""",
    "q_event_shares": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1",
}
