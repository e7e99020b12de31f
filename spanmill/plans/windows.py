"""Windows over event timelines and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.functions.numeric import rate_after_stretch
from spanmill.operators import metrics as me
from spanmill.operators import windows as wi
from spanmill.plans.inputs import BAND_SQL, BANDS_SQL, BIN_SQL, BINS_SQL, EVENTS_SQL, HOP, SIZE, event_sources, event_spans, labels_sql, r6, rounded, table

SHIFT = 3_600.0


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wi.window_sums(event_sources(spark, sf_dir), event_spans(spark, sf_dir), SIZE, HOP)


def window_band_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth: events in a window by fractional overlap. Prediction: events that start in it."""
    rows = _labels(spark, sf_dir).select(F.round("label", 9).alias("truth"), F.col("starts").cast("double").alias("pred"))
    return rounded(me.band_summary(rows))


def window_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).select("source_id", "window", r6("label").alias("label"), "starts")


def window_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.col("n_chars").alias("length"))
    out = wi.window_starts(docs, 1600, 200).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.max("window_start").cast("long").alias("last"))
    flat = wi.tumbling_starts(docs, 1600).groupBy("source_id").agg(F.count(F.lit(1)).alias("n_tumbling"))
    return out.join(flat, "source_id")


def window_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten bins at 1.5 and 2 times the speed: time shrinks, counts stay."""
    out = None
    for speed in (1.5, 2.0):
        sources = event_sources(spark, sf_dir).withColumn("length", F.col("length") * (1.0 / speed))
        rows = wi.window_sums(sources, wi.scaled(event_spans(spark, sf_dir), speed), SIZE, HOP)
        rows = rows.select(F.round("label", 9).alias("truth"), F.col("starts").cast("double").alias("pred"))
        one = rounded(me.bin_summary(rows)).withColumn("condition", F.lit(f"x{speed:g}"))
        out = one if out is None else out.unionByName(one)
    return out


def label_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How labels change when all spans move by an hour, held within their source."""
    sources, spans = event_sources(spark, sf_dir), event_spans(spark, sf_dir)
    moved = wi.shifted_spans(spans.join(sources, "source_id"), SHIFT).select("source_id", "start", "end")
    base = wi.window_sums(sources, spans, SIZE, HOP).withColumn("label", F.round("label", 9))
    after = wi.window_sums(sources, moved, SIZE, HOP).withColumn("label", F.round("label", 9))
    return rounded(me.label_change(base, after, ["source_id", "window"]))


def clamped_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = wi.shifted_spans(event_spans(spark, sf_dir).join(event_sources(spark, sf_dir), "source_id"), SHIFT)
    return moved.groupBy("source_id").agg(F.count_if("clamped").alias("clamped"), F.count(F.lit(1)).alias("n"))


def window_special(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of two classes and of values in one pass, and the share of a class, per window."""
    sums = {
        "label": F.lit(1.0),
        "views": (F.col("event_type") == "view").cast("double"),
        "clicks": (F.col("event_type") == "click").cast("double"),
        "amount": F.col("value"),
    }
    rows = wi.window_sums(event_sources(spark, sf_dir), event_spans(spark, sf_dir), SIZE, HOP, sums)
    share = F.when(F.round("label", 9) < 1, 0.0).otherwise(F.least(F.greatest(F.col("views") / F.col("label"), F.lit(0.0)), F.lit(1.0)))
    return rounded(rows.select("source_id", "window", "label", "views", "clicks", "amount", share.alias("share")))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source_id"), "turn", "role", F.length("text").cast("long").alias("length"))


def concat_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wi.offsets(_turns(spark, sf_dir), ["source_id"], ["turn"], "length", gap=100).select("source_id", "turn", "length", "offset")


def concat_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from arrays in one row: offsets, and the length of the whole."""
    rows = _turns(spark, sf_dir).groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("turn", "length"))).alias("t"))
    at = wi.array_offsets(F.col("t.length"), F.transform("t", lambda _: F.lit(100).cast("long")))
    placed = rows.select("source_id", F.element_at(at, -1).alias("last_offset"), (F.element_at(at, -1) + F.element_at("t.length", -1)).alias("length"), F.size("t").alias("items"))
    return placed


def short_part_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a conversation that touch a turn shorter than a window."""
    items = wi.offsets(_turns(spark, sf_dir), ["source_id"], ["turn"], "length", gap=100)
    sources = wi.concatenated_length(items, ["source_id"], "length")
    windows = wi.window_starts(sources, 400, 50)
    short = items.where("length < 400").select("source_id", F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("end"))
    return wi.windows_touching(windows, short, 400, 50).select("source_id", "window")


def flagged_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows whose conversation contains an item on a list (here a turn with a question mark)."""
    turns = table(spark, sf_dir, "conversations").withColumn("item_id", F.concat_ws("-", "conv_id", "turn"))
    sources = turns.groupBy(F.col("conv_id").alias("source_id")).agg(F.collect_list("item_id").alias("item_ids"), F.sum(F.length("text")).alias("length"))
    targets = turns.where(F.col("text").contains("?")).select("item_id")
    flagged = wi.windows_of_items(wi.window_starts(sources, 400, 50), sources, targets)
    return flagged.groupBy("source_id", "flagged").agg(F.count(F.lit(1)).alias("n"))


def stretch_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window at 100 of each document, stretched by at least as much as leaves room for it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("n"))
    low = wi.least_stretch(0.5, F.col("n"), 900)
    stretch = F.greatest(F.lit(0.75) + (F.col("doc_id") % 3) * F.lit(0.25), low)
    plan = wi.stretch_plan(F.col("n"), stretch, F.lit(100).cast("long"), 800, 50)
    return docs.select("doc_id", plan.alias("p"), r6(low).alias("least_stretch")).select("doc_id", "p.*", "least_stretch")


def excerpt_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of one stretched window per user, a third into the timeline of their events."""
    third = event_sources(spark, sf_dir).withColumn("stretch", F.lit(0.75) + (F.col("source_id") % 3) * F.lit(0.25))
    start = F.floor(F.col("length") * F.col("stretch") / 3).cast("long")
    plan = wi.stretch_plan(F.floor("length").cast("long"), F.col("stretch"), start, int(SIZE), int(HOP))
    plans = third.select("source_id", "stretch", plan.alias("p")).select("source_id", "stretch", "p.excerpt_start", "p.window_start")
    return rounded(wi.excerpt_labels(event_spans(spark, sf_dir), plans, int(SIZE)), "label").select("source_id", "window_start", "label")


def kept_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window's start in each line item's room after another draw of the stretch, and the rate after it."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("q"), (1 + F.col("l_discount")).alias("stretch"))
    old, new = F.col("l_partkey") % 97, F.bround((F.col("l_partkey") % 97) * F.col("stretch"), 0).cast("long")
    start = F.least(F.col("l_suppkey") % 97, old)
    return rows.select("l_orderkey", "l_linenumber", wi.kept_position(start, old, new).alias("start"), r6(rate_after_stretch(F.col("q"), F.col("stretch"))).alias("rate"))


def redrawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all attempts per order the first that passes, else the base draw."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("attempt"), F.col("l_quantity").alias("rate"))
    return wi.first_passing(rows, ["l_orderkey"], F.col("rate") >= 30).select("l_orderkey", "attempt", "rate")


def split_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling window sums of a conversation's letters against the whole."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text", F.col("n_chars").alias("length"))
    cut = wi.tumbling_starts(rows, 400).withColumn("part", F.expr("substring(text, cast(window_start as int) + 1, 400)"))
    windows = cut.select("source_id", F.length(F.regexp_replace("part", "[^a-z]", "")).cast("double").alias("pred"))
    whole = rows.select("source_id", F.length(F.regexp_replace("text", "[^a-z]", "")).cast("double").alias("pred"))
    return wi.split_consistency(windows, whole)


def concat_additivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns 1 and 2, 3 and 4, ...: a concave prediction of both together against the sum."""
    pairs = wi.neighbour_pairs(_turns(spark, sf_dir), ["source_id"], ["turn"], "length")
    p = lambda x: F.sqrt(x.cast("double"))
    both = pairs.select("source_id", "turn", p(F.col("length") + F.col("next")).alias("pair"), p(F.col("length")).alias("first"), p(F.col("next")).alias("second"), F.lit(0.0).alias("gap"), (F.col("length") + F.col("next")).cast("double").alias("total_sec"))
    return rounded(wi.concat_additivity(both))


def isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose first or last two events lie over a day apart."""
    spans = event_spans(spark, sf_dir).groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    return spans.select("source_id", wi.isolation(F.col("spans"), 86_400.0).alias("f")).select("source_id", "f.*")


QUERIES = {
    "q_window_band_metrics": window_band_metrics,
    "q_window_labels": window_labels,
    "q_window_starts": window_starts,
    "q_window_fast": window_fast,
    "q_label_shift": label_shift,
    "q_clamped_spans": clamped_spans,
    "q_window_special": window_special,
    "q_concat_offsets": concat_offsets,
    "q_concat_sources": concat_sources,
    "q_short_part_windows": short_part_windows,
    "q_flagged_windows": flagged_windows,
    "q_stretch_plans": stretch_plans,
    "q_excerpt_labels": excerpt_labels,
    "q_kept_positions": kept_positions,
    "q_redrawn": redrawn,
    "q_split_consistency": split_consistency,
    "q_concat_additivity": concat_additivity,
    "q_isolation": isolation,
}

_SCALED = lambda v: f"(SELECT source_id, event_id, event_type, s * (1.0 / {v}) AS s, e * (1.0 / {v}) AS e FROM spans)"
_SUMMARY = """round(avg(truth), 6) AS truth_mean, round(avg(pred), 6) AS pred_mean, round(quantile_cont(pred, 0.1), 6) AS pred_p10, round(quantile_cont(pred, 0.9), 6) AS pred_p90,
  round(avg(pred - truth), 6) AS bias, round(avg(abs(pred - truth)), 6) AS mae"""
_FAST = " UNION ALL ".join(
    f"""SELECT bin, 'x{v:g}' AS condition, coalesce(n, 0) AS n, truth_mean, pred_mean, pred_p10, pred_p90, bias, mae FROM {BINS_SQL} LEFT JOIN (
  SELECT {BIN_SQL.format("truth")} AS bin, count(*) AS n, {_SUMMARY} FROM (SELECT round(label, 9) AS truth, starts::DOUBLE AS pred FROM fast{i}) GROUP BY 1) USING (bin)"""
    for i, v in enumerate((1.5, 2.0))
)
_TURNS = 'turns AS (SELECT conv_id AS source_id, turn, length(text) AS length FROM conversations), placed AS (SELECT *, coalesce(sum(length + 100) OVER (PARTITION BY source_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM turns)'
_MOVED = f"moved AS (SELECT source_id, least(greatest(s + {SHIFT}, 0), length) AS s, least(greatest(e + {SHIFT}, 0), length) AS e, (s + {SHIFT} > length OR e + {SHIFT} > length) AS clamped FROM spans JOIN sources USING (source_id))"

ORACLES = {
    "q_window_band_metrics": f"""WITH {EVENTS_SQL}, {labels_sql("lab", "spans", "sources")}, t AS (SELECT round(label, 9) AS truth, starts::DOUBLE AS pred FROM lab)
SELECT band, coalesce(n, 0) AS n, mae, bias FROM {BANDS_SQL} LEFT JOIN (
  SELECT {BAND_SQL.format("truth")} AS band, count(*) AS n, round(avg(abs(pred - truth)), 6) AS mae, round(avg(pred - truth), 6) AS bias FROM t GROUP BY 1) USING (band)""",
    "q_window_labels": f"""WITH {EVENTS_SQL}, {labels_sql("lab", "spans", "sources")} SELECT source_id, w AS "window", round(label, 6) AS label, starts FROM lab""",
    "q_window_starts": """WITH d AS (SELECT doc_id AS source_id, n_chars AS length FROM documents WHERE n_chars >= 1600)
SELECT source_id, (length - 1600) // 200 + 1 AS n, (length - 1600) // 200 * 200 AS "last", length // 1600 AS n_tumbling FROM d""",
    "q_window_fast": f"""WITH {EVENTS_SQL}, f0 AS {_SCALED(1.5)}, f1 AS {_SCALED(2.0)},
s0 AS (SELECT source_id, length * (1.0 / 1.5) AS length FROM sources), s1 AS (SELECT source_id, length * (1.0 / 2.0) AS length FROM sources),
{labels_sql("fast0", "f0", "s0")}, {labels_sql("fast1", "f1", "s1")} {_FAST}""",
    "q_label_shift": f"""WITH {EVENTS_SQL}, {_MOVED}, {labels_sql("a", "spans", "sources")}, {labels_sql("b", "moved", "sources")},
j AS (SELECT round(a.label, 9) AS x, abs(round(b.label, 9) - round(a.label, 9)) AS c FROM a JOIN b USING (source_id, w))
SELECT {BAND_SQL.format("x")} AS band, count(*) AS n, round(avg(c), 6) AS mean_change, round(avg((c > 1e-6)::INT), 6) AS share_changed FROM j GROUP BY 1""",
    "q_clamped_spans": f"WITH {EVENTS_SQL}, {_MOVED} SELECT source_id, count(*) FILTER (clamped) AS clamped, count(*) AS n FROM moved GROUP BY 1",
    "q_window_special": f"""WITH {EVENTS_SQL}, {labels_sql("lab", "spans", "sources", ", coalesce(sum(f) FILTER (event_type = 'view'), 0.0) AS views, coalesce(sum(f) FILTER (event_type = 'click'), 0.0) AS clicks, coalesce(sum(f * value), 0.0) AS amount")}
SELECT source_id, w AS "window", round(label, 6) AS label, round(views, 6) AS views, round(clicks, 6) AS clicks, round(amount, 6) AS amount,
  round(CASE WHEN round(label, 9) < 1 THEN 0 ELSE least(greatest(views / label, 0), 1) END, 6) AS share FROM lab""",
    "q_concat_offsets": f'WITH {_TURNS} SELECT source_id, turn, length, "offset" FROM placed',
    "q_concat_sources": f'WITH {_TURNS} SELECT source_id, max("offset") AS last_offset, max("offset" + length) AS length, count(*)::INT AS items FROM placed GROUP BY 1',
    "q_short_part_windows": f"""WITH {_TURNS}, src AS (SELECT source_id, max("offset" + length) AS n FROM placed GROUP BY 1 HAVING max("offset" + length) >= 400),
win AS (SELECT source_id, unnest(range(0, (n - 400) // 50 + 1)) AS w FROM src)
SELECT DISTINCT source_id, w AS "window" FROM win JOIN placed USING (source_id) WHERE length < 400 AND w * 50 < "offset" + length AND "offset" < w * 50 + 400""",
    "q_flagged_windows": """WITH s AS (SELECT conv_id AS source_id, sum(length(text)) AS n, bool_or(contains(text, '?')) AS flagged FROM conversations GROUP BY 1)
SELECT source_id, flagged, ((n - 400) // 50 + 1)::BIGINT AS n FROM s WHERE n >= 400""",
    "q_stretch_plans": """WITH d AS (SELECT doc_id, n_chars AS n, greatest(0.75::DOUBLE + (doc_id % 3) * 0.25::DOUBLE, 0.5, 900.0::DOUBLE / n_chars) AS k FROM documents),
e AS (SELECT *, round_even(n * k, 0)::BIGINT AS stretched_length, greatest(floor(50 / k), 0)::BIGINT AS excerpt_start, least(ceil(950 / k), n)::BIGINT AS excerpt_end FROM d)
SELECT doc_id, stretched_length, excerpt_start, excerpt_end,
  greatest(least(100 - round_even(excerpt_start * k, 0)::BIGINT, round_even((excerpt_end - excerpt_start) * k, 0)::BIGINT - 800), 0) AS window_start, round(greatest(0.5, 900.0::DOUBLE / n), 6) AS least_stretch FROM e""",
    "q_excerpt_labels": f"""WITH {EVENTS_SQL}, k AS (SELECT source_id, floor(length)::BIGINT AS n, 0.75::DOUBLE + (source_id % 3) * 0.25::DOUBLE AS k, floor(length * (0.75::DOUBLE + (source_id % 3) * 0.25::DOUBLE) / 3)::BIGINT AS a FROM sources),
e AS (SELECT *, greatest(floor((a - {int(HOP)}) / k), 0)::BIGINT AS x, least(ceil((a + {int(SIZE) + int(HOP)}) / k), n)::BIGINT AS y FROM k),
w AS (SELECT *, greatest(least(a - round_even(x * k, 0)::BIGINT, round_even((y - x) * k, 0)::BIGINT - {int(SIZE)}), 0) AS w FROM e),
m AS (SELECT w.source_id, w, (s - x) * k AS s, (e - x) * k AS e FROM w LEFT JOIN spans USING (source_id))
SELECT source_id, w AS window_start, round(coalesce(sum(CASE WHEN e > s THEN least(greatest(least(e, w + {SIZE}) - greatest(s, w), 0) / (e - s), 1) WHEN s >= w AND s < w + {SIZE} THEN 1 ELSE 0 END), 0), 6) AS label FROM m GROUP BY 1, 2""",
    "q_kept_positions": """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey % 97 AS old, round_even((l_partkey % 97) * (1 + l_discount), 0)::BIGINT AS new, least(l_suppkey % 97, l_partkey % 97) AS was, l_quantity / (1 + l_discount) AS rate FROM lineitem)
SELECT l_orderkey, l_linenumber, (CASE WHEN old > 0 THEN round_even(was * new / greatest(old, 1), 0) ELSE 0 END)::BIGINT AS start, round(rate, 6) AS rate FROM r""",
    "q_redrawn": """WITH t AS (SELECT l_orderkey, l_linenumber - 1 AS attempt, l_quantity AS rate FROM lineitem)
SELECT l_orderkey, attempt, rate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY (rate >= 30)::INT DESC, attempt, rate) AS k FROM t WHERE rate >= 30 OR attempt = 0) WHERE k = 1""",
    "q_split_consistency": """WITH d AS (SELECT doc_id AS source_id, text, n_chars // 400 AS k FROM documents WHERE n_chars >= 400)
SELECT source_id, k AS windows, length(regexp_replace(left(text, (k * 400)::INT), '[^a-z]', '', 'g'))::DOUBLE AS total, length(regexp_replace(text, '[^a-z]', '', 'g'))::DOUBLE AS whole,
  (length(regexp_replace(left(text, (k * 400)::INT), '[^a-z]', '', 'g')) - length(regexp_replace(text, '[^a-z]', '', 'g')))::DOUBLE AS difference FROM d""",
    "q_concat_additivity": """WITH t AS (SELECT conv_id AS source_id, turn, length(text) AS a, lead(length(text)) OVER w AS b, row_number() OVER w AS k FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT source_id, turn, sqrt(a + b) AS pair, sqrt(a) AS first, sqrt(b) AS second, 0.0::DOUBLE AS gap, (a + b)::DOUBLE AS total_sec FROM t WHERE k % 2 = 1 AND b IS NOT NULL)
SELECT source_id, turn, round(pair, 6) AS pair, round(first, 6) AS first, round(second, 6) AS second, gap, total_sec, round(pair - first - second - gap, 6) AS difference, round(abs(pair - first - second - gap) / total_sec, 6) AS error_per_sec FROM p""",
    "q_isolation": f"""WITH {EVENTS_SQL}, l AS (SELECT source_id, list(s ORDER BY s, e) AS x FROM spans GROUP BY 1)
SELECT source_id, len(x) >= 2 AND coalesce(x[2] - x[1] > 86400, false) AS head, len(x) >= 2 AND coalesce(x[-1] - x[-2] > 86400, false) AS tail FROM l""",
}
