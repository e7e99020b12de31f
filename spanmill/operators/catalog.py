"""Item catalogues: ordered exclusion rules with counts, selection reasons, group summaries, validations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmill.functions import text as tx
from spanmill.functions.numeric import band, rate

# Reasons, in the order in which they are tested.
VOTES, EMPTY, UNCONVERTED, DIGITS, NO_DURATION, OUTLIER = "down_votes", "empty_sentence", "unconverted", "long_digit_run", "missing_duration", "outlier"
ALIGN_FAILED, COUNT_MISMATCH, HEAD, TAIL, NO_SPEECH = "align_failed", "mora_mismatch", "head_isolated", "tail_isolated", "no_speech"
SELECTION_ORDER = (ALIGN_FAILED, COUNT_MISMATCH, HEAD, TAIL, NO_SPEECH)


class Violation(ValueError):
    """A validation that found rows."""


def down_voted(up: Column, down: Column) -> Column:
    """At least as many votes against as for, or votes that are no whole numbers."""
    number = lambda c: F.trim(c.cast("string")).try_cast("int")
    return F.coalesce(number(down) >= number(up), F.lit(True))


def first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds; null if none does. A null test does not hold."""
    out = F.lit(None).cast("string")
    for name, test in reversed(rules):
        out = F.when(test, F.lit(name)).otherwise(out)
    return out


def all_reasons(rules: Sequence[tuple[str, Column]]) -> Column:
    """The names of all rules that hold, in their order; the first is the primary one."""
    return F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in rules)), lambda x: x.isNotNull())


def primary(reasons: Column) -> Column:
    return F.try_element_at(reasons, F.lit(1))


def sentence_info(sentences: DataFrame, kana: str = "kana", text: str = "sentence", training: bool = True) -> DataFrame:
    """Units, an exclusion reason and a flag of each distinct sentence with its reading: analysed once, not per item."""
    once = sentences.select(text, kana).distinct()
    other = tx.has_other(F.col(kana))
    reason = first_reason([(UNCONVERTED, other), (DIGITS, tx.digit_run(tx.nfkc(F.col(text))))]) if training else F.lit(None).cast("string")
    return once.withColumn("exclude_reason", reason).withColumn("units", tx.unit_count(F.col(kana))).withColumn("unconverted", other)


def with_reason(items: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    return items.withColumn("reason", first_reason(rules))


def reason_counts(items: DataFrame, rules: Sequence[tuple[str, Column]], kept: str = "kept") -> DataFrame:
    """Rows excluded by each reason, and rows kept: (reason, n)."""
    return with_reason(items, rules).groupBy(F.coalesce("reason", F.lit(kept)).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def clip_rules(low: float = 1.0, high: float = 12.0) -> list[tuple[str, Column]]:
    """The ordered rules of the catalogue over up_votes, down_votes, sentence, exclude_reason, duration, units."""
    rate = F.col("units") / F.col("duration")
    return [
        (VOTES, down_voted(F.col("up_votes"), F.col("down_votes"))),
        (EMPTY, F.coalesce(F.trim("sentence"), F.lit("")) == ""),
        (UNCONVERTED, F.col("exclude_reason") == UNCONVERTED),
        (DIGITS, F.col("exclude_reason") == DIGITS),
        (NO_DURATION, F.coalesce(F.col("duration") <= 0, F.lit(True))),
        (OUTLIER, (rate < low) | (rate > high)),
    ]


def build_catalog(transcripts: DataFrame, durations: DataFrame, readings: DataFrame, low: float = 1.0, high: float = 12.0, training: bool = True) -> DataFrame:
    """All transcript rows with their reason (null: kept), units, duration, rate and item id.

    readings: (sentence, kana). The duration join keeps rows without one, which is a reason of its own.
    """
    rows = transcripts.withColumn("sentence", F.trim(F.coalesce("sentence", F.lit(""))))
    info = sentence_info(readings, training=training)
    joined = rows.join(info, "sentence", "left").join(durations.select("path", "duration"), "path", "left")
    out = with_reason(joined, clip_rules(low, high))
    return out.withColumn("item_id", tx.stem(F.col("path"))).withColumn("rate", F.try_divide(F.col("units"), F.col("duration")))


def selection_rules(isolated: Column, no_speech: Column) -> list[tuple[str, Column]]:
    """Over ok, spans (array), units and isolation() flags."""
    ok = F.coalesce("ok", F.lit(False))
    return [
        (ALIGN_FAILED, ~ok),
        (COUNT_MISMATCH, ok & (F.size("spans") != F.col("units"))),
        (HEAD, ok & isolated["head"]),
        (TAIL, ok & isolated["tail"]),
        (NO_SPEECH, no_speech),
    ]


def selection_report(items: DataFrame, rate: str = "rate") -> DataFrame:
    """(status, reason, band, n): totals by primary reason and band. items has reasons (array) and pending (boolean)."""
    status = F.when(F.col("pending"), "pending").when(F.size("reasons") > 0, "excluded").otherwise("usable")
    marked = items.withColumn("status", status).withColumn("reason", F.when(F.col("status") == "excluded", primary(F.col("reasons"))))
    return marked.groupBy("status", "reason", band(F.col(rate)).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def overlapping_reasons(items: DataFrame) -> DataFrame:
    """Items under each reason, whatever their other reasons, and those under it alone."""
    alone = F.count_if(F.size("reasons") == 1).alias("alone")
    return items.select("reasons", F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), alone)


def reason_combinations(items: DataFrame) -> DataFrame:
    return items.where(F.size("reasons") > 0).groupBy(F.array_join("reasons", "+").alias("combination")).agg(F.count(F.lit(1)).alias("n"))


def reason_pivot(items: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Primary reason by band, with a column per band and a total."""
    rows = items.where(F.size("reasons") > 0).withColumn("reason", primary(F.col("reasons")))
    cells = [F.count_if(F.col("band") == b).alias(f"n_{b}") for b in bands]
    return rows.groupBy("reason").agg(*cells, F.count(F.lit(1)).alias("total"))


def group_summary(items: DataFrame, group: str, amount: str) -> DataFrame:
    return items.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("total")).orderBy(group)


def distribution(items: DataFrame, x: str, keys: Sequence[str] = ()) -> DataFrame:
    """n, min, max, mean, quartiles (linear interpolation) and sum of a column; NaN counts as null."""
    v = F.nanvl(F.col(x).cast("double"), F.lit(None).cast("double"))
    quart = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = items.groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.sum(v).alias("total"), quart.alias("__q"))
    return out.select(*keys, "n", "min", F.get("__q", F.lit(0)).alias("q1"), F.get("__q", F.lit(1)).alias("median"), F.get("__q", F.lit(2)).alias("q3"), "max", "mean", "total")


def histogram(items: DataFrame, x: str, low: float, high: float, width: float) -> DataFrame:
    """(bin, low, high, n) of all bins; values beyond the ends count in the first or last bin."""
    bins = round((high - low) / width)
    code = F.least(F.greatest(F.floor((F.col(x) - low) / width), F.lit(0)), F.lit(bins - 1)).cast("int")
    found = items.where(F.col(x).isNotNull()).groupBy(code.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = items.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    edges = [(F.lit(low) + F.col("bin") * width).alias("low"), (F.lit(low) + (F.col("bin") + 1) * width).alias("high")]
    return frame.join(found, "bin", "left").select("bin", *edges, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def select_items(items: DataFrame, groups: DataFrame, group: str, order: Sequence[str], low: float | None = None, high: float | None = None, amount: str = "duration", ids: DataFrame | None = None, id_col: str = "item_id", limit: int | None = None) -> DataFrame:
    """Items of the given groups within bounds, of an id list if given, the first `limit` in a total order."""
    out = items.join(groups.select(group), group, "left_semi")
    out = out.where(F.col(amount) >= low) if low is not None else out
    out = out.where(F.col(amount) <= high) if high is not None else out
    out = out.join(ids.select(id_col), id_col, "left_semi") if ids is not None else out
    return out.orderBy(*order).limit(limit) if limit is not None else out


def three_way(items: DataFrame, alignments: DataFrame, metrics: DataFrame, id_col: str = "item_id") -> DataFrame:
    """Items with both side tables; `pending` where either has no row."""
    a = alignments.withColumn("__a", F.lit(True))
    m = metrics.withColumn("__m", F.lit(True))
    out = items.join(a, id_col, "left").join(m, id_col, "left")
    return out.withColumn("pending", F.col("__a").isNull() | F.col("__m").isNull()).drop("__a", "__m")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df itself; raises Violation if a key repeats."""
    bad = df.groupBy(*keys).count().where("count > 1").limit(5).collect()
    if bad:
        raise Violation(f"repeated {list(keys)}: {[tuple(r)[:-1] for r in bad]}")
    return df


def assert_contained(ids: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """ids itself; raises Violation if one is missing in the table (anti-join)."""
    bad = ids.join(table.select(key), key, "left_anti").limit(5).collect()
    if bad:
        raise Violation(f"missing {key}: {[r[key] for r in bad]}")
    return ids


def assert_disjoint(one: DataFrame, two: DataFrame, key: str) -> None:
    bad = one.select(key).intersect(two.select(key)).limit(5).collect()
    if bad:
        raise Violation(f"in both: {[r[key] for r in bad]}")


def joined_exactly(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """An inner join that must keep every row of `left`, once."""
    out = left.join(assert_unique(right, [key]), key)
    assert_contained(left, right, key)
    return out


def same_rows(one: DataFrame, two: DataFrame) -> bool:
    """Whether two tables hold the same rows as often, in any order."""
    return one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def missing_both_ways(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """(side, key) of keys in only one of two tables."""
    a = one.select(key).exceptAll(two.select(key)).select(F.lit("only_left").alias("side"), key)
    return a.unionByName(two.select(key).exceptAll(one.select(key)).select(F.lit("only_right").alias("side"), key))


def without_items(windows: DataFrame, sources: DataFrame, excluded: DataFrame) -> DataFrame:
    """Windows of sources that hold none of the excluded items."""
    bad = sources.select("source_id", F.explode("item_ids").alias("item_id")).join(excluded.select("item_id"), "item_id", "left_semi")
    return windows.join(bad.select("source_id").distinct(), "source_id", "left_anti")


def log_counts(lines: DataFrame, kinds: dict[str, str], value: str = "value") -> DataFrame:
    """Lines of each kind: the first pattern that the line contains."""
    rules = [(k, F.col(value).contains(p)) for k, p in kinds.items()]
    return lines.groupBy(first_reason(rules).alias("kind")).agg(F.count(F.lit(1)).alias("n")).where("kind is not null")


def error_cases(predictions: DataFrame, items: DataFrame, id_col: str = "item_id") -> DataFrame:
    """Absolute errors in count and rate and the signed error, one row per prediction."""
    both = joined_exactly(predictions, items, id_col)
    rate_t, rate_p = F.col("units") / F.col("duration"), F.col("pred") / F.col("duration")
    return both.withColumn("rate_true", rate_t).withColumn("rate_pred", rate_p).withColumn("error", rate_p - rate_t).withColumn("abs_error", F.abs(rate_p - rate_t)).withColumn("abs_count_error", F.abs(F.col("pred") - F.col("units")))


def top_errors(cases: DataFrame, n: int, id_col: str = "item_id") -> DataFrame:
    """The n largest errors, ties by id, with their rank. Ranks are given to the n rows only."""
    top = cases.orderBy(F.desc("abs_error"), id_col).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("abs_error"), id_col)))


def label_quality(pairs: DataFrame, gold: str = "gold", estimate: str = "estimate") -> DataFrame:
    """Exact share, mean absolute difference and mean relative error of counts."""
    d = F.abs(F.col(estimate) - F.col(gold))
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.avg((d == 0).cast("double")).alias("exact"), F.avg(d).alias("mean_abs"), F.avg(F.try_divide(d, F.col(gold))).alias("mean_relative"))


def difference_buckets(pairs: DataFrame, gold: str = "gold", estimate: str = "estimate") -> DataFrame:
    d = F.abs(F.col(estimate) - F.col(gold))
    return pairs.groupBy(F.when(d <= 3, d.cast("int").cast("string")).otherwise("4+").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def eligible(count: Column, other: Column, reading: Column, low: int, high: int) -> Column:
    """Whether two counts of units agree, lie in [low, high], and the reading is all kana; a null is not eligible."""
    return F.coalesce(count.between(low, high) & (count == other) & ~tx.has_other(reading), F.lit(False))


def segments(records: DataFrame, root: str, path: str = "path", units: str = "units", seconds: str = "seconds") -> DataFrame:
    """Items to evaluate: the record's columns with the file below `root` and the true rate; a duration that is not positive is an error."""
    return records.withColumn("file", F.concat_ws("/", F.lit(root.rstrip("/")), F.col(path))).withColumn("truth", rate(F.col(units), F.col(seconds)))
