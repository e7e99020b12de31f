"""Error, bias and correlation of predictions by band, bin, condition and scope; empty groups stay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.functions.numeric import BAND_KEYS, BIN_KEYS, band, bin_code, bin_key


def guarded_corr(x: str | Column, y: str | Column) -> Column:
    """Pearson's r; null below two rows or where a side does not vary (the built-in one divides by zero there).
    Centred sums come from the built-in moments, which combine partial aggregates without cancellation."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    spread = F.sqrt(F.var_pop(a) * F.var_pop(b))
    return F.when(F.count(F.when(both, 1)) >= 2, F.try_divide(F.covar_pop(a, b), F.when(spread > 0, spread)))


def error_aggregates(truth: str = "truth", pred: str = "pred") -> list[Column]:
    d = F.col(pred) - F.col(truth)
    return [
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(d)).alias("mae"),
        F.avg(d).alias("bias"),
        guarded_corr(truth, pred).alias("r"),
        F.avg(truth).alias("truth_mean"),
        F.avg(pred).alias("pred_mean"),
    ]


def with_all(rows: DataFrame, keys: Sequence[str], name: str, values: Sequence) -> DataFrame:
    """Every key with every value of a small dimension of literals, by which empty groups survive. No join."""
    base = rows.select(*keys).distinct() if keys else rows.sparkSession.range(1).select()
    return base.withColumn(name, F.explode(F.array(*map(F.lit, values))))


def segment_metrics(rows: DataFrame, keys: Sequence[str] = (), truth: str = "truth", pred: str = "pred") -> DataFrame:
    """One row per key: n, mae, mae and n by band of the truth, r. One pass, no join: bands are conditional sums."""
    e, b = F.abs(F.col(pred) - F.col(truth)), band(F.col(truth))
    out = [F.count(F.lit(1)).alias("n"), F.avg(e).alias("mae")]
    for k in BAND_KEYS:
        out += [F.avg(F.when(b == k, e)).alias(f"mae_{k}"), F.count_if(b == k).alias(f"n_{k}")]
    return rows.groupBy(*keys).agg(*out, guarded_corr(truth, pred).alias("r"))


def band_summary(rows: DataFrame, keys: Sequence[str] = (), truth: str = "truth", pred: str = "pred") -> DataFrame:
    """keys x all bands: n, mae, bias. A band without rows has n 0 and nulls."""
    d = F.col(pred) - F.col(truth)
    found = rows.groupBy(*keys, band(F.col(truth)).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(d)).alias("mae"), F.avg(d).alias("bias"))
    return with_all(rows, keys, "band", BAND_KEYS).join(found, [*keys, "band"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def bin_summary(rows: DataFrame, keys: Sequence[str] = (), truth: str = "truth", pred: str = "pred") -> DataFrame:
    """keys x all ten bins: n, means, 10 % and 90 % quantiles of the prediction, bias, mae."""
    d = F.col(pred) - F.col(truth)
    found = rows.groupBy(*keys, bin_code(F.col(truth)).cast("int").alias("code")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(truth).alias("truth_mean"),
        F.avg(pred).alias("pred_mean"),
        F.percentile(pred, F.lit(0.1)).alias("pred_p10"),
        F.percentile(pred, F.lit(0.9)).alias("pred_p90"),
        F.avg(d).alias("bias"),
        F.avg(F.abs(d)).alias("mae"),
    )
    frame = with_all(rows, keys, "code", range(len(BIN_KEYS))).withColumn("bin", F.get(F.array(*map(F.lit, BIN_KEYS)), "code"))
    return frame.join(found, [*keys, "code"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).drop("code")


def reported_bins(rows: DataFrame, prefix: str, reported: Sequence[str] = BIN_KEYS, overall: bool = True, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Segment metrics of the non-empty reported bins and, if asked for, of all rows: grouping sets in one scan."""
    split = F.when(F.grouping_id() == 1, F.lit(prefix)).otherwise(F.concat(F.lit(f"{prefix}_bin_"), F.col("__bin")))
    e = F.abs(F.col(pred) - F.col(truth))
    sets = [[F.col("__bin")], []] if overall else [[F.col("__bin")]]
    out = (
        rows.withColumn("__bin", bin_key(F.col(truth)))
        .groupingSets(sets, "__bin")
        .agg(split.alias("split"), F.grouping_id().alias("__all"), F.count(F.lit(1)).alias("n"), F.avg(e).alias("mae"), guarded_corr(truth, pred).alias("r"))
    )
    return out.where((F.col("__all") == 1) | F.col("__bin").isin(*reported)).select("split", "n", "mae", "r")


def pooled(rows: DataFrame, condition: str, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Metrics of each condition and of all pooled: a rollup, not an average of averages."""
    name = F.when(F.grouping(condition) == 1, F.lit("pooled")).otherwise(F.col(condition))
    return rows.rollup(condition).agg(name.alias("scope"), *error_aggregates(truth, pred)).drop(condition)


def zero_summary(rows: DataFrame, keys: Sequence[str] = (), pred: str = "pred", size: float = 2.0, thresholds: Sequence[float] = (0.5, 1.0, 2.0)) -> DataFrame:
    """Predictions on rows whose truth is 0: mean, five quantiles, maximum, shares from each threshold on."""
    p = F.col(pred)
    marks = (0.05, 0.25, 0.5, 0.75, 0.95)
    got = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(p).alias("mean"),
        (F.avg(p) / size).alias("mean_rate"),
        F.percentile(p, F.array(*map(F.lit, marks))).alias("__q"),
        F.max(p).alias("max"),
        *(F.avg((p >= t).cast("double")).alias(f"ge_{t:g}".replace(".", "p")) for t in thresholds),
    )
    for i, q in enumerate(marks):
        got = got.withColumn(f"q{int(q * 100):02d}", F.get("__q", F.lit(i)))
    return got.drop("__q")


def scoped_summary(rows: DataFrame, conditions: str, scopes: dict[str, Column], truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Conditions x scopes; a row counts in every scope whose predicate holds: one explode instead of a pass per scope."""
    held = F.filter(F.array(*(F.when(F.coalesce(p, F.lit(False)), F.lit(n)) for n, p in scopes.items())), lambda x: x.isNotNull())
    return rows.withColumn("scope", F.explode(held)).groupBy(conditions, "scope").agg(*error_aggregates(truth, pred))


def label_change(base: DataFrame, moved: DataFrame, on: Sequence[str], label: str = "label", band_by: Column | None = None) -> DataFrame:
    """How far labels move under a shift, by band of the base label: rows, mean absolute change, share changed."""
    both = base.select(*on, F.col(label).alias("__a")).join(moved.select(*on, F.col(label).alias("__b")), list(on))
    change = F.abs(F.col("__b") - F.col("__a"))
    key = band(F.col("__a")) if band_by is None else band_by
    return both.groupBy(key.alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(change).alias("mean_change"), F.avg((change > 1e-6).cast("double")).alias("share_changed")
    )


def loss_aggregates(truth: str = "truth", pred: str = "pred", weight: str | None = None) -> list[Column]:
    """Mean squared error, Poisson loss and, with weights, the weighted squared error."""
    t, p = F.col(truth), F.col(pred)
    out = [F.avg((p - t) * (p - t)).alias("mse"), F.avg(p - t * F.ln(p + 1e-8)).alias("poisson")]
    return out + ([F.avg(F.col(weight) * (p - t) * (p - t)).alias("weighted_mse")] if weight else [])
