"""Robust fences, regressions from sufficient statistics, rank tests, adjustments, searches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanmill.operators.ordering import numbered
from spanmill.functions.numeric import hash_uniform

#: Scales the median absolute deviation to a standard deviation.
MAD_SCALE = 1.4826


def log_fences(rows: DataFrame, x: str, k: float = 3.0, keys: Sequence[str] = ()) -> DataFrame:
    """median +- k * 1.4826 * MAD of logarithms, as (lower, upper, middle, sigma); values that are not positive are left out."""
    logs = rows.where(F.col(x) > 0).select(*keys, F.ln(x).alias("__l"))
    mid = logs.groupBy(*keys).agg(F.median("__l").alias("__m"))
    joined = logs.join(mid, list(keys)) if keys else logs.withColumn("__m", F.lit(mid.first()["__m"]).cast("double"))
    out = joined.groupBy(*keys).agg(F.first("__m").alias("__m"), (MAD_SCALE * F.median(F.abs(F.col("__l") - F.col("__m")))).alias("sigma"))
    edge = lambda s: F.exp(F.col("__m") + s * k * F.col("sigma"))
    return out.select(*keys, edge(-1).alias("lower"), edge(1).alias("upper"), F.exp("__m").alias("middle"), "sigma")


def adjusted(rows: DataFrame, truth: str, bias: str, step: float = 0.5) -> DataFrame:
    """Adds `adjusted`: the bias less the mean bias of its fine bin of the truth. Bins are few, so means are joined."""
    code = F.floor(F.col(truth) / step).cast("long")
    means = rows.groupBy(code.alias("__bin")).agg(F.avg(bias).alias("__mean"))
    return rows.withColumn("__bin", code).join(means, "__bin").withColumn("adjusted", F.col(bias) - F.col("__mean")).drop("__bin", "__mean")


def slope(rows: DataFrame, y: str, x: str, z: str, keys: Sequence[str] = (), least: int = 10) -> DataFrame:
    """The coefficient of x in y ~ 1 + x + z from covariances; null below `least` rows or without variation."""
    cov = lambda a, b: F.covar_pop(a, b)
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        cov(x, x).alias("xx"),
        cov(z, z).alias("zz"),
        cov(x, z).alias("xz"),
        cov(x, y).alias("xy"),
        cov(z, y).alias("zy"),
    )
    det = F.col("xx") * F.col("zz") - F.col("xz") * F.col("xz")
    value = F.try_divide(F.col("xy") * F.col("zz") - F.col("zy") * F.col("xz"), F.when(det > 1e-12, det))
    return stats.select(*keys, "n", F.when(F.col("n") >= least, value).alias("slope"))


def joint_regression(rows: DataFrame, y: str, xs: Sequence[str], cluster: str, reps: int = 200, seed: int = 42, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, name, coef, low, high) of y ~ 1 + xs, with 95 % intervals from resampling clusters with replacement.

    Each cluster is reduced to X'X and X'y in Spark, and the k clusters of a key are numbered. A replicate is k draws,
    hashed from (seed, keys, replicate, number of the draw), each of which names a cluster; a cluster's weight is how
    often it is named. Draws are counted where they are made, the weighted sums are one partially aggregated shuffle of
    reps x p x p numbers a key, and only those small systems are solved in Python.
    """
    names = ["intercept", *xs]
    col = lambda n: F.lit(1.0) if n == "intercept" else F.col(n).cast("double")
    cells = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = [F.sum(col(names[i]) * col(names[j])).alias(f"a{i}_{j}") for i, j in cells] + [F.sum(col(n) * F.col(y)).alias(f"b{i}") for i, n in enumerate(names)]
    per = numbered(rows.groupBy(*keys, cluster).agg(*sums), [*keys, cluster], "__i")
    cols = [c for c in per.columns if c not in (*keys, cluster, "__i")]
    ranges = per.groupBy(*keys).agg(F.min("__i").alias("__first"), F.count(F.lit(1)).alias("__k"))
    alike = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    placed = per.select(*keys, "__i").alias("a").join(ranges.alias("b"), alike or F.lit(True)).select("a.*", "b.__first", "b.__k")
    draws = placed.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    u = hash_uniform(F.lit(str(seed)), *(F.col(c).cast("string") for c in (*keys, "rep")), (F.col("__i") - F.col("__first")).cast("string"))
    named = draws.groupBy("rep", (F.col("__first") + F.floor(u * F.col("__k"))).alias("__i")).agg(F.count(F.lit(1)).alias("__w"))
    whole = per.select("__i", F.lit(0).alias("rep"), F.lit(1).cast("long").alias("__w"))
    drawn = per.join(named.select("__i", "rep", "__w").unionByName(whole), "__i")
    boot = drawn.groupBy(*keys, "rep").agg(*(F.sum(F.col(c) * F.col("__w")).alias(c) for c in cols))
    p = len(names)
    fields = T.StructType([*(f for f in boot.schema.fields if f.name in (*keys, "rep")), T.StructField("name", T.StringType()), T.StructField("value", T.DoubleType())])

    def solve(batches):
        for pdf in batches:
            for _, r in pdf.iterrows():
                a, b = np.zeros((p, p)), np.array([r[f"b{i}"] for i in range(p)])
                for i, j in cells:
                    a[i, j] = a[j, i] = r[f"a{i}_{j}"]
                try:
                    coef = np.linalg.solve(a, b)
                except np.linalg.LinAlgError:
                    coef = np.full(p, np.nan)
                yield pd.DataFrame({**{k: [r[k]] * p for k in keys}, "rep": int(r["rep"]), "name": names, "value": coef})

    solved = boot.mapInPandas(solve, fields).where("not isnan(value)")
    ends = F.percentile(F.when(F.col("rep") > 0, F.col("value")), F.array(F.lit(0.025), F.lit(0.975)))
    out = solved.groupBy(*keys, "name").agg(F.max(F.when(F.col("rep") == 0, F.col("value"))).alias("coef"), ends.alias("__e"))
    return out.select(*keys, "name", "coef", F.get("__e", F.lit(0)).alias("low"), F.get("__e", F.lit(1)).alias("high"))


def band_analysis(rows: DataFrame, y: str, xs: Sequence[str], truth: str, cluster: str, band: str, reps: int = 200, seed: int = 42) -> DataFrame:
    """Per band and variable: n, the means of y and of the variable, its correlation with the truth, and its coefficient
    in y ~ 1 + variable + truth with the interval of joint_regression(). Rows without the variable do not count for it."""
    each = F.explode(F.array(*(F.struct(F.lit(x).alias("variable"), F.col(x).cast("double").alias("x")) for x in xs))).alias("v")
    long = rows.select(band, F.col(cluster), F.col(y), F.col(truth), each).select(band, cluster, y, truth, "v.*").where("x is not null")
    means = long.groupBy(band, "variable").agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("bias"), F.avg("x").alias("mean"), F.corr("x", truth).alias("corr"))
    found = joint_regression(long, y, ["x", truth], cluster, reps, seed, [band, "variable"]).where("name = 'x'")
    return means.join(found.select(band, "variable", F.col("coef").alias("slope"), "low", "high"), [band, "variable"], "left")


def group_table(rows: DataFrame, code: Column, groups: int, truth: str = "truth", bias: str = "bias", adj: str = "adjusted") -> DataFrame:
    """All groups 0 to groups - 1: n, mean truth, bias and adjusted bias; empty ones with n 0 and nulls."""
    found = rows.groupBy(code.cast("int").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.avg(truth).alias("truth_mean"), F.avg(bias).alias("bias"), F.avg(adj).alias("adj_bias"))
    frame = rows.sparkSession.range(groups).select(F.col("id").cast("int").alias("grp"))
    return frame.join(found, "grp", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def weighted_median(rows: DataFrame, value: str, weight: str) -> DataFrame:
    """The least value at which the running weight reaches half the total (one row; no row if no weight is positive).

    Rows are first summed per distinct value; the running sum is over those.
    """
    sums = rows.where(F.col(weight) > 0).groupBy(F.col(value).alias("v")).agg(F.sum(weight).alias("w"))
    total = sums.agg(F.sum("w")).first()[0]
    return numbered(sums, ["v"], "__i", F.col("w"), "run").where(F.col("run") >= F.lit(0.5 * (total or 0.0))).agg(F.min("v").alias("weighted_median")).where("weighted_median is not null")


def conversion_factor(rows: DataFrame, slope_col: Column, truth: str) -> float:
    """The factor k that minimises the mean of |k * slope - truth|: a weighted median of ratios. 1 if no slope is positive."""
    s = rows.withColumn("__s", slope_col).where("__s > 0").withColumn("__r", F.col(truth) / F.col("__s"))
    found = weighted_median(s, "__r", "__s").first()
    return float(found[0]) if found else 1.0


def constant_baseline(rows: DataFrame, truth: str) -> DataFrame:
    """The best constant prediction, the median, and its mean absolute error."""
    mid = rows.agg(F.median(truth)).first()[0]
    return rows.agg(F.lit(mid).cast("double").alias("value"), F.avg(F.abs(F.col(truth) - F.lit(mid))).alias("mae"))


def grid_search(rows: DataFrame, factors: Sequence[float], pred: str, truth: str) -> DataFrame:
    """(factor, mae) of all candidates, the best first, in one scan: a column per candidate, then unpivoted."""
    errors = rows.agg(*(F.avg(F.abs(F.col(pred) * f - F.col(truth))).alias(f"m{i}") for i, f in enumerate(factors)))
    pairs = F.array(*(F.struct(F.lit(float(f)).alias("factor"), F.col(f"m{i}").alias("mae")) for i, f in enumerate(factors)))
    return errors.select(F.explode(pairs).alias("p")).select("p.*").orderBy("mae", "factor")


def rank_sum(rows: DataFrame, group: str, first, second, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mann-Whitney U of `first` against `second` per key, with tie-corrected normal p-values.

    Ranks come from counts per distinct value, so ties cost one row: U, n1, n2, z (continuity-corrected), p.
    """
    side = rows.where(F.col(group).isin(first, second) & F.col(value).isNotNull())
    counts = side.groupBy(*keys, F.col(value).alias("v")).agg(F.count_if(F.col(group) == first).alias("a"), F.count_if(F.col(group) == second).alias("b"))
    t = F.col("a") + F.col("b")
    if keys:
        counts = counts.withColumn("__upto", F.sum(t).over(Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    else:
        counts = numbered(counts, ["v"], "__i", t, "__upto")
    ranked = counts.withColumn("__rank", F.col("__upto") - t + (t + 1) / 2)
    sums = ranked.groupBy(*keys).agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.sum(F.col("a") * F.col("__rank")).alias("r1"), F.sum(t * t * t - t).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("ties").cast("double"), n * (n - 1))))
    z = F.try_divide(F.abs(u - n1 * n2 / 2) - 0.5, F.when(spread > 0, spread))
    out = sums.select(*keys, "n1", "n2", u.alias("u"), z.alias("z"))
    return out.withColumn("p", two_sided(F.greatest(F.col("z"), F.lit(0.0))))


def two_sided(z: Column) -> Column:
    """2 (1 - Phi(z)) for z >= 0, by the rational approximation 26.2.17 of Abramowitz and Stegun (error < 7.5e-8)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.least(2 * F.exp(-z * z / 2) / F.sqrt(2 * F.pi()) * poly, F.lit(1.0))


def holm(rows: DataFrame, p: str, order: Sequence[str], family: Sequence[str] = ()) -> DataFrame:
    """Adds `adjusted`, Holm's step-down p-values of each family; null and NaN stay null and are not counted."""
    v = F.nanvl(F.col(p).cast("double"), F.lit(None).cast("double"))
    w = Window.partitionBy(*family, "__has").orderBy("__v", *order)
    out = rows.withColumn("__v", v).withColumn("__has", F.col("__v").isNotNull())
    m = F.count(F.lit(1)).over(Window.partitionBy(*family, "__has"))
    out = out.withColumn("__step", F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col("__v")))
    run = F.max("__step").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("adjusted", F.when(F.col("__has"), run)).drop("__v", "__has", "__step")


def batch_weights(rows: DataFrame, batch: str, ratio: str, alpha: float, cap: float) -> DataFrame:
    """Adds `weight`: min(1 + alpha * ratio, cap), scaled to mean 1 in each batch."""
    if alpha < 0 or cap < 1:
        raise ValueError("alpha must not be negative and cap not below 1")
    raw = F.least(1 + alpha * F.least(F.greatest(F.col(ratio), F.lit(0.0)), F.lit(1.0)), F.lit(float(cap)))
    return rows.withColumn("__raw", raw).withColumn("weight", F.col("__raw") / F.avg("__raw").over(Window.partitionBy(batch))).drop("__raw")


def dimension_stats(rows: DataFrame, array: str) -> DataFrame:
    """Per position of an array column: n, mean, population deviation, min, max (partial aggregates combine)."""
    cells = rows.select(F.posexplode(array).alias("dim", "x"))
    return cells.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))


def application_rates(trials: int, designed: dict[str, float], seed: int = 42, spark=None) -> DataFrame:
    """Simulated rates of keyed random choices against their design: (name, designed, selected, trials)."""
    options = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(p).alias("designed")) for n, p in designed.items()))
    draws = spark.range(trials).withColumn("o", F.explode(options)).select("id", "o.*")
    hit = hash_uniform(F.lit(str(seed)), F.col("name"), F.col("id").cast("string")) < F.col("designed")
    return draws.groupBy("name", "designed").agg(F.avg(hit.cast("double")).alias("selected"), F.count(F.lit(1)).alias("trials"))
