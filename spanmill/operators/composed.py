"""End-to-end relations made of the other operators: window sets, training sets, evaluations, augmentation plans."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanmill.functions.arrays import gained, mixed_at
from spanmill.functions.numeric import band, drawn_between, hash_uniform, stretch_cdf
from spanmill.functions.signal import band_pass_udf, ctc_loss_udf, reverberated_udf
from spanmill.functions.text import collapsed
from spanmill.functions.waveforms import stretched_udf
from spanmill.operators import metrics, registry, splitting, windows
from spanmill.operators.rules import Bound, meets_all

SINGLE, CONCAT = "single", "concat"


def eligibility(items: DataFrame, spans: DataFrame, threshold: float) -> DataFrame:
    """items (item_id, ok, ...) with `excluded`: failed, both, head or tail isolation, or null."""
    lists = spans.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__spans"))
    flags = windows.isolation(F.coalesce(F.col("__spans"), F.array().cast("array<struct<start:double,end:double>>")), threshold)
    out = items.join(lists, "item_id", "left").withColumn("__f", flags)
    head, tail = F.col("__f.head"), F.col("__f.tail")
    why = F.when(~F.coalesce(F.col("ok"), F.lit(False)), "failed").when(head & tail, "both").when(head, "head").when(tail, "tail")
    return out.withColumn("excluded", why).drop("__f", "__spans")


def concat_sources(items: DataFrame, grouping: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """Concatenations from a grouping (group, item_id, part, place, gap): placed items, and sources with their length."""
    named = grouping.join(items.select("item_id", "length"), "item_id").withColumn("source_id", F.concat(F.lit("concat-"), F.col(group).cast("string"), F.lit("-"), F.col("part").cast("string")))
    placed = windows.offsets(named, ["source_id"], ["place"], "length", F.col("gap"))
    return placed, windows.concatenated_length(placed, ["source_id"], "length")


def build_windows(items: DataFrame, spans: DataFrame, grouping: DataFrame, group: str, size: float, hop: float, threshold: float) -> DataFrame:
    """The window set: every eligible item as a source of its own, and the concatenations of `grouping`.

    items: item_id, group, length, ok; spans: item_id, start, end; grouping: group, item_id, part, place, gap, of
    eligible items (see splitting.concat_groups, splitting.fixed_groups). One row per window: source_id, kind, window,
    window_start, label, starts. Waveforms are not needed: labels come from spans and lengths alone.
    """
    good = eligibility(items, spans, threshold).where("excluded is null")
    single = good.select(F.col("item_id").cast("string").alias("source_id"), "item_id", F.lit(0.0).alias("offset"), F.col("length").cast("double").alias("length"))
    placed, whole = concat_sources(good, grouping, group)
    on_sources = single.select("item_id", "source_id", "offset").unionByName(placed.select("item_id", "source_id", F.col("offset").cast("double").alias("offset")))
    moved = windows.moved_to_source(spans.select("item_id", "start", "end"), on_sources)
    sources = single.select("source_id", "length", F.lit(SINGLE).alias("kind")).unionByName(whole.select("source_id", F.col("length").cast("double").alias("length"), F.lit(CONCAT).alias("kind")))
    rows = windows.window_sums(sources, moved.select("source_id", "start", "end"), size, hop)
    return rows.withColumn("kind", F.when(F.col("source_id").startswith("concat-"), CONCAT).otherwise(SINGLE))


def window_report(rows: DataFrame, rate: str = "label") -> DataFrame:
    """Windows by kind and band, with all totals (cube); a total's key is `all`."""
    named = rows.withColumn("band", band(F.round(F.col(rate), 9)))
    name = lambda c: F.when(F.grouping(c) == 1, F.lit("all")).otherwise(F.col(c))
    out = named.cube("kind", "band").agg(name("kind").alias("__kind"), name("band").alias("__band"), F.count(F.lit(1)).alias("n"), F.sum(rate).alias("total"))
    return out.select(F.col("__kind").alias("kind"), F.col("__band").alias("band"), "n", "total")


def training_relation(singles: DataFrame, concats: DataFrame, count: int, key: str = "source_id", seed: int = 42, epoch: int = 0) -> DataFrame:
    """An epoch's sources: `count` single ones and as many concatenations, each in hash order of the epoch."""
    one = splitting.sample_exactly(singles, count, key, seed + epoch).withColumn("kind", F.lit(SINGLE))
    two = splitting.sample_exactly(concats, count, key, seed + epoch).withColumn("kind", F.lit(CONCAT))
    return one.unionByName(two, allowMissingColumns=True)


def silence_relation(base: DataFrame, ratio: float, mix: Mapping[str, float], duration: str, seed: int = 42) -> DataFrame:
    """Zero-label rows: round(ratio * rows of base) of them over the kinds of `mix` by largest remainders, each with a
    duration drawn with replacement from the base: (item_id, kind, duration, units 0)."""
    spark: SparkSession = base.sparkSession
    total = int(np.floor(ratio * base.count() + 0.5))
    weights = spark.createDataFrame([(k, float(w)) for k, w in mix.items()], "kind string, weight double")
    counts = splitting.apportioned(weights, "kind", "weight", total).where("allocated > 0")
    numbered = counts.withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("allocated") - 1)))
    wanted = numbered.select(F.concat(F.lit("silence-"), F.col("kind"), F.lit("-"), F.col("__i").cast("string")).alias("item_id"), "kind")
    return splitting.drawn_from(wanted, base.select(duration), "item_id", duration, seed).withColumn("units", F.lit(0))


def augmentation_plan(
    items: DataFrame, key: str, chances: Mapping[str, float], stretch: tuple[float, float] = (0.5, 2.0), skip_noise_below: float | None = None, seed: int = 42, epoch: int = 0
) -> DataFrame:
    """Which augmentations an item gets, by draws keyed on (seed, epoch, step, key): adds stretch, selected, skipped and
    applied (arrays in the order of `chances`). Noise is skipped where the stretch is below a bound."""
    s = F.lit(f"{seed}.{epoch}")
    k = F.col(key).cast("string")
    hit = {n: hash_uniform(s, F.lit(n), k) < p for n, p in chances.items()}
    factor = F.when(hit.get("stretch", F.lit(False)), drawn_between(hash_uniform(s, F.lit("factor"), k), *stretch, "log")).otherwise(1.0)
    chosen = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in hit.items())), lambda x: x.isNotNull())
    out = items.withColumn("stretch", factor).withColumn("selected", chosen)
    bad = F.lit(False) if skip_noise_below is None else F.col("stretch") < skip_noise_below
    out = out.withColumn("skipped", F.filter("selected", lambda x: (x == "noise") & bad))
    return out.withColumn("applied", F.array_except("selected", "skipped"))


def degraded(items: DataFrame, noises: DataFrame, key: str, samples: str, response: str, snr_db: float, seed: int = 42) -> DataFrame:
    """Adds `degraded`: reverberated, then a noise (index, noise) drawn by the item's key, mixed at a ratio."""
    n = noises.count()
    at = F.floor(hash_uniform(F.lit(str(seed)), F.col(key).cast("string")) * n).cast("long")
    numbered = noises.select(F.col("index").cast("long").alias("__n"), F.col("noise").alias("__noise"))
    wet = items.withColumn("__wet", reverberated_udf(F.col(samples), F.col(response))).withColumn("__n", at).join(numbered, "__n")
    fit = F.transform(F.sequence(F.lit(0), F.size("__wet") - 1), lambda i: F.get(F.col("__noise"), F.pmod(i, F.size("__noise"))))
    return wet.withColumn("degraded", mixed_at(F.col("__wet"), fit, F.lit(float(snr_db)))).drop("__wet", "__n", "__noise")


def augmented(
    planned: DataFrame, key: str, samples: str, response: str, noise: str, rate: float, snr: tuple[float, float] = (0.0, 20.0), gain: tuple[float, float] = (-6.0, 6.0), seed: int = 42
) -> DataFrame:
    """Adds `augmented`: the steps of augmentation_plan()'s `applied` in their order (stretch, if the plan has factors,
    reverb, noise, band, volume), with ratios and gains drawn by the item's key. A step that is not applied leaves the
    samples as they are."""
    k, s = F.col(key).cast("string"), F.lit(str(seed))
    on = lambda n: F.array_contains("applied", n)
    ratio = drawn_between(hash_uniform(s, F.lit("snr"), k), *snr)
    db = drawn_between(hash_uniform(s, F.lit("gain"), k), *gain)
    # Marked as not deterministic, the kernels stay in projections of their own: a lambda cannot hold a Python function.
    out = planned.withColumn("__x", F.col(samples))
    if "stretch" in planned.columns:
        long = stretched_udf.asNondeterministic()(F.when(on("stretch"), F.col("__x")), F.col("stretch"))
        out = out.withColumn("__long", long).withColumn("__x", F.coalesce("__long", "__x"))
    wet = reverberated_udf.asNondeterministic()(F.when(on("reverb"), F.col("__x")), F.col(response))
    out = out.withColumn("__wet", wet).withColumn("__x", F.coalesce("__wet", "__x"))
    fit = F.transform(F.sequence(F.lit(0), F.size("__x") - 1), lambda i: F.get(F.col(noise), F.pmod(i, F.size(noise))))
    out = out.withColumn("__x", F.when(on("noise"), mixed_at(F.col("__x"), fit, ratio)).otherwise(F.col("__x")))
    thin = band_pass_udf(rate * 0.05, rate * 0.35, rate).asNondeterministic()(F.when(on("band"), F.col("__x")))
    out = out.withColumn("__thin", thin).withColumn("__x", F.coalesce("__thin", "__x"))
    return out.withColumn("augmented", F.when(on("volume"), gained(F.col("__x"), db)).otherwise(F.col("__x"))).drop("__x", "__long", "__wet", "__thin")


def stretch_report(rows: DataFrame, stretch: str, low: float, high: float, edges: Sequence[float], kind: str = "log") -> DataFrame:
    """Drawn stretches against their nominal distribution: at each edge the share drawn below it and the nominal one."""
    at = F.explode(F.array(*map(F.lit, map(float, edges))))
    below = rows.select(F.col(stretch).alias("__s"), at.alias("edge")).groupBy("edge").agg(F.avg((F.col("__s") < F.col("edge")).cast("double")).alias("drawn"), F.count(F.lit(1)).alias("n"))
    return below.withColumn("nominal", stretch_cdf(F.col("edge"), low, high, kind))


def measured(spark: SparkSession, runs: Mapping[str, Callable[[], object]], repeats: int, warmup: int, session: str, clock: Callable[[], float]) -> DataFrame:
    """Times callables in one session, interleaved in rotated order: (latency_session_id, experiment_id, round, ms, warm)."""
    names, rows = list(runs), []
    for r in range(warmup + repeats):
        for name in names[r % len(names) :] + names[: r % len(names)]:
            start = clock()
            runs[name]()
            rows.append((session, name, r, (clock() - start) * 1000, r < warmup))
    return spark.createDataFrame(rows, "latency_session_id string, experiment_id string, round int, ms double, warm boolean")


def quiet_noise(key: Column, samples: Column, dbfs: Column, seed: int = 42) -> Column:
    """Uniform noise of a level in dB of full scale, keyed by an item and a sample's number."""
    width = F.pow(F.lit(10.0), dbfs / 20) * (12**0.5)
    one = lambda i: F.pmod(F.xxhash64(F.lit(seed), key, i), F.lit(1 << 32)) / float(1 << 32) - 0.5
    return F.transform(F.sequence(F.lit(0), samples - 1), lambda i: one(i) * width)


def estimated(rows: DataFrame, estimator: Callable[[Sequence[np.ndarray]], Sequence[float]], samples: str, key: str) -> DataFrame:
    """Adds `pred` and `ms`: a batch estimator over arrays, in Arrow batches, the longest inputs of a batch together.
    A prediction that is not finite is an error."""

    def run(frames):
        import time

        for frame in frames:
            order = frame[samples].map(len).sort_values(kind="stable").index
            start = time.perf_counter()
            out = pd.Series(np.asarray(estimator([np.asarray(x, np.float64) for x in frame.loc[order, samples]]), dtype=np.float64), index=order)
            if not np.isfinite(out).all():
                raise ValueError("a prediction is not finite")
            frame["pred"], frame["ms"] = out, (time.perf_counter() - start) * 1000 / max(len(frame), 1)
            yield frame

    kept = rows.drop("pred", "ms")
    schema = T.StructType([*kept.schema.fields, T.StructField("pred", T.DoubleType()), T.StructField("ms", T.DoubleType())])
    return kept.mapInPandas(run, schema)


def evaluation_rows(rows: DataFrame, split: str, identity: Mapping[str, str], condition: str | None = None) -> DataFrame:
    """Rows for the results table: metrics of all rows, or of each condition and of all pooled."""
    pool = F.concat(F.lit(f"{split}_"), F.col("scope")) if condition else F.lit(split)
    scoped = rows.withColumn("scope", F.explode(F.array(F.col(condition), F.lit("pooled")))) if condition else rows.withColumn("scope", F.lit(""))
    out = metrics.segment_metrics(scoped, ["scope"]).withColumn("split", pool).drop("scope")
    out = out.withColumns({k: F.lit(v) for k, v in identity.items()})
    return registry.results_rows(out.withColumns({c: F.lit(None) for c in registry.COLUMNS if c not in out.columns}))


def record(spark: SparkSession, parts: Sequence[DataFrame], path: str) -> None:
    """Appends all parts or none: they are one write."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    registry.append_results(spark, whole, path)


def epoch_stats(rows: DataFrame, epoch: str, kind: str, stretch: str, label: str, thresholds: Sequence[float]) -> DataFrame:
    """Per epoch: rows, rows by kind, the stretch's range and mean, the label's mean, zero share, shares from thresholds on."""
    x = F.col(label)
    return rows.groupBy(epoch).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(kind) == SINGLE).alias("n_single"),
        F.count_if(F.col(kind) == CONCAT).alias("n_concat"),
        F.min(stretch).alias("stretch_min"),
        F.avg(stretch).alias("stretch_mean"),
        F.max(stretch).alias("stretch_max"),
        F.avg(label).alias("label_mean"),
        F.avg((x == 0).cast("double")).alias("zero_share"),
        *(F.avg((x >= t).cast("double")).alias(f"ge_{t:g}".replace(".", "p")) for t in thresholds),
    )


def emission_metrics(rows: DataFrame, emission: str, reference: str, blank: int, likelihood: bool = False) -> DataFrame:
    """From frames of class scores and a reference of class ids: adds hyp (collapsed best classes), the share of frames
    that are not blank, and the edit distance over the reference's length (of the ids as characters); if asked also
    `token_nll`, the reference's negative log likelihood a token, null if the frames are too few for it."""
    best = F.transform(emission, lambda f: (F.array_position(f, F.array_max(f)) - 1).cast("int"))
    out = rows.withColumn("__best", best).withColumn("hyp", collapsed(F.col("__best"), blank))
    share = F.size(F.filter("__best", lambda x: x != blank)) / F.size("__best")
    text = lambda c: F.array_join(F.transform(c, lambda x: F.char(x + 65)), "")
    distance = F.levenshtein(text(F.col(reference)), text(F.col("hyp")))
    tokens = F.greatest(F.size(reference), F.lit(1))
    out = out.withColumn("nonblank", share).withColumn("cer", distance / tokens).drop("__best")
    if not likelihood:
        return out
    out = out.withColumn("__nll", ctc_loss_udf(blank)(F.col(emission), F.col(reference)))
    finite = F.col("__nll") < float("inf")
    return out.withColumn("token_nll", F.when(finite, F.col("__nll") / tokens)).drop("__nll")


def rule_report(rows: DataFrame, rule: Sequence[Bound], known: str, rate: str) -> DataFrame:
    """Rows by band that a rule flags, that are known, flagged but not known, and known but missed."""
    hit, k = meets_all(rule), F.coalesce(F.col(known), F.lit(False))
    counts = {"flagged": hit, "known": k, "new": hit & ~k, "missed": k & ~hit}
    return rows.groupBy(band(F.col(rate)).alias("band")).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(n) for n, c in counts.items()))


def span_inspection(spans: DataFrame, sources: DataFrame, keys: Sequence[str] = ("source_id",)) -> DataFrame:
    """Per source: spans, mean length, the longest distance between starts, silence before the first and after the last."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    gaps = spans.withColumn("__gap", F.lead("start").over(w) - F.col("start"))
    out = gaps.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("end") - F.col("start")).alias("mean_length"), F.max("__gap").alias("longest_gap"), F.min("start").alias("lead"), F.max("end").alias("__last"))
    return out.join(sources.select(*keys, "length"), list(keys)).withColumn("trail", F.col("length") - F.col("__last")).drop("__last")
