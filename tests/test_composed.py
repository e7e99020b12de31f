"""Composed relations: window sets, plans, evaluations, sessions."""

import itertools

import pytest
from pyspark.sql import functions as F

from spanmill.operators import composed as co
from spanmill.operators import registry
from spanmill.operators import splitting as sp
from spanmill.operators import windows as wi


def clips(spark):
    rows = [(f"{g}{i}", g, 2.5 + 0.5 * i, i != 6) for g, n in (("A", 7), ("B", 4), ("C", 2)) for i in range(n)]
    items = spark.createDataFrame(rows, "item_id string, grp string, length double, ok boolean")
    spans = [(i, round(0.1 + 0.3 * k, 3), round(0.12 + 0.3 * k, 3)) for i, _, n, _ in rows for k in range(int(n / 0.3))]
    return items, spark.createDataFrame(spans, "item_id string, start double, end double")


def test_window_set_labels_every_source_and_conserves_spans(spark):
    items, spans = clips(spark)
    good = co.eligibility(items, spans, 1.0).where("excluded is null")
    assert good.count() == 12
    grouping = sp.fixed_groups(good.select("grp", "item_id"), "grp", "item_id", 3).withColumn("gap", F.lit(0.5))
    rows = co.build_windows(items, spans, grouping, "grp", 2.0, 2.0, 1.0)
    kinds = {r["kind"]: r["count"] for r in rows.groupBy("kind").count().collect()}
    assert set(kinds) == {"single", "concat"}
    single = rows.where("source_id = 'B3'").orderBy("window").collect()
    assert [r["window"] for r in single] == [0, 1]
    assert sum(r["label"] for r in single) == pytest.approx(13.0)
    assert all(r["gapless"] for r in wi.window_ranges(rows).collect())
    report = {(r["kind"], r["band"]): r["n"] for r in co.window_report(rows).collect()}
    assert report[("all", "all")] == rows.count()


def test_isolated_and_failed_items_are_left_out(spark):
    items = spark.createDataFrame([("a", "g", 5.0, True), ("b", "g", 5.0, False), ("c", "g", 5.0, True), ("d", "g", 5.0, True)], "item_id string, grp string, length double, ok boolean")
    spans = spark.createDataFrame([("a", 0.0, 0.1), ("a", 2.0, 2.1), ("a", 2.2, 2.3), ("c", 0.0, 0.1), ("c", 0.2, 0.3), ("c", 3.0, 3.1)], "item_id string, start double, end double")
    got = {r["item_id"]: r["excluded"] for r in co.eligibility(items, spans, 1.0).collect()}
    assert got == {"a": "head", "b": "failed", "c": "tail", "d": None}


def test_plan_is_keyed_and_skips_noise(spark):
    rows = spark.range(500).withColumnRenamed("id", "k")
    plan = co.augmentation_plan(rows, "k", {"stretch": 0.5, "noise": 0.5}, skip_noise_below=0.9).collect()
    again = {r["k"]: r for r in co.augmentation_plan(rows.orderBy(F.desc("k")), "k", {"stretch": 0.5, "noise": 0.5}, skip_noise_below=0.9).collect()}
    for r in plan:
        assert r == again[r["k"]]
        assert ("stretch" in r["selected"]) == (r["stretch"] != 1.0)
        assert r["skipped"] == (["noise"] if "noise" in r["selected"] and r["stretch"] < 0.9 else [])
        assert set(r["applied"]) == set(r["selected"]) - set(r["skipped"])
    assert 200 < sum("noise" in r["selected"] for r in plan) < 300


def test_steps_not_applied_leave_samples(spark):
    rows = spark.createDataFrame([(1, [0.1, -0.2, 0.3], [1.0], [0.5, 0.5], [])], "k long, x array<double>, response array<double>, noise array<double>, applied array<string>")
    out = co.augmented(rows, "k", "x", "response", "noise", 64.0).first()
    assert out["augmented"] == [0.1, -0.2, 0.3]
    loud = co.augmented(rows.withColumn("applied", F.array(F.lit("noise"), F.lit("volume"))), "k", "x", "response", "noise", 64.0).first()
    assert loud["augmented"] != out["augmented"]


def test_quiet_noise_has_its_level(spark):
    x = spark.range(1).select(co.quiet_noise(F.lit("a"), F.lit(4000), F.lit(-40.0)).alias("x")).first()["x"]
    assert sum(v * v for v in x) / len(x) == pytest.approx(1e-4, rel=0.1)


def test_estimates_must_be_finite(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0])], "k long, x array<double>")
    got = co.estimated(rows, lambda xs: [float(x.sum()) for x in xs], "x", "k").orderBy("k").collect()
    assert [r["pred"] for r in got] == [3.0, 3.0]
    with pytest.raises(Exception, match="not finite"):
        co.estimated(rows, lambda xs: [float("nan") for _ in xs], "x", "k").collect()


def test_evaluation_rows_append_together(spark, tmp_path):
    rows = spark.createDataFrame([(3.0, 4.0, "a"), (5.0, 4.5, "b")], "truth double, pred double, c string")
    clean = co.evaluation_rows(rows, "dev", {"experiment_id": "e"})
    noisy = co.evaluation_rows(rows, "dev_noisy", {"experiment_id": "e"}, "c")
    co.record(spark, [clean, noisy], str(tmp_path / "r"))
    got = spark.read.parquet(str(tmp_path / "r"))
    assert tuple(got.columns) == registry.COLUMNS
    assert {r["split"]: r["n"] for r in got.collect()} == {"dev": 2, "dev_noisy_a": 1, "dev_noisy_b": 1, "dev_noisy_pooled": 2}


def test_sessions_are_interleaved_and_summarised_without_warm_up(spark):
    ticks = itertools.count()
    rows = co.measured(spark, {"a": lambda: None, "b": lambda: None}, repeats=3, warmup=1, session="s", clock=lambda: float(next(ticks)))
    assert rows.count() == 8
    got = {r["experiment_id"]: (r["median_ms"], r["n"]) for r in registry.latency_summary(rows, ["experiment_id"], "ms", F.col("warm")).collect()}
    assert got == {"a": (1000.0, 3), "b": (1000.0, 3)}


def test_silence_rows_sum_to_the_ratio(spark):
    base = spark.createDataFrame([(float(i),) for i in range(40)], "duration double")
    got = co.silence_relation(base, 0.26, {"digital": 1.0, "quiet": 1.0, "noise": 2.0}, "duration").collect()
    assert len(got) == 10
    assert {r["units"] for r in got} == {0}


def test_emissions(spark):
    rows = spark.createDataFrame([([[0.1, 0.9, 0.0], [0.1, 0.9, 0.0], [0.9, 0.1, 0.0], [0.0, 0.1, 0.9]], [1, 2])], "e array<array<double>>, ref array<int>")
    r = co.emission_metrics(rows, "e", "ref", 0).first()
    assert (r["hyp"], r["nonblank"], r["cer"]) == ([1, 2], 0.75, 0.0)


def test_rule_report(spark):
    rows = spark.createDataFrame([(3.0, 0.95, True), (3.5, 0.1, True), (9.0, 0.99, False)], "rate double, cer double, known boolean")
    got = {r["band"]: (r["flagged"], r["new"], r["missed"]) for r in co.rule_report(rows, [("cer", ">=", 0.9)], "known", "rate").collect()}
    assert got == {"under4": (1, 0, 1), "over8": (1, 1, 0)}
