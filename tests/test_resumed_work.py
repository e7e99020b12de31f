"""Shards that resume, results as CSV, provenance, and small relations of evaluations."""

import pytest
from pyspark.sql import functions as F

from spanmill.functions import text as tx
from spanmill.operators import catalog as ca
from spanmill.operators import registry, stats
from spanmill.operators import windows as wi
from spanmill.sources import provenance, writers


def computed(items):
    value = F.when(F.col("item_id") != "i3", F.array(F.array(F.lit(1.0))))
    return items.select("item_id", "shard", F.lit(1).alias("frames"), value.alias("feature"))


def test_only_missing_shards_are_made(spark, tmp_path):
    items = spark.range(40).select(F.concat(F.lit("i"), "id").alias("item_id"))
    path = str(tmp_path / "f")
    assert writers.sharded_features(spark, items, computed, path, 5, at_once=2) == [0, 1, 2, 3, 4]
    assert writers.sharded_features(spark, items, computed, path, 5) == []
    rows = spark.read.parquet(f"{path}/features")
    assert rows.count() == rows.select("item_id").distinct().count() == 40
    done = spark.read.json(f"{path}/done").collect()
    assert sum(r["items"] for r in done) == 40 and sum(r["failed"] for r in done) == 1
    with pytest.raises(ValueError, match="another number"):
        writers.sharded_features(spark, items, computed, path, 6)


def test_a_crash_between_rows_and_mark_leaves_no_doubles(spark, tmp_path):
    items = spark.range(30).select(F.concat(F.lit("i"), "id").alias("item_id"))
    path, calls = str(tmp_path / "f"), []

    def breaking(rows):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return computed(rows)

    with pytest.raises(RuntimeError):
        writers.sharded_features(spark, items, breaking, path, 4, at_once=2)
    # Rows of a shard without its mark, as a crash would leave them.
    computed(items.withColumn("shard", F.lit(2))).write.mode("append").partitionBy("shard").parquet(f"{path}/features")
    assert writers.sharded_features(spark, items, computed, path, 4, at_once=2) == [2, 3]
    rows = spark.read.parquet(f"{path}/features")
    assert rows.count() == rows.select("item_id").distinct().count() == 30


def result(spark, **more):
    values = {c: None for c in registry.COLUMNS} | {"experiment_id": "e1", "n": 3, "mae": 0.5, "r": float("nan"), "timestamp": "2024-01-01T00:00:00+09:00"} | more
    return spark.createDataFrame([tuple(values[c] for c in registry.COLUMNS)], registry.SCHEMA)


def test_results_as_csv(spark, tmp_path):
    path = str(tmp_path / "r")
    registry.append_results(spark, result(spark), path, "csv")
    registry.append_results(spark, result(spark, experiment_id="a, \"b\""), path, "csv")
    got = {r["experiment_id"]: r for r in registry.results(spark, path, "csv").collect()}
    assert set(got) == {"e1", 'a, "b"'} and got["e1"]["r"] is None and got["e1"]["mae"] == 0.5 and got["e1"]["n"] == 3
    assert got["e1"]["timestamp"] == "2024-01-01T00:00:00+09:00"


def test_csv_of_an_earlier_layout_is_upgraded_once(spark, tmp_path):
    path = str(tmp_path / "r")
    result(spark).select(*registry.LAYOUTS[0]).write.option("header", True).csv(path)
    with pytest.raises(registry.SchemaDrift, match="upgrade"):
        registry.append_results(spark, result(spark), path, "csv")
    assert registry.upgrade_results(spark, path, "csv") and not registry.upgrade_results(spark, path, "csv")
    registry.append_results(spark, result(spark, host="h"), path, "csv")
    assert sorted(str(r["host"]) for r in registry.results(spark, path, "csv").collect()) == ["None", "h"]


def test_provenance(spark, tmp_path):
    assert provenance.commit_of(str(tmp_path)) == ("unknown", True)
    r = provenance.stamped(spark.range(1), tmp_path, "cpu", "here").first()
    assert (r["commit"], r["host"], r["device"]) == ("unknown+", "here", "cpu") and r["timestamp"].endswith("+00:00")


def test_replicates_are_k_draws_of_clusters(spark):
    """One cluster a key: every replicate is the sample itself. Two: a replicate's weights sum to 2."""
    rows = [("p", "a", x, 2.0 * x + 1) for x in (0.0, 1.0, 2.0)] + [("q", c, x, 3.0 * x + (c == "b")) for c in "ab" for x in (0.0, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, c string, x double, y double")
    got = {(r["g"], r["name"]): r for r in stats.joint_regression(df, "y", ["x"], "c", reps=60, keys=["g"]).collect()}
    p = got["p", "intercept"]
    assert p["coef"] == pytest.approx(1) and p["low"] == pytest.approx(1) and p["high"] == pytest.approx(1)
    q = got["q", "intercept"]
    assert (q["coef"], q["low"], q["high"]) == (pytest.approx(0.5), pytest.approx(0), pytest.approx(1))
    assert got["q", "x"]["low"] == pytest.approx(3)


def test_band_analysis_leaves_out_rows_without_the_variable(spark):
    rows = [("k", f"c{i % 5}", 0.5 * i + 0.1 * z, float(i), None if i == 3 else float(z), float(z * z)) for i in range(10) for z in (1, 2, 5)]
    df = spark.createDataFrame(rows, "band string, c string, y double, t double, u double, v double")
    got = {r["variable"]: r for r in stats.band_analysis(df, "y", ["u", "v"], "t", "c", "band", reps=20).collect()}
    assert (got["u"]["n"], got["v"]["n"]) == (27, 30)
    assert got["u"]["slope"] == pytest.approx(0.1) and got["u"]["low"] == pytest.approx(0.1)


def test_eligible_segments_and_rates(spark):
    df = spark.createDataFrame([(5, 5, "アイウエオ"), (5, 4, "アイウエ"), (9, 9, "アイウエオアイウエ"), (3, 3, "アイx"), (None, 3, "アイウ")], "a int, b int, r string")
    assert [r[0] for r in df.select(ca.eligible(F.col("a"), F.col("b"), F.col("r"), 3, 8)).collect()] == [True, False, False, False, False]
    rows = spark.createDataFrame([("c/1.wav", 12, 4.0)], "path string, units int, seconds double")
    assert ca.segments(rows, "/audio/").select("file", "truth").first() == ("/audio/c/1.wav", 3.0)
    w = spark.createDataFrame([(3200, 8.0)], "window_start int, pred double")
    assert wi.window_rates(w, 2.0, 16000).select("start_sec", "end_sec", "per_sec").first() == (0.2, 2.2, 4.0)


def test_word_lengths_drop_words_of_none(spark):
    df = spark.createDataFrame([(["キャ", "", "アイー", "x"],)], "w array<string>")
    assert df.select(tx.word_lengths(F.col("w"))).first()[0] == [1, 3]


def test_windows_of_sources_with_excluded_items_go(spark):
    windows = spark.createDataFrame([("s", 0), ("s", 1), ("t", 0)], "source_id string, window int")
    sources = spark.createDataFrame([("s", ["a", "b"]), ("t", ["c"])], "source_id string, item_ids array<string>")
    left = ca.without_items(windows, sources, spark.createDataFrame([("b",), ("z",)], "item_id string"))
    assert [tuple(r) for r in left.collect()] == [("t", 0)]


def test_excerpt_label_counts_parts_of_stretched_spans(spark):
    spans = spark.createDataFrame([("s", 0.0, 4.0), ("s", 4.0, 8.0), ("s", 20.0, 20.0), ("t", 0.0, 9.0)], "source_id string, start double, end double")
    plans = spark.createDataFrame([("s", 2.0, 2, 0), ("s", 2.0, 18, 4), ("u", 1.0, 0, 0)], "source_id string, stretch double, excerpt_start int, window_start int")
    got = {(r["source_id"], r["excerpt_start"]): r["label"] for r in wi.excerpt_labels(spans, plans, 8).collect()}
    assert got == {("s", 2): 1.0, ("s", 18): 1.0, ("u", 0): 0.0}
