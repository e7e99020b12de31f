"""Operators by hand-computed cases, invariants and independence of the input's order."""

import pytest
from pyspark.sql import functions as F

from spanmill.operators import catalog as ca
from spanmill.operators import metrics as me
from spanmill.operators import registry, rules, stats
from spanmill.operators import sequences as se
from spanmill.operators import splitting as sp
from spanmill.operators import windows as wi


def labels(spark, spans, length, size=2.0, hop=0.25):
    sources = spark.createDataFrame([("s", length)], "source_id string, length double")
    rows = spark.createDataFrame([("s", float(a), float(b)) for a, b in spans], "source_id string, start double, end double")
    return {r["window"]: r["label"] for r in wi.window_sums(sources, rows, size, hop).collect()}


def test_fractional_labels(spark):
    got = labels(spark, [(0.1, 0.2), (1.95, 2.05), (2.5, 2.6)], 6.0)
    assert len(got) == 17
    assert got[0] == pytest.approx(1.5)
    assert got[1] == pytest.approx(1.0)
    assert got[12] == pytest.approx(0.0)


def test_point_spans(spark):
    got = labels(spark, [(1, 1), (2, 1.9), (0, 0)], 4.0)
    assert (got[0], got[2], got[6]) == (2.0, 2.0, 1.0)


def test_tiling_conserves_spans(spark):
    got = labels(spark, [(0.3, 1.7), (1.9, 4.2), (5.5, 5.9)], 6.0, 2.0, 2.0)
    assert sum(got.values()) == pytest.approx(3.0)


def test_short_sources_have_no_windows(spark):
    assert labels(spark, [(0, 1)], 1.9) == {}


def test_offsets_of_a_concatenation(spark):
    at = wi.array_offsets(F.array(*map(F.lit, (40000, 48000, 32000))), F.array(F.lit(8000), F.lit(16000)))
    assert spark.range(1).select(at).first()[0] == [0, 48000, 112000]
    rows = spark.createDataFrame([("s", 0, 40000), ("s", 1, 48000), ("s", 2, 32000)], "source_id string, pos int, n int")
    got = wi.offsets(rows, ["source_id"], ["pos"], "n", 8000).orderBy("pos").collect()
    assert [r["offset"] for r in got] == [0, 48000, 104000]


def test_shift_by_zero_is_the_identity(spark):
    rows = spark.createDataFrame([("s", 0.5, 1.0, 2.0), ("s", 1.5, 2.0, 2.0)], "source_id string, start double, end double, length double")
    assert ca.same_rows(wi.shifted_spans(rows, 0.0).drop("clamped"), rows)
    moved = wi.shifted_spans(rows, 0.75).orderBy("start").collect()
    assert [(r["start"], r["end"], r["clamped"]) for r in moved] == [(1.25, 1.75, False), (2.0, 2.0, True)]


def test_speed_one_is_the_identity(spark):
    rows = spark.createDataFrame([("s", 0.5, 1.0)], "source_id string, start double, end double")
    assert ca.same_rows(wi.scaled(rows, 1.0), rows)


def test_isolation(spark):
    spans = lambda *starts: F.array(*(F.struct(F.lit(float(s)).alias("start")) for s in starts))
    got = lambda c: tuple(spark.range(1).select(wi.isolation(c, 1.0).alias("i")).first()["i"])
    assert got(spans(0, 1.5, 1.7, 2.0)) == (True, False)
    assert got(spans(0, 1.0, 2.5)) == (False, True)
    assert got(spans(0)) == (False, False)


def test_neighbour_pairs_and_touching_windows(spark):
    items = spark.createDataFrame([("s", i, i * 10) for i in range(5)], "k string, i int, v int")
    assert [(r["v"], r["next"]) for r in wi.neighbour_pairs(items, ["k"], ["i"], "v").orderBy("i").collect()] == [(0, 10), (20, 30)]
    windows = wi.window_starts(spark.createDataFrame([("s", 10.0)], "source_id string, length double"), 4.0, 2.0)
    parts = spark.createDataFrame([("s", 4.0, 5.0)], "source_id string, start double, end double")
    assert sorted(r["window"] for r in wi.windows_touching(windows, parts, 4.0, 2.0).collect()) == [1, 2]


def triples(spark):
    return spark.createDataFrame([(3.0, 4.0), (5.0, 4.5), (8.0, 7.0), (10.0, 12.0)], "truth double, pred double")


def test_segment_metrics(spark):
    r = me.segment_metrics(triples(spark)).first()
    assert (r["n"], r["mae"]) == (4, 1.125)
    assert (r["mae_under4"], r["mae_4to6"], r["mae_6to8"], r["mae_over8"]) == (1.0, 0.5, None, 1.5)
    assert (r["n_under4"], r["n_4to6"], r["n_6to8"], r["n_over8"]) == (1, 1, 0, 2)


def test_correlation_guards(spark):
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "truth double, pred double")
    assert flat.agg(me.guarded_corr("truth", "pred")).first()[0] is None
    assert flat.limit(1).agg(me.guarded_corr("truth", "pred")).first()[0] is None
    assert triples(spark).where("false").agg(me.guarded_corr("truth", "pred")).first()[0] is None


def test_bins_keep_empty_groups(spark):
    rows = spark.createDataFrame([(12.2, 11.0), (12.8, 12.0), (13.5, 12.5)], "truth double, pred double")
    got = {r["bin"]: r for r in me.bin_summary(rows).collect()}
    assert len(got) == 10
    b = got["12to13"]
    assert (b["n"], b["truth_mean"], b["pred_mean"]) == (2, 12.5, 11.5)
    assert (b["bias"], b["pred_p10"], b["pred_p90"]) == (pytest.approx(-1), pytest.approx(11.1), pytest.approx(11.9))
    assert (got["lt6"]["n"], got["lt6"]["mae"]) == (0, None)
    assert {r["band"]: r["n"] for r in me.band_summary(rows).collect()} == {"under4": 0, "4to6": 0, "6to8": 0, "over8": 3}


def test_catalog_has_one_row_per_reason(spark):
    rows = [
        ("p1", "a.mp3", "good", "2", "0"),
        ("p1", "b.mp3", "bad votes", "1", "1"),
        ("p1", "c.mp3", "  ", "2", "0"),
        ("p1", "d.mp3", "latin", "2", "0"),
        ("p1", "e.mp3", "12345", "2", "0"),
        ("p1", "f.mp3", "no length", "2", "0"),
        ("p1", "g.mp3", "too long", "2", "0"),
        ("p1", "h.mp3", "unread votes", "x", "0"),
    ]
    t = spark.createDataFrame(rows, "client_id string, path string, sentence string, up_votes string, down_votes string")
    d = spark.createDataFrame([(p, 1.0) for p in ("a.mp3", "b.mp3", "c.mp3", "d.mp3", "e.mp3", "h.mp3")] + [("g.mp3", 600.0)], "path string, duration double")
    kana = {"latin": "アx"}
    k = spark.createDataFrame([(r[2].strip(), kana.get(r[2], "アイウ")) for r in rows], "sentence string, kana string")
    got = {r["item_id"]: r["reason"] for r in ca.build_catalog(t, d, k).collect()}
    assert got == {"a": None, "b": "down_votes", "c": "empty_sentence", "d": "unconverted", "e": "long_digit_run", "f": "missing_duration", "g": "outlier", "h": "down_votes"}


def test_validations(spark):
    a = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    with pytest.raises(ca.Violation, match="repeated"):
        ca.assert_unique(a, ["k"])
    with pytest.raises(ca.Violation, match="missing"):
        ca.assert_contained(a, a.where("k = 1"), "k")
    with pytest.raises(ca.Violation, match="both"):
        ca.assert_disjoint(a, a, "k")
    assert not ca.same_rows(a, a.distinct())


def test_rules(spark):
    rows = spark.createDataFrame([("a", 0.95, 0.01), ("b", 0.95, 0.2), ("c", 0.1, 0.01), ("d", float("nan"), 0.01)], "id string, cer double, frac double")
    rule = [("cer", ">=", 0.9), ("frac", "<", 0.05)]
    assert [r["id"] for r in rules.flagged(rows, rule, ["id"]).collect()] == ["a"]
    with pytest.raises(ValueError, match="without bounds"):
        rules.meets_all([])
    with pytest.raises(ValueError, match="none of"):
        rules.meets(("cer", "=", 0.9))
    known = rows.withColumn("known", F.col("id") == "a")
    found = {r["metric"]: (r["op"], r["threshold"]) for r in rules.covering_conditions(known, "known", ["cer", "frac"], 0.1).collect()}
    assert found["cer"] == (">=", pytest.approx(0.9))


def test_rule_search_over_more_bounds_than_a_word_holds(spark):
    data = [(i, float(i), i >= 90) for i in range(100)]
    rows = spark.createDataFrame(data, "id int, x double, known boolean")
    bounds = [("x", ">=", float(k)) for k in range(0, 100, 2)] + [("x", "<", float(k)) for k in range(1, 40, 2)]
    got = {r["rule"]: (r["hits"], r["covered"]) for r in rules.candidate_rules(rows, "known", bounds, most=2, limit=10_000).collect()}
    assert len(got) == 70 + 70 * 69 // 2
    for text, (hits, covered) in list(got.items())[::37]:
        met = [k for i, x, k in data if all(x >= float(t[3:]) if ">=" in t else x < float(t[2:]) for t in text.split("&"))]
        assert (hits, covered) == (len(met) - sum(met), sum(met))


def test_greedy_split_and_independence(spark):
    sizes = {f"g{i:02d}": 1 + (i * 7) % 40 for i in range(30)}
    groups = spark.createDataFrame(list(sizes.items()), "g string, n int")
    got = {r["g"]: r["split"] for r in sp.greedy_split(groups, "g", "n", {"train": 8, "dev": 1, "test": 1}).collect()}
    again = {r["g"]: r["split"] for r in sp.greedy_split(groups.orderBy(F.desc("g")), "g", "n", {"train": 8, "dev": 1, "test": 1}).collect()}
    assert got == again
    assert set(got) == set(sizes)
    total = sum(sizes.values())
    share = {s: sum(sizes[g] for g in got if got[g] == s) / total for s in set(got.values())}
    assert share["train"] == pytest.approx(0.8, abs=0.02)


def test_stratified_split_is_exact(spark):
    rows = spark.createDataFrame([("a", f"a{i}") for i in range(25)] + [("b", f"b{i}") for i in range(4)], "s string, k string")
    got = {(r["s"], r["part"]): r["count"] for r in sp.stratified_split(rows, "s", "k", 0.1).groupBy("s", "part").count().collect()}
    assert got == {("a", "eval"): 2, ("a", "train"): 23, ("b", "train"): 4}


def test_apportioned_sums_to_the_total(spark):
    w = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "k string, w double")
    assert [r["allocated"] for r in sp.apportioned(w, "k", "w", 10).orderBy("k").collect()] == [4, 3, 3]


def test_concat_groups_respect_sizes_and_groups(spark):
    rows = spark.createDataFrame([(f"s{i % 3}", f"k{i:03d}") for i in range(40)] + [("few", "z1"), ("few", "z2")], "g string, k string")
    got = sp.concat_groups(rows, "g", "k").collect()
    assert {r["g"] for r in got} == {"s0", "s1", "s2"}
    assert len({r["k"] for r in got}) == len(got)
    by = {}
    for r in got:
        by.setdefault((r["g"], r["part"]), []).append((r["place"], r["gap"]))
    for members in by.values():
        assert 1 <= len(members) <= 5
        assert [p for p, _ in sorted(members)] == list(range(len(members)))
        assert sorted(members)[-1][1] == 0
        assert all(g % 1600 == 0 and 1600 <= g <= 16000 for _, g in sorted(members)[:-1])
    alone = {(r["g"], r["k"], r["part"]) for r in sp.concat_groups(rows.where("g = 's1'"), "g", "k").collect()}
    assert alone == {(r["g"], r["k"], r["part"]) for r in got if r["g"] == "s1"}


def test_label_spans(spark):
    rows = spark.createDataFrame([("u", i, x) for i, x in enumerate([0, 1, 1, 0, 1, 2, 2, 0])], "u string, i int, x int")
    got = sorted((r["start"], r["end"], r["x"]) for r in se.label_spans(rows, ["u"], ["i"], "x", 0).collect())
    assert got == [(1, 3, 1), (4, 5, 1), (5, 7, 2)]
    tokens = spark.createDataFrame([("u", i, x) for i, x in enumerate([1, 1, 2])], "u string, i int, x int")
    assert se.frames_needed(tokens, ["u"], ["i"], "x").first()["frames"] == 4


def test_early_stopping(spark):
    rows = spark.createDataFrame([("m", i, v) for i, v in enumerate([5.0, 4.0, 4.5, 4.2, 4.1, 3.0])], "m string, e int, v double")
    got = se.best_so_far(rows, ["m"], ["e"], "v", patience=3).orderBy("e").collect()
    assert [r["improved"] for r in got] == [True, True, False, False, False, True]
    assert [r["stop"] for r in got] == [False, False, False, False, True, False]


def test_holm(spark):
    rows = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03), (3, float("nan"))], "i int, p double")
    got = [r["adjusted"] for r in stats.holm(rows, "p", ["i"]).orderBy("i").collect()]
    assert got == [pytest.approx(0.03), pytest.approx(0.06), pytest.approx(0.06), None]


def test_weighted_median_and_factor(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 5.0)], "v double, w double")
    assert stats.weighted_median(rows, "v", "w").first()[0] == 3.0
    assert stats.conversion_factor(rows, F.lit(0.0), "w") == 1.0
    assert stats.conversion_factor(rows, F.col("v"), "w") == 1.0


def test_rank_sum(spark):
    rows = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 3.0)] + [("b", x) for x in (2.0, 4.0, 5.0, 6.0)], "g string, v double")
    r = stats.rank_sum(rows, "g", "a", "b", "v").first()
    assert (r["n1"], r["n2"], r["u"]) == (3, 4, 1.5)
    assert 0.1 < r["p"] < 0.25


def test_joint_regression_recovers_a_line(spark):
    rows = [(f"c{i % 20}", i * 0.1, (i * 37 % 11) / 3, 2 * i * 0.1 - 3 * ((i * 37 % 11) / 3) + 1) for i in range(200)]
    df = spark.createDataFrame(rows, "c string, x double, z double, y double")
    got = {r["name"]: r for r in stats.joint_regression(df, "y", ["x", "z"], "c", reps=20).collect()}
    assert got["x"]["coef"] == pytest.approx(2)
    assert got["z"]["coef"] == pytest.approx(-3)
    assert got["x"]["low"] <= got["x"]["coef"] + 1e-9
    assert got["intercept"]["coef"] == pytest.approx(1)


def result_row(**more):
    values = {c: None for c in registry.COLUMNS} | {"experiment_id": "e1", "n": 3, "mae": 0.5, "r": float("nan"), "timestamp": "2024-01-01T00:00:00+09:00"} | more
    return tuple(values[c] for c in registry.COLUMNS)


def test_registry_is_locked_and_upgrades(spark, tmp_path):
    path = str(tmp_path / "results")
    rows = spark.createDataFrame([result_row()], registry.SCHEMA)
    with pytest.raises(registry.SchemaDrift, match="unknown"):
        registry.append_results(spark, rows.withColumn("extra", F.lit(1)), path)
    with pytest.raises(registry.SchemaDrift, match="missing"):
        registry.append_results(spark, rows.drop("mae"), path)
    rows.select(*registry.LAYOUTS[0]).write.parquet(path)
    with pytest.raises(registry.SchemaDrift, match="upgrade"):
        registry.append_results(spark, rows, path)
    assert registry.upgrade_results(spark, path)
    assert not registry.upgrade_results(spark, path)
    registry.append_results(spark, rows, path)
    got = spark.read.parquet(path)
    assert tuple(got.columns) == registry.COLUMNS
    assert got.count() == 2
    assert got.where("isnan(r)").count() == 1  # an upgrade leaves old values as they are; appends turn NaN to null


def test_newest_common_session(spark):
    rows = spark.createDataFrame(
        [("old", "a", "2024-01-01"), ("old", "b", "2024-01-01"), ("new", "a", "2024-02-01"), ("new", "b", "2024-02-02"), ("newest", "a", "2024-03-01"), ("", "b", "2024-04-01")],
        "latency_session_id string, experiment_id string, timestamp string",
    )
    got = registry.compare_sessions(rows, ["a", "b"]).collect()
    assert {(r["latency_session_id"], r["experiment_id"]) for r in got} == {("new", "a"), ("new", "b")}
    with pytest.raises(registry.SessionMismatch):
        registry.compare_sessions(rows, ["a", "c"])
