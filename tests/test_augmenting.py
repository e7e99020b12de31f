"""Chains of augmentations: faults found before a run, draws by key, masks in features."""

import pytest
from pyspark.sql import functions as F

from spanmill.operators import augmenting as au

WHOLE = {
    "stretch": au.Step(1.0, {"factor": (0.8, 1.25)}),
    "reverb": au.Step(0.5),
    "volume": au.Step(0.5, {"db": (-3.0, 3.0)}),
}


@pytest.mark.parametrize(
    "chain, word",
    [
        ({"echo": au.Step(0.5)}, "no such step"),
        ({"reverb": au.Step(0.0)}, "chance"),
        ({"reverb": au.Step(float("nan"))}, "chance"),
        ({"noise": au.Step(0.5)}, "no range snr"),
        ({"noise": au.Step(0.5, {"snr": (9.0, 3.0)})}, "not a range"),
        ({"noise": au.Step(0.5, {"snr": (0.0, 3.0), "gain": (0.0, 1.0)})}, "no such range"),
        ({"volume": au.Step(0.5, {"db": (0.0, 0.0)})}, "never changes"),
        ({"stretch": au.Step(0.5, {"factor": (0.0, 2.0)})}, "not positive"),
        ({"mask": au.Step(0.5, {"masks": (1, 2), "width": (0, 0)})}, "never changes"),
    ],
)
def test_faults(chain, word):
    assert any(word in f for f in au.faults(chain))


def test_a_sound_chain_has_no_faults_and_limits_hold():
    assert au.faults(WHOLE) == []
    assert au.faults(WHOLE, {"stretch.factor": (0.9, 1.1)}) == ["stretch.factor: 0.8 to 1.25 leaves 0.9 to 1.1"]
    assert au.described(WHOLE)[:3] == ["stretch: 100 %, factor 0.8 to 1.25", "reverb: 50 %", "noise: off"]


def test_run_refuses_faults_and_counts_the_new_duration(spark):
    rows = spark.range(6).select(F.col("id").alias("k"), F.transform(F.sequence(F.lit(0), F.lit(799)), lambda i: F.sin(i / 9.0)).alias("x"), F.array(F.lit(1.0)).alias("h"), F.array(F.lit(0.1)).alias("n"))
    with pytest.raises(ValueError, match="chance"):
        au.run(rows, {"reverb": au.Step(2.0)}, "k", "x", "h", "n", 16000.0)
    got = au.run(rows, WHOLE, "k", "x", "h", "n", 16000.0).collect()
    assert len(got) == 6
    for r in got:
        assert "stretch" in r["applied"] and len(r["augmented"]) == round(800 * r["stretch"])
        assert r["seconds"] == pytest.approx(len(r["augmented"]) / 16000)


def test_masks_hold_their_bands_in_every_frame(spark):
    rows = spark.range(200).select(F.col("id").alias("k"), F.array_repeat(F.array_repeat(F.lit(1.0), 8), 3).alias("e"))
    got = au.feature_masked(rows, "k", "e", au.Step(0.5, {"masks": (1, 3), "width": (1, 4)}), value=-1.0).collect()
    again = {r["k"]: r["masks"] for r in au.feature_masked(rows.orderBy(F.desc("k")), "k", "e", au.Step(0.5, {"masks": (1, 3), "width": (1, 4)})).collect()}
    assert 60 < sum(bool(r["masks"]) for r in got) < 140
    for r in got:
        held = {b for m in r["masks"] for b in range(m["first"], m["first"] + m["width"])}
        assert held <= set(range(8)) and r["masks"] == again[r["k"]]
        assert r["masked_features"] == [[-1.0 if b in held else 1.0 for b in range(8)]] * 3


def test_masks_of_no_frames(spark):
    rows = spark.createDataFrame([(1, []), (2, None)], "k long, e array<array<double>>")
    got = {r["k"]: r["masked_features"] for r in au.feature_masked(rows, "k", "e", au.Step(1.0, {"masks": (1, 1), "width": (1, 1)})).collect()}
    assert got == {1: [], 2: None}
