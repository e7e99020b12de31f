"""Scalar, text and array functions by hand-computed cases and invariants."""

import math
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanmill.functions import arrays as ar
from spanmill.functions import numeric as nu
from spanmill.functions import signal as sg
from spanmill.functions import text as tx


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(column).first()[0]


def bands_of(spark, column, values):
    rows = spark.createDataFrame([(float(v),) for v in values], "x double").select("x", column.alias("key")).collect()
    return {r["x"]: r["key"] for r in rows}


def test_bands_are_closed_on_the_left(spark):
    """Each edge and the numbers next to it on both sides."""
    near = [v for edge in (4.0, 6.0, 8.0) for v in (math.nextafter(edge, 0), edge, math.nextafter(edge, 99))]
    assert list(bands_of(spark, nu.band(F.col("x")), near).values()) == ["under4", "4to6", "4to6", "4to6", "6to8", "6to8", "6to8", "over8", "over8"]
    assert bands_of(spark, nu.band(F.col("x")), [-1, 1e9]) == {-1.0: "under4", 1e9: "over8"}


def test_band_of_nan_is_undefined_and_strictly_an_error(spark):
    assert one(spark, nu.band(F.col("x")), x=float("nan")) is None
    with pytest.raises(Exception, match="NaN has no band"):
        one(spark, nu.band_strict(F.col("x")), x=float("nan"))


def test_bins_are_one_wide_between_their_open_ends(spark):
    for k in range(-2, 20):
        key = "lt6" if k < 6 else "ge14" if k >= 14 else f"{k}to{k + 1}"
        assert set(bands_of(spark, nu.bin_key(F.col("x")), [k, k + 0.25, math.nextafter(k + 1, 0)]).values()) == {key}


def test_rate_needs_a_positive_duration(spark):
    assert one(spark, nu.rate(F.lit(6), F.lit(2.0))) == 3.0
    with pytest.raises(Exception, match="duration must be positive"):
        one(spark, nu.rate(F.lit(6), F.lit(0.0)))


def test_rounding_is_half_to_even(spark):
    assert [one(spark, nu.stretched_length(F.lit(n), F.lit(2.0))) for n in (1, 3, 5, 7)] == [0, 2, 2, 4]


def test_outward_thresholds(spark):
    assert one(spark, nu.outward(F.lit(0.37), 0.1, ">=")) == pytest.approx(0.3)
    assert one(spark, nu.outward(F.lit(0.37), 0.1, "<=")) == pytest.approx(0.4)
    assert one(spark, nu.outward(F.lit(0.3), 0.1, ">=")) == pytest.approx(0.3)


def test_receptive_field(spark):
    got = one(spark, nu.receptive_field(F.col("k"), F.col("s"), F.col("d")), k=[3, 3, 3], s=[1, 2, 1], d=[1, 1, 2])
    assert got == 1 + 2 + 2 + 2 * 2 * 2


SMALL = "ャュョァィゥェォヮ"


def units_of(kana):
    out = []
    for i, c in enumerate(kana):
        if not ("ァ" <= c <= "ヺ" or c == "ー"):
            continue
        before = kana[i - 1] if i else ""
        joins = c in SMALL and before and ("ァ" <= before <= "ヺ" or before == "ー") and before not in SMALL
        if joins:
            out[-1] += c
        else:
            out.append(c)
    return out


def test_units_on_random_strings(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("アキシンッー" + SMALL + "aー。") for _ in range(rng.randrange(12))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "kana string").select("kana", tx.unit_count(F.col("kana")).alias("n"), tx.units(F.col("kana")).alias("u")).collect()
    for r in rows:
        assert r["u"] == units_of(r["kana"])
        assert r["n"] == len(r["u"])


def test_units_of_known_words(spark):
    for kana, n in (("キャット", 3), ("トーキョー", 4), ("ファイル", 3), ("ャ", 1), ("", 0), ("ンッー", 3)):
        assert one(spark, tx.unit_count(F.lit(kana))) == n


def test_nfkc_and_annotation(spark):
    assert one(spark, tx.nfkc(F.lit("１２３ｶﾞ①"))) == unicodedata.normalize("NFKC", "１２３ｶﾞ①")
    assert one(spark, tx.annotation(F.lit("とうきょう 7 タワー!"))) == "トウキョウタワー"


def test_byte_chunks_tile_the_text(spark):
    text = "あいう、えおかき。" * 40 + "x" * 300
    got = one(spark, tx.byte_chunks(F.lit(text), 50))
    assert "".join(got) == text
    assert max(len(c.encode()) for c in got) <= 50
    assert got[0].endswith(("、", "。"))


@pytest.mark.parametrize(("ref", "hyp", "rate"), [("", "", 0.0), ("", "a", 1.0), ("abc", "abc", 0.0), ("abcd", "abxd", 0.25), ("ab", "abcd", 1.0)])
def test_error_rate(spark, ref, hyp, rate):
    assert one(spark, tx.error_rate(F.col("r"), F.col("h")), r=ref, h=hyp) == rate


def test_collapse_and_distance(spark):
    assert one(spark, tx.collapsed(F.col("x"), 0), x=[0, 1, 1, 0, 1, 2, 2, 0, 0, 3]) == [1, 1, 2, 3]
    assert one(spark, tx.token_distance(F.col("a"), F.col("b")), a=["x", "y", "z"], b=["x", "z"]) == 1


def test_unit_tokens_and_vocabulary(spark):
    ids = {"き": 4, "や": 5, "|": 0}
    assert one(spark, tx.unit_tokens(F.lit("キャ"), ids, {"ゃ": "や"})) == [4, 5]
    assert one(spark, tx.unit_tokens(F.lit("ヌ"), ids, {})) is None
    assert one(spark, tx.in_vocabulary(F.lit("キャヌ|"), list(ids), {"ゃ": "や"})) == "きや"


def test_names(spark):
    assert one(spark, tx.stem(F.lit("a/b/item.part_1.mp3"))) == "item.part_1"
    assert one(spark, tx.condition_name(F.lit(2.0))) == "x2"
    assert one(spark, tx.noisy_name(F.lit("dev"), F.lit(5.0))) == "dev_snr5db"
    assert one(spark, tx.one_line(F.lit(" a\t b\n"))) == "a b"


def test_edits(spark):
    assert [(r["op"], r["gold"], r["estimate"]) for r in one(spark, tx.edits(F.lit("abcd"), F.lit("axcde")))] == [("replace", "b", "x"), ("insert", "", "e")]


def test_energy_of_a_burst(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1e-3, 16000)
    x[8000:12000] += 0.3 * np.sin(np.arange(4000) * 0.2)
    e = one(spark, ar.energy(F.col("x")), x=[float(v) for v in x[:3200]])
    assert e["abs_share"] == 0.0
    loud = one(spark, ar.energy(F.col("x")), x=[float(v) for v in x[7200:8800]])
    assert loud["abs_share"] == pytest.approx(0.4, abs=0.21)
    frames = (x[7200:8800].reshape(-1, 320) ** 2).mean(axis=1)
    assert loud["frame_p50"] == pytest.approx(float(np.percentile(10 * np.log10(frames + 1e-10), 50)), abs=1e-6)


def test_mixing_reaches_the_ratio_and_spares_silence(spark):
    x, n = [1.0, -1.0, 0.5, 0.2], [0.3, 0.3, -0.2, 0.9]
    y = np.array(one(spark, ar.mixed_at(F.col("x"), F.col("n"), F.lit(10.0)), x=x, n=n))
    assert 10 * math.log10(np.mean(np.square(x)) / np.mean((y - x) ** 2)) == pytest.approx(10.0)
    assert one(spark, ar.mixed_at(F.col("x"), F.col("n"), F.lit(10.0)), x=[0.0, 0.0, 0.0, 0.0], n=n) == [0.0] * 4


def test_thinned_crossings(spark):
    x = [-1.0, 1.0, -1.0, 1.0, -1.0, -1.0, 1.0]
    assert one(spark, ar.rising_crossings(F.col("x"), 1), x=x) == 3
    assert one(spark, ar.rising_crossings(F.col("x"), 3), x=x) == 2
    assert one(spark, ar.rising_crossings(F.col("x"), 1), x=[1.0]) == 0


def test_quantile_and_frames(spark):
    assert one(spark, ar.quantile(F.col("x"), 0.9), x=[4.0, 1.0, 3.0, 2.0]) == pytest.approx(3.7)
    assert one(spark, F.size(ar.frames(F.col("x"), 3)), x=[1.0] * 8) == 2
    assert one(spark, F.size(ar.frame_rms(F.col("x"), 4, 2)), x=[1.0] * 8) == 3


def test_log_mel_shape_and_tone():
    t = np.arange(16000) / 16000
    m = sg.log_mel(np.sin(2 * np.pi * 1000 * t))
    assert m.shape == (101, 80)
    centre = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + 8000 / 700), 82) / 2595) - 1)
    assert abs(centre[1:-1][m.mean(axis=0).argmax()] - 1000) < 60
    assert sg.mel_filters().shape == (201, 80)
    assert sg.log_mel(np.zeros(3)).shape[1] == 80


def test_log_mel_of_pcm_bytes(spark):
    x = (np.sin(np.arange(4000) * 0.3) * 20000).astype("<i2")
    df = spark.createDataFrame([(bytearray(x.tobytes()), [float(v) / 32768 for v in x]), (None, None)], "pcm binary, x array<float>")
    rows = df.select(sg.log_mel_pcm_udf()("pcm").alias("b"), sg.log_mel_udf()("x").alias("m")).collect()
    got = np.frombuffer(bytes(rows[0]["b"]), np.float16).reshape(-1, 80)
    assert got.shape == (26, 80)
    assert np.allclose(got, np.array(rows[0]["m"]), atol=0.02)
    assert (rows[1]["b"], rows[1]["m"]) == (None, None)


def test_band_pass_keeps_the_band():
    rate, t = 100.0, np.arange(1000) / 100
    inside, outside = sg.band_pass(np.sin(2 * np.pi * 5 * t), 2, 10, rate), sg.band_pass(np.sin(2 * np.pi * 30 * t), 2, 10, rate)
    assert np.abs(inside[200:800]).max() == pytest.approx(1, abs=0.1)
    assert np.abs(outside[200:800]).max() < 0.05


def test_resample_and_reverb():
    x = np.sin(2 * np.pi * 100 * np.arange(4800) / 48000)
    y = sg.resampled(x, 48000, 16000)
    assert y.size == 1600
    assert np.abs(y[100:1500] - np.sin(2 * np.pi * 100 * np.arange(1600) / 16000)[100:1500]).max() < 0.01
    assert sg.reverberated(x, np.array([0, 1.0])) == pytest.approx(x)


def test_peaks():
    x = np.array([0, 1, 0, 3, 0, 0.2, 0, 2, 0])
    assert sg.peak_count(x, 0.5, 1) == 3
    assert sg.peak_count(x, 0.1, 1) == 4
    assert sg.peak_count(x, 0.5, 4) == 2


def brute_paths(frames, tokens, blank, classes):
    import itertools

    for path in itertools.product(range(classes), repeat=frames):
        kept = [p for i, p in enumerate(path) if (i == 0 or p != path[i - 1]) and p != blank]
        if kept == list(tokens):
            yield path


def test_alignment_and_loss_against_all_paths():
    rng = np.random.default_rng(1)
    for tokens in ([1], [1, 1], [1, 2]):
        e = np.log(rng.dirichlet(np.ones(3), 5))
        scores = {p: sum(e[t, c] for t, c in enumerate(p)) for p in brute_paths(5, tokens, 0, 3)}
        assert tuple(sg.viterbi(e, tokens, 0)) == max(scores, key=scores.get)
        assert sg.ctc_loss(e, tokens, 0) == pytest.approx(-np.logaddexp.reduce(list(scores.values())))
    with pytest.raises(ValueError, match="2 frames for 3"):
        sg.viterbi(np.zeros((2, 3)), [1, 1], 0)
