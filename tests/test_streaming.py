"""Live operators; streams must equal their batch twins."""

import random

import pytest
from pyspark.sql import functions as F

from spanmill.streaming import pace


def test_pace_skips_silence_and_has_an_open_lower_end(spark):
    rows = spark.createDataFrame([("u", 0.0, 10.0), ("u", 5.0, 1.0), ("u", 15.0, 6.0)], "u string, t double, c double")
    got = pace.rolling_pace(rows, ["u"], "t", "c").orderBy("t").collect()
    assert [r["rate"] for r in got] == [5.0, None, 3.0]
    assert [r["pace"] for r in got] == [5.0, 5.0, 3.0]


def test_scheduler_skips_while_busy(spark):
    rows = spark.createDataFrame([("u", i, t, b) for i, (t, b) in enumerate([(50, False), (100, False), (130, False), (160, True), (165, False), (170, False)])], "u string, i int, total int, busy boolean")
    got = pace.scheduled(rows, ["u"], ["i"], "total", F.col("busy"), 100, 10).orderBy("i").collect()
    assert [r["run"] for r in got] == [False, True, True, False, False, True]
    assert [r["skipped"] for r in got] == [0, 0, 2, 3, 0, 0]
    assert [r["window_end"] for r in got] == [None, 100, 130, None, None, 170]


def test_history_keeps_the_point_before_the_range(spark):
    rows = spark.createDataFrame([(float(t),) for t in (1, 2, 5, 8)], "t double")
    assert sorted(r["t"] for r in pace.pruned(rows, [], "t", F.lit(9.0), 5.0).collect()) == [2.0, 5.0, 8.0]


def test_axis_timer_duration(spark):
    rows = spark.createDataFrame([(3.0,), (11.2,), (float("nan"),)], "v double")
    assert pace.axis_top(rows, "v").first()[0] == 12
    left = {1: "0:01", 1000: "0:01", 119_001: "2:00", 60_001: "1:01", 59_999: "1:00", -999: "0:00", -61_999: "+1:01", 3_600_000: "60:00"}
    got = spark.createDataFrame([(m,) for m in left], "m long").select("m", pace.time_left(F.col("m")).alias("t")).collect()
    assert {r["m"]: r["t"]["text"] for r in got} == left
    assert {r["m"] for r in got if r["t"]["level"] == "over"} == {-999, -61_999}
    assert {r["m"] for r in got if r["t"]["level"] == "normal"} == {119_001, 60_001, 3_600_000}
    entries = {"12": 720_000, "0:07": 7_000, "180": 10_800_000, "180:01": None, "0": None, "3:60": None, "1:2:3": None, "": None, " 9:5": 545_000, "0012": None}
    parsed = spark.createDataFrame([(x,) for x in entries], "s string").select("s", pace.settable_ms(F.col("s")).alias("ms")).collect()
    assert {r["s"]: r["ms"] for r in parsed} == entries


def test_countdown_follows_a_plain_timer(spark):
    rng = random.Random(5)
    rows, want = [], []
    for key in range(4):
        running, spent, total, now = False, 0, None, 0
        for i in range(60):
            step = rng.randrange(1, 5_000)
            now, spent = now + step, spent + step * running
            act, ms = rng.choice(["start", "pause", "toggle", "reset", "set", "look"]), rng.randrange(10_000)
            running = {"start": True, "toggle": not running, "look": running}.get(act, False)
            if act in ("reset", "set"):
                spent, total = 0, ms if act == "set" else total
            rows.append((key, i, now, act, ms))
            want.append((key, i, running, None if total is None else total - spent))
    df = spark.createDataFrame(rows, "k int, i int, at long, act string, ms long")
    got = pace.countdown(df, ["k"], "at", "act", ["i"], "ms").select("k", "i", "running", "left").collect()
    assert sorted(map(tuple, got)) == want


def test_latest_window_is_complete(spark):
    rows = spark.createDataFrame([("a", i, float(i)) for i in range(6)] + [("b", i, 0.0) for i in (0, 1, 3)], "k string, pos long, sample double")
    got = pace.latest_window(rows, ["k"], "pos", 4, 5).collect()
    assert [(r["k"], r["end"], r["window"]) for r in got] == [("a", 6, [2.0, 3.0, 4.0, 5.0])]


def test_stream_equals_batch_over_several_micro_batches(spark, tmp_path):
    rows = [(f"u{u}", float(t), float((t * 7 + u) % 9)) for u in range(3) for t in range(0, 60, 3)]
    schema = "u string, t double, c double"
    for part in range(4):
        chunk = [r for r in rows if part * 15 <= r[1] < part * 15 + 15]
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r["u"], r["t"]): r["pace"] for r in drained(spark, pace.stream_pace(stream, "u", "t", "c"), "pace")}
    batch = pace.rolling_pace(spark.createDataFrame(rows, schema), ["u"], "t", "c").collect()
    for r in batch:
        g = got[(r["u"], r["t"])]
        assert (g is None or g != g) if r["pace"] is None else g == pytest.approx(r["pace"])


def drained(spark, stream, name):
    stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).collect()


def in_batches(spark, at, batches, schema):
    """A stream of one micro-batch for each of the lists of rows."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(at))


def test_late_points_are_averaged_within_their_bound(spark, tmp_path):
    schema = "u string, t double, c double"
    stream = in_batches(spark, tmp_path, [[("a", 10.0, 4.0), ("a", 20.0, 8.0)], [("a", 18.0, 6.0), ("a", 2.0, 6.0), ("a", 21.0, 2.0)]], schema)
    got = {r["t"]: r["pace"] for r in drained(spark, pace.stream_pace(stream, "u", "t", "c", late=5.0), "late")}
    assert got[18.0] == pytest.approx((2 + 3) / 2)
    assert got[21.0] == pytest.approx((2 + 4 + 3 + 1) / 4)
    assert got[2.0] is None or got[2.0] != got[2.0]


def test_scheduled_stream_equals_its_batch(spark, tmp_path):
    rng = random.Random(6)
    rows = [(f"u{u}", t, 7 * t, rng.random() < 0.3) for u in range(3) for t in range(40)]
    schema = "u string, t long, total long, busy boolean"
    stream = in_batches(spark, tmp_path, [[r for r in rows if r[1] // 10 == k] for k in range(4)], schema)
    got = {(r["u"], r["t"]): (r["tick"], r["run"], r["skipped"], r["window_end"]) for r in drained(spark, pace.stream_scheduled(stream, "u", "t", "total", "busy", 50, 20), "sched")}
    batch = pace.scheduled(spark.createDataFrame(rows, schema), ["u"], ["t"], "total", F.col("busy"), 50, 20).collect()
    assert got == {(r["u"], r["t"]): (r["tick"], r["run"], r["skipped"], r["window_end"]) for r in batch}


def test_ring_stream_gives_the_newest_complete_window(spark, tmp_path):
    schema = "k string, pos long, sample double"
    stream = in_batches(spark, tmp_path, [[("a", i, float(i)) for i in range(3)], [("a", i, float(i)) for i in (3, 4)] + [("b", 0, 0.0)], [("b", i, 0.0) for i in (1, 3, 4)]], schema)
    got = [(r["k"], r["end"], r["window"]) for r in drained(spark, pace.stream_ring(stream, "k", "pos", "sample", 4, 6), "ring")]
    assert got == [("a", 5, [1.0, 2.0, 3.0, 4.0])]


def test_watermarked_counts_and_sessions(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:00:30", "a"), ("2024-01-01 00:03:30", "a"), ("2024-01-01 01:00:00", "a")], "s string, k string").select(F.to_timestamp("s").alias("ts"), "k")
    rows.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e"))
    for i, df in enumerate((pace.stream_counts(stream, "ts", "k"), pace.stream_sessions(stream, "ts", "k"))):
        q = df.writeStream.format("memory").queryName(f"wm{i}").outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("wm0").agg(F.max("n")).first()[0] == 2
    assert sorted(r["n"] for r in spark.table("wm1").collect()) == [1, 2]
