"""Rooms' responses against their formula, and figures of many rooms in the memory of one."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanmill.functions import waveforms as wf
from spanmill.plans import catalog

ROOM = ((5.0, 4.0, 3.0), (1.0, 2.0, 1.5), (3.3, 1.2, 1.7), 0.4)
#: A delay of 16 samples exactly, so a fraction of 0; source and microphone at one place; a time that no wall allows.
ODD = [((5.0, 4.0, 3.0), (1.0, 2.0, 1.5), (1.0 + wf.SOUND / 1000, 2.0, 1.5), 0.4), ((5.0, 4.0, 3.0), (1.0, 2.0, 1.5), (1.0, 2.0, 1.5), 0.3), ((10.0, 10.0, 4.0), (1.0, 1.0, 1.0), (2.0, 2.0, 2.0), 0.1)]


def plain(size, source, mic, rt60, rate=16000, most_order=12):
    """An image at a time, each tap by its formula."""
    found = wf.sabine(size, rt60)
    if found is None:
        return np.ones(1)
    order, taps, out = min(found[1], most_order), np.arange(1 - wf.REACH, wf.REACH + 1), np.zeros(100_000)
    last = 0
    for x in range(-order, order + 1):
        for y in range(abs(x) - order, order - abs(x) + 1):
            for z in range(abs(x) + abs(y) - order, order - abs(x) - abs(y) + 1):
                image = [n * v + (s if n % 2 == 0 else v - s) for n, v, s in zip((x, y, z), size, source, strict=True)]
                far = max(np.linalg.norm(np.subtract(image, mic)), 1e-3)
                whole = int(far / wf.SOUND * rate)
                t = taps - (far / wf.SOUND * rate - whole)
                out[whole + taps + wf.REACH] += (1 - found[0]) ** ((abs(x) + abs(y) + abs(z)) / 2) / (4 * np.pi * far) * np.sinc(t) * (0.5 + 0.5 * np.cos(np.pi * t / wf.REACH))
                last = max(last, whole + 2 * wf.REACH)
    return out[: last + 1] / np.abs(out).max()


@pytest.mark.parametrize("room", [ROOM, *ODD])
@pytest.mark.parametrize("order", [0, 1, 5, 12])
def test_responses_by_their_formula(room, order):
    got, want = wf.room_response(*room, most_order=order), plain(*room, most_order=order)
    assert got.size == want.size
    assert np.abs(got - want).max() < 1e-12


def test_figures_of_many_rooms_hold_one_response():
    rooms = [ROOM] * 200
    columns = [pa.array([r[k] for r in rooms]) for k in range(4)]
    run, one = wf.room_figures_udf().func, wf.room_response(*ROOM)
    run(*(c.slice(0, 1) for c in columns))
    tracemalloc.start()
    got = run(*columns)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == [{"samples": one.size, "loudest": int(one.argmax()), "power": float(np.mean(one * one))}] * 200
    assert peak < 200 * one.nbytes / 2


def test_figures_are_those_of_the_responses(spark):
    rooms = [*map(list, [ROOM, *ODD]), [None, *ROOM[1:]], [*ROOM[:3], None], [*ROOM[:3], float("nan")]]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rooms)], "i long, size array<double>, source array<double>, mic array<double>, t double")
    h = df.select("i", wf.room_response_udf()("size", "source", "mic", "t").alias("h"), wf.room_figures_udf()("size", "source", "mic", "t").alias("f"))
    for r in h.orderBy("i").collect():
        assert (r["h"] is None) == (r["f"] is None) == (r["i"] >= 4)
        if r["h"]:
            assert (r["f"]["samples"], r["f"]["loudest"]) == (len(r["h"]), int(np.argmax(r["h"])))
            assert r["f"]["power"] == pytest.approx(np.mean(np.square(r["h"])), rel=1e-12)


def test_one_file_of_ids_goes_to_many_tasks(spark, tmp_path):
    spark.range(300).select(F.col("id").alias("vec_id"), F.array(F.lit(0.5).cast("float")).alias("embedding"), F.lit(1).alias("label")).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    df = catalog.QUERIES["q_room_responses"](spark, str(tmp_path))
    assert dict(df.dtypes) == {"vec_id": "bigint", "rt60": "double", "samples": "int", "loudest": "bigint", "power": "double"}
    rows = df.select("*", F.spark_partition_id().alias("task")).collect()
    assert sorted(r["vec_id"] for r in rows) == list(range(300))
    assert len({r["task"] for r in rows}) >= 8
