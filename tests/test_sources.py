"""Readers and writers on small files."""

import json
import wave
from dataclasses import dataclass

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanmill.operators.catalog import Violation
from spanmill.sources import readers, schemas, writers


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_transcripts_keep_quotes_and_find_columns_by_name(spark, tmp_path):
    p = put(tmp_path / "t.tsv", 'path\tclient_id\tsentence\tup_votes\tdown_votes\na.mp3\tc\tsay "hi\t2\t0\n')
    r = readers.transcripts(spark, p).first()
    assert (r["client_id"], r["path"], r["sentence"]) == ("c", "a.mp3", 'say "hi')


def test_durations_skip_bad_rows(spark, tmp_path):
    p = put(tmp_path / "d.tsv", "clip\tduration[ms]\na.mp3\t1500\nb.mp3\tx\nc.mp3\n")
    assert [(r["path"], r["duration"]) for r in readers.durations(spark, p).collect()] == [("a.mp3", 1.5)]


def test_json_lines(spark, tmp_path):
    good = put(tmp_path / "a.jsonl", '{"item_id":"a","ok":true}\n\n{"item_id":"b","ok":false}\n')
    assert readers.alignments(spark, good).count() == 2
    twice = put(tmp_path / "b.jsonl", '{"item_id":"a"}\n{"item_id":"a"}\n')
    with pytest.raises(Violation):
        readers.alignments(spark, twice)
    cut = put(tmp_path / "c.jsonl", '{"item_id":"a","ok":true}\n{"item_id":"b","o')
    assert readers.alignments(spark, cut, tolerant=True).count() == 1
    with pytest.raises(Exception, match="MALFORMED"):
        readers.alignments(spark, cut).count()


def test_id_lists(spark, tmp_path):
    p = put(tmp_path / "k.tsv", "# a note\nclip_id\twhy\nx\t1\n# more\ny\t2\nx\t3\n")
    assert sorted(r[0] for r in readers.commented_ids(spark, p).collect()) == ["x", "y"]
    assert readers.id_list(spark, put(tmp_path / "l.txt", "a\n\nb\n")).count() == 2
    with pytest.raises(Violation):
        readers.id_list(spark, put(tmp_path / "m.txt", "a\na\n"))


def test_keyed_text_and_sentences(spark, tmp_path):
    p = put(tmp_path / "s.txt", "a1:x:y\na2:z\n")
    assert sorted(tuple(r) for r in readers.keyed_text(spark, p).collect()) == [("a1", "x:y"), ("a2", "z")]
    with pytest.raises(Violation):
        readers.keyed_text(spark, put(tmp_path / "u.txt", "none\n"))
    p = put(tmp_path / "v.txt", "one\n\ntwo\n")
    assert sorted(tuple(r) for r in readers.sentences(spark, p).collect()) == [("001", "one"), ("003", "two")]


def test_split_guard(spark, tmp_path):
    for name in ("dev", "test"):
        put(tmp_path / f"{name}.json", json.dumps({"split": name, "unit": "speaker", "seed": 1, "client_ids": ["c1", "c2"]}, indent=1))
    assert readers.split_ids(spark, str(tmp_path / "dev.json")).count() == 2
    with pytest.raises(readers.HeldOut):
        readers.split_ids(spark, str(tmp_path / "test.json"))
    assert readers.split_ids(spark, str(tmp_path / "test.json"), allow_held_out=True).count() == 2


def test_waveforms_and_listing(spark, tmp_path):
    folder = tmp_path / "noise" / "free"
    folder.mkdir(parents=True)
    with wave.open(str(folder / "n.wav"), "wb") as f:
        f.setnchannels(2)
        f.setsampwidth(2)
        f.setframerate(8000)
        f.writeframes((np.full((800, 2), 0.5) * 32768).astype("<i2").tobytes())
    r = readers.waveforms(spark, str(folder / "n.wav")).first()
    assert len(r["samples"]) == 1600
    assert r["samples"][800] == pytest.approx(0.5, abs=0.01)
    assert [tuple(x) for x in readers.grouped_files(spark, str(tmp_path / "noise")).collect()] == [("free", "free/n.wav")]
    assert readers.folder_size(spark, str(tmp_path / "noise")).first()["files"] == 1


def test_yaml_config_counts(spark, tmp_path):
    assert sorted(tuple(r) for r in readers.yaml_map(spark, "a: {kana: x, n: 1}\nb: {kana: y}\n").collect()) == [("a", "kana", "x"), ("a", "n", "1"), ("b", "kana", "y")]

    @dataclass(frozen=True)
    class Config:
        size: float = 2.0

    assert readers.configured(Config, {"size": 1.0}).size == 1.0
    with pytest.raises(ValueError, match="unknown settings"):
        readers.configured(Config, {"sice": 1.0})
    assert readers.file_counts(spark, put(tmp_path / "c.txt", "ab\ncd\n")).first()["records"] == 2
    p = put(tmp_path / "m.csv", "experiment_id,latency_session_id\na,s1\nb,\n")
    assert readers.measured_rows(spark, p).count() == 1


def test_resumed_append(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "item_id string, n int")
    writers.append_json(spark, rows.where("item_id = 'a'"), path, "item_id")
    writers.append_json(spark, rows, path, "item_id")
    assert sorted(r["item_id"] for r in spark.read.json(path).collect()) == ["a", "b"]
    writers.two_outputs(spark, rows, (str(tmp_path / "x"), ["item_id"]), (str(tmp_path / "y"), ["item_id", "n"]), "item_id")
    assert spark.read.json(str(tmp_path / "y")).count() == 2


def test_documents_windows_features(spark, tmp_path):
    split = spark.createDataFrame([("c2", "train"), ("c1", "train"), ("c3", "dev")], "client_id string, split string")
    writers.split_documents(split, str(tmp_path / "splits"))
    got = {r["split"]: r["client_ids"] for r in spark.read.json(str(tmp_path / "splits")).collect()}
    assert got == {"train": ["c1", "c2"], "dev": ["c3"]}
    windows = spark.createDataFrame([("s", 0, 0, 1.5, "single", False)], schemas.WINDOW)
    writers.window_set(windows, windows.select("source_id"), str(tmp_path / "set"))
    assert readers.window_set(spark, str(tmp_path / "set")).count() == 1
    feats = spark.createDataFrame([("b", 2, [[1.0], [2.0]]), ("a", 1, [[3.0]]), ("c", 0, None)], schemas.FEATURE)
    writers.feature_shards(feats, str(tmp_path / "f"), 2, str(tmp_path / "bad"))
    assert [r["item_id"] for r in readers.features(spark, str(tmp_path / "f"), low=1, limit=1).collect()] == ["a"]
    assert spark.read.json(str(tmp_path / "bad")).count() == 1
    total = writers.manifest(feats.withColumn("split", F.lit("train"))).first()
    assert (total["items"], total["frames"], total["first"]) == (3, 3, "a")
    writers.error_table(spark.createDataFrame([(1, "a\tb", 0.25)], "rank int, s string, e double"), str(tmp_path / "e"), ["s"], ["e"])
    assert spark.read.csv(str(tmp_path / "e"), sep="\t", header=True).first()["e"] == "0.250"
