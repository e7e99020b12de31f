"""Token attribution, language identification, media: maps over rows."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from conftest import DATA
from llm_cases import LONG, PROSE, ROWS, edge_docs, empty_docs

from spanmill.llm import attribution, language, media, queries


def brute_sections(text, rule):
    """Tokens of each line, and those that begin in it and end in a later one, token by token."""
    encoder, _ = attribution._encoder(attribution.VOCABULARY, attribution.PATTERN)
    raw = (text or "").encode()
    lines = (text or "").splitlines(keepends=True) if not set(text or "") & set("\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029") else [x + "\n" for x in text.split("\n")[:-1]] + [text.split("\n")[-1]] * bool(text.split("\n")[-1])
    owner = [i for i, x in enumerate(lines) for _ in x.encode()]
    counts, crossing, at = [0.0] * max(1, len(lines)), [0] * max(1, len(lines)), 0
    for token in encoder.encode_ordinary(text or ""):
        own = owner[at : at + len(encoder.decode_single_token_bytes(token))]
        at += len(own)
        crossing[own[0]] += own[-1] > own[0]
        if rule == "first":
            counts[own[0]] += 1
        elif rule == "most":
            counts[max(sorted(set(own)), key=lambda s: (own.count(s), -s))] += 1
        else:
            for s in set(own):
                counts[s] += own.count(s) / len(own)
    assert at == len(raw)
    return counts, crossing


@pytest.mark.parametrize("rule", attribution.RULES)
def test_sections_against_brute_force(spark, rule):
    texts = ["a\n\n\n  b", "", None, "one line", "ends\n", "\n", "x\n\n\n\ny é😀\n漢字\n", PROSE + "\n\n" + PROSE]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = attribution.section_tokens(docs, rule).orderBy("doc_id", "section").collect()
    for i, text in enumerate(texts):
        mine = [r for r in got if r["doc_id"] == i]
        counts, crossing = brute_sections(text, rule)
        assert [r["tokens"] for r in mine] == pytest.approx(counts)
        assert [r["crossing"] for r in mine] == crossing
        assert sum(r["tokens"] for r in mine) == pytest.approx(mine[0]["doc_tokens"])
        assert [mine[0]["start"], mine[-1]["end"]] == [0, len(text or "")]
        assert all(a["end"] == b["start"] for a, b in zip(mine, mine[1:], strict=False))


def test_long_runs_of_white_space_are_encoded_as_the_pattern_splits_them(spark):
    encoder, sizes = attribution._encoder(attribution.VOCABULARY, attribution.PATTERN)
    rng = np.random.default_rng(6)
    for _ in range(60):
        parts = [rng.choice([" ", "\n", "\t", "\u3000", " \n"]) * int(rng.choice([1, 2, 999, 1000, 1001, 3000])) + str(rng.choice(["x", "9", "!", "'s", "é", ""])) for _ in range(4)]
        text = str(rng.choice(["", "a", "7"])) + "".join(parts)
        assert attribution.token_ids(encoder, text, attribution.PATTERN) == encoder.encode_ordinary(text)
    texts = [" " * 1_000_000 + "x", "\n" * 1_000_000 + " x", "x" * 2_000_000, "1" * 2_000_000, "!" * 2_000_000, " " * 1_500_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = attribution.section_tokens(docs).groupBy("doc_id").agg({"tokens": "sum", "end": "max", "doc_tokens": "max"}).collect()
    assert {r["doc_id"]: r["max(end)"] for r in got} == {i: len(t) for i, t in enumerate(texts)}
    assert all(r["sum(tokens)"] == r["max(doc_tokens)"] > 0 for r in got)


def test_attribution_of_awkward_and_empty_tables(spark):
    got = attribution.section_tokens(edge_docs(spark)).collect()
    assert len({r["doc_id"] for r in got}) == 15
    assert attribution.section_tokens(empty_docs(spark)).count() == 0
    with pytest.raises(ValueError, match="rule"):
        attribution.section_tokens(edge_docs(spark), "other")


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    got = queries.op2_bloom_language(spark, f"{DATA}/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) >= 0.98


def test_language_of_awkward_rows(spark):
    got = {(r["doc_id"], r["lang_pred"]) for r in language.identify(spark, edge_docs(spark)).collect()}
    assert {(4, "und"), (5, "und"), (6, "und"), (12, "und"), (None, "und")} <= got
    assert {lang for i, lang in got if i in (1, 3, 9)} == {"en"}
    assert language.identify(spark, empty_docs(spark)).count() == 0
    unlabelled = edge_docs(spark).selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r["lang_pred"] for r in language.identify(spark, unlabelled).collect()} == {"und"}
    assert language.keep_identified(spark, edge_docs(spark).where("lang is null")).count() == 0


def test_kept_rows_keep_their_columns(spark):
    docs = edge_docs(spark)
    kept = language.keep_identified(spark, docs)
    assert kept.columns == docs.columns
    assert not kept.where("doc_id in (4, 5, 6, 12)").count()
    assert kept.where("doc_id in (1, 2, 3, 9, 10)").count() == 6


def test_false_positive_correction():
    rng = np.random.default_rng(0)
    sets = {x: rng.integers(0, 1 << 63, 200_000).astype(np.uint64) for x in ("aa", "bb")}
    filters = language.build_filters(sets)
    foreign = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    langs, score = language.decide(filters, np.concatenate([sets["bb"][:500], foreign[:500]]), np.array([0, 1000]), np.array([True]))
    assert langs == ["bb"]
    assert score[0] == pytest.approx(0.5, abs=0.03)
    many = language.build_filters({f"l{i:02}": sets["aa"][i : i + 1] for i in range(65)})
    assert len(many.words) == 2
    assert language.decide(many, sets["aa"][64:65], np.array([0, 1]), np.array([True]))[0] == ["l64"]


def pictures():
    rng = np.random.default_rng(1)
    return [rng.integers(0, 256, (h, w)).astype(np.uint8) for h, w in ((1, 576), (7, 576), (40, 33), (3, 1))]


def test_png_round_trip_and_chunk_tests():
    for p in pictures():
        png = media.write_png(p)
        assert (media.read_png(png) == p).all()
        for at in (3, 20, 45, len(png) - 6):
            bad = bytearray(png)
            bad[at] ^= 1
            with pytest.raises(media.BadPicture):
                media.read_png(bytes(bad))
        with pytest.raises(media.BadPicture):
            media.read_png(png[:-12])


def test_all_five_filters_and_colour():
    rng = np.random.default_rng(2)
    want = rng.integers(0, 256, (5, 12)).astype(np.uint8)
    raw = b""
    for y in range(5):
        line = bytearray([y])
        for x in range(12):
            a = int(want[y, x - 3]) if x >= 3 else 0
            b = int(want[y - 1, x]) if y else 0
            c = int(want[y - 1, x - 3]) if y and x >= 3 else 0
            near = min((a, b, c), key=lambda v: (abs(a + b - c - v), (a, b, c).index(v)))
            line.append((int(want[y, x]) - (0, a, b, (a + b) // 2, near)[y]) & 255)
        raw += bytes(line)
    header = struct.pack(">IIBBBBB", 4, 5, 8, media.RGB, 0, 0, 0)
    png = media.SIGNATURE + media._chunk(b"IHDR", header) + media._chunk(b"IDAT", zlib.compress(raw)[:9]) + media._chunk(b"IDAT", zlib.compress(raw)[9:]) + media._chunk(b"IEND", b"")
    assert (media.read_png(png) == want).all()


def test_media_digests_against_the_contract(spark):
    got = media.media_digests(media.encode_media(edge_docs(spark))).collect()
    assert len(got) == len(ROWS)
    want = {}
    for r in ROWS:
        raw = (r[1] or "").encode()
        load = raw + b"\xff" * (-len(raw) % 576 or (576 if not raw else 0))
        want.setdefault(r[0], set()).add((len(raw), len(load), hashlib.sha256(load).hexdigest(), zlib.crc32(load[-32:])))
    for r in got:
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) in want[r["doc_id"]]
    decoded = media.decode_media(media.encode_media(edge_docs(spark).where("doc_id = 9"))).first()
    assert bytes(decoded["payload"]).rstrip(b"\xff").decode() == LONG
    assert len(decoded["hash"]) == 8
    assert media.media_digests(media.encode_media(empty_docs(spark))).count() == 0


def test_hash_is_alike_for_alike_pictures():
    rng = np.random.default_rng(3)
    smooth = np.kron(rng.integers(0, 256, (8, 8)), np.ones((8, 72))).astype(np.uint8)
    noisy = smooth.astype(int) + rng.integers(-9, 10, smooth.shape)
    a, b = (int.from_bytes(media.cosine_hash(np.clip(p, 0, 255).astype(np.uint8)), "big") for p in (smooth, noisy))
    c = int.from_bytes(media.cosine_hash(smooth[::-1].copy()), "big")
    assert (a ^ b).bit_count() <= 6 < 16 < (a ^ c).bit_count()
