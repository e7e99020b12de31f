"""Language identification against a plain version on sets, with few languages and with more than a word holds."""

import re
import zlib
from collections import defaultdict

import pytest
from conftest import DATA

from spanmill.llm import language


def sets_of(text):
    """4-grams, as strings, of letters and single gaps, framed by a gap before and two behind."""
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text) if text else ""
    joined = " " + re.sub(r" +", " ", "".join(c if c.isalpha() else " " for c in low)).strip() + "  "
    return [joined[i : i + 4] for i in range(len(joined) - 3)] if joined.strip() else []


def plain(rows):
    """doc_id -> (language, share of its n-grams in the language's set), ties by name."""
    known = defaultdict(set)
    for i, text, lang in rows:
        if i is not None and lang is not None and text is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            known[lang].update(sets_of(text))
    out = {}
    for i, text, _ in rows:
        g = sets_of(text)
        shares = {x: sum(y in s for y in g) / len(g) for x, s in sorted(known.items())} if g else {}
        out[i] = shares if any(c.isalpha() for c in text or "") else None
    return out


def check(spark, rows, sure=0.95):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(spark, docs).collect()}
    want, clear = plain(rows), 0
    assert got.keys() == want.keys()
    for i, shares in want.items():
        if shares is None:
            assert got[i] == ("und", 0.0)
            continue
        lang, score = got[i]
        # The correction leaves the noise of false positives: a share of 1/8 or so, squared, of the n-grams.
        assert score == pytest.approx(max(shares.values()), abs=0.12)
        assert shares[lang] >= max(shares.values()) - 0.12
        clear += lang == max(shares, key=shares.get)
    assert clear >= sure * sum(s is not None for s in want.values())


def test_small_table_against_sets(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text", "lang").collect()
    check(spark, [tuple(r) for r in docs], 0.99)


def test_more_languages_than_a_word_holds(spark):
    """130 invented languages of their own letters: three words a slot."""
    texts = [(i, " ".join(chr(0x4E00 + 60 * i + k) * 4 + chr(0x4E00 + 60 * i + k + 1) for k in range(40)), f"x{i:03}") for i in range(130)]
    ids = [i for i in range(10_000) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(ids[i], t, x) for i, t, x in texts] + [(20_000 + i, t, None) for i, t, _ in texts] + [(30_000, None, "x001"), (30_001, "1 2 3", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(spark, docs).collect()}
    assert got == {**{ids[i]: x for i, _, x in texts}, **{20_000 + i: x for i, _, x in texts}, 30_000: "und", 30_001: "und"}
    assert language.keep_identified(spark, docs).count() == 260
def test_seventy_languages_are_told_apart(spark):
    def text(k, i):
        letters = [chr(0x4E00 + 40 * k + x) for x in range(40)]
        return "".join(letters[(i * 7 + 3 * x) % 40] for x in range(60))

    docs = spark.createDataFrame([(k * 40 + i, text(k, i), f"l{k:02}") for k in range(70) for i in range(40)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(spark, docs).collect()}
    assert got == {k * 40 + i: f"l{k:02}" for k in range(70) for i in range(40)}
    assert language.keep_identified(spark, docs).count() == docs.count()
