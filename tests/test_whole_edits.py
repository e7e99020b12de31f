"""Edits of whole texts against difflib, text by text."""

import difflib
import random

from spanmill.functions import text as tx
from spanmill.plans import catalog


def brute(a, b):
    found = difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    return [(op, a[i:j], b[k:m]) for op, i, j, k, m in found if op != "equal"]


def test_blocks_are_those_of_difflib():
    rng = random.Random(3)
    for _ in range(800):
        letters = rng.choice(["ab", "abcx", "abcdefghijklmé𝒳"])
        a = "".join(rng.choices(letters, k=rng.randrange(70)))
        b = rng.choice([a.translate(str.maketrans("abe", "xcz")), a[9:] + a[:30], "".join(rng.choices(letters, k=rng.randrange(70)))])
        found = [x for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if x.size]
        merged = []
        for i, j, n in tx.matching_blocks(a, b):
            if merged and merged[-1][0] + merged[-1][2] == i and merged[-1][1] + merged[-1][2] == j:
                i, j, n = merged[-1][0], merged[-1][1], merged.pop()[2] + n
            merged.append((i, j, n))
        assert merged == [tuple(x) for x in found]


def test_nfkc_query_finds_the_edits_of_whole_texts(spark, tmp_path):
    rng = random.Random(4)
    texts = ["", "b" * 900, "z" * 40 + "aei b" * 30, "".join(rng.choices("abcdefghi xyz", k=700)), "q" * 5000 + "a" + "q" * 5000]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["edits"] for r in catalog.QUERIES["q_nfkc"](spark, str(tmp_path)).collect()}
    short = {i: t for i, t in enumerate(texts) if len(t) < 1000}
    assert {i: got[i] for i in short} == {i: len(brute(t, t.translate(str.maketrans("aei", "xyz")))) for i, t in short.items()}
    assert got[4] == 1


def test_edits_of_many_rows_and_nulls(spark):
    rows = [(i, None if i % 7 == 0 else "aei b" * (i % 9), None if i % 11 == 0 else "xei c" * (i % 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, a string, b string").coalesce(1)
    got = {r["i"]: r["e"] and [tuple(x) for x in r["e"]] for r in df.select("i", tx.edits("a", "b").alias("e")).collect()}
    assert got == {i: None if a is None or b is None else brute(a, b) for i, a, b in rows}
