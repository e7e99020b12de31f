"""The kana queries read whole texts: brute force on made documents, and their oracles without the cut on given ones."""

import re

import pytest
from conftest import DATA, normal, oracle

from spanmill.plans import catalog
from spanmill.plans.texts import LETTERS, READING

SF = "sf0.001"
NAMES = ("q_unit_counts", "q_unit_split", "q_unit_classes", "q_special_shares")


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("name", NAMES)
def test_kana_queries_match_their_oracles_without_the_cut(spark, con, name):
    df = catalog.QUERIES[name](spark, f"{DATA}/{SF}")
    columns = ", ".join(f'"{c}"' for c in df.columns)
    sql = catalog.ORACLES[name].replace("left(text, 400)", "text")
    assert normal(df.collect()) == normal(con.execute(f"SELECT {columns} FROM ({sql})").fetchall())


def test_units_behind_character_400_count(spark, tmp_path):
    texts = {1: "x" * 500 + "aunhrd" * 3, 2: "ai", 3: "z" * 400, 4: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    kana = {i: "".join(READING[LETTERS.index(c)] for c in t or "" if c in LETTERS) for i, t in texts.items()}
    units = {i: re.findall("[アイウエオーンッ][ャュョ]?|[ャュョ]", k) for i, k in kana.items()}
    got = {r["doc_id"]: r["units"] for r in catalog.QUERIES["q_unit_counts"](spark, str(tmp_path)).collect()}
    assert {i: n or 0 for i, n in got.items()} == {i: len(u) for i, u in units.items()}
    n = {r["unit"]: r["n"] for r in catalog.QUERIES["q_unit_split"](spark, str(tmp_path)).collect()}
    flat = [u for us in units.values() for u in us]
    assert n == {u: flat.count(u) for u in flat}
    special = {r["doc_id"]: r["special"] or 0 for r in catalog.QUERIES["q_unit_classes"](spark, str(tmp_path)).collect()}
    assert special == {i: sum(u in ("ー", "ン", "ッ") for u in us) for i, us in units.items()}
