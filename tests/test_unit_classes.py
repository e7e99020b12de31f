"""Classes of units, counted in one pass, against the units one by one."""

import random
import re

import duckdb
import pytest
from conftest import normal
from pyspark.sql import functions as F

from spanmill.functions import text as tx
from spanmill.plans import catalog

#: Readings with characters that are no kana, small ones at either end, and plain letters.
ODD = ["", "x", "ャ", "ャャ", "ーャ", "ーxャ", "ンッー", "カャャー", "キャンプー", "ヺァヴヵ・ー", "𠮷ーャ", "é漢ッ\x00ン", None]


def by_one(kana):
    if kana is None:
        return (None,) * 6
    u = re.findall(rf"(?![{tx.SMALL}])[{tx.KANA}][{tx.SMALL}]?|[{tx.SMALL}]", kana)
    marks = [u.count(m) for m in (tx.LONG_MARK, tx.NASAL, tx.GEMINATE)]
    return (*marks, sum(marks), sum(len(x) == 2 for x in u), len(u))


def test_classes_of_odd_readings(spark):
    draw = random.Random(5)
    made = ["".join(draw.choices("アカヺーンッャョァxé𠮷", k=draw.randrange(60))) for _ in range(300)]
    rows = list(enumerate([*ODD, *made]))
    got = spark.createDataFrame(rows, "i long, kana string").select("i", "kana", tx.special_counts(F.col("kana")).alias("c")).select("i", "kana", "c.*")
    assert sorted(tuple(r) for r in got.collect()) == [(i, k, *by_one(k)) for i, k in rows]


def test_pieces_of_a_batch_meet(spark):
    """Texts on both sides of a piece's end, and one longer than a piece."""
    texts = ["ta" * 300_000, "n", None, "t" * 1_000_000, "", "nt" * 700_000, "ah"] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").coalesce(1)
    got = df.select("i", tx.special_counts(F.col("t"), {"t": "ャ", "a": "ア", "n": "ー", "h": "ン"}).alias("c")).select("i", "c.*").collect()
    kana = [t if t is None else t.translate(str.maketrans("tanh", "ャアーン")) for t in texts]
    assert sorted(tuple(r) for r in got) == [(i, *by_one(k)) for i, k in enumerate(kana)]


@pytest.mark.parametrize("name", ["q_unit_classes", "q_special_shares"])
def test_texts_are_read_once_and_equal_their_sql(spark, tmp_path, name):
    texts = ["", "xyz", "t", "tt", "nxt", "n t", "hrd", "aeioutsnhrd" * 400, "ñandú 𠮷 tent", "q" * 5000 + "at", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_") + plan.count("RegExp") + plan.count("counts(") <= 1
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    columns = ", ".join(f'"{c}"' for c in df.columns)
    assert normal(df.collect()) == normal(con.execute(f"SELECT {columns} FROM ({catalog.ORACLES[name]})").fetchall())


def test_classes_one_by_one(spark):
    """What unit_class() says of each unit, added up, is what special_counts() gives."""
    rows = [(i, k) for i, k in enumerate(ODD) if k is not None]
    df = spark.createDataFrame(rows, "i long, kana string")
    flags = df.select("i", F.explode_outer(tx.units(F.col("kana"))).alias("u")).select("i", tx.unit_class(F.col("u")).alias("f"))
    names = ("long", "nasal", "geminate", "special", "contracted")
    added = flags.groupBy("i").agg(*(F.coalesce(F.sum(F.col(f"f.{n}").cast("long")), F.lit(0)).alias(n) for n in names))
    counted = df.select("i", tx.special_counts(F.col("kana")).alias("c")).select("i", *(f"c.{n}" for n in names))
    assert sorted(map(tuple, added.collect())) == sorted(map(tuple, counted.collect()))
