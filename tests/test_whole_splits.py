"""Split summaries and overlaps over whole tables, against their oracles without the filters."""

from conftest import DATA, normal, oracle

from spanmill.plans import catalog

SF = "sf0.001"


def check(spark, name, cut):
    df = catalog.QUERIES[name](spark, f"{DATA}/{SF}")
    columns = ", ".join(f'"{c}"' for c in df.columns)
    sql = catalog.ORACLES[name].replace(cut, "")
    got = df.collect()
    assert normal(got) == normal(oracle(SF).execute(f"SELECT {columns} FROM ({sql})").fetchall())
    return got


def test_split_summary_counts_every_order(spark):
    got = check(spark, "q_split_summary", " WHERE o_custkey % 10 != 3")
    assert sum(r["n"] for r in got) == spark.read.parquet(f"{DATA}/{SF}/orders.parquet").count()


def test_overlaps_read_every_line(spark):
    got = check(spark, "q_overlaps", " WHERE l_quantity >= 49")
    rows = spark.read.parquet(f"{DATA}/{SF}/lineitem.parquet").select("l_suppkey", "l_returnflag").distinct().collect()
    flags = {}
    for r in rows:
        flags.setdefault(r["l_suppkey"], set()).add(r["l_returnflag"])
    assert len(got) == sum(len(f) * (len(f) - 1) // 2 for f in flags.values())


def test_overlaps_of_small_quantities(spark, tmp_path):
    rows = [(1, "A", 1.0), (1, "R", 2.0), (2, "N", 50.0), (2, "N", 3.0), (3, "A", 50.0), (3, "R", 7.0)]
    spark.createDataFrame(rows, "l_suppkey long, l_returnflag string, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalog.QUERIES["q_overlaps"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [(1, "A", "R"), (3, "A", "R")]
