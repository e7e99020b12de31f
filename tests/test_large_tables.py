"""What queries give on tables beyond the smallest, by their SQL."""

import duckdb
from conftest import normal
from pyspark.sql import functions as F

from spanmill.functions import numeric as nu
from spanmill.plans import catalog


def same_as_sql(spark, at, name, table):
    """The query's rows over the one table in the folder, once they are those of its SQL."""
    got = catalog.QUERIES[name](spark, str(at))
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{at}/{table}.parquet/*.parquet'")
    columns = ", ".join(f'"{c}"' for c in got.columns)
    rows = got.collect()
    assert normal(rows) == normal(con.execute(f"SELECT {columns} FROM ({catalog.ORACLES[name]})").fetchall())
    return rows


def test_scalars_of_large_keys(spark, tmp_path):
    keys = [0, 1, 2, 1047, 1048, 1049, 1_048_575, 1_048_576, 1_073_741, 1_073_742, 8_999_999, 1_099_511_628, 5_000_000_000]
    rows = [(k, 1001.91 + 31_415.926535 * (i % 16)) for i, k in enumerate(keys)]
    spark.createDataFrame(rows, "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["o_orderkey"]: r["bytes"] for r in same_as_sql(spark, tmp_path, "q_scalars", "orders")}
    assert got[1_073_742] == "1024.0 MiB" and got[8_999_999] == "8583.1 MiB"


def test_bytes_have_the_largest_unit_allowed(spark):
    n = spark.createDataFrame([(1023,), (1024,), (1 << 20,), (3 << 30,), (5 << 40,), (5 << 50,)], "n long").select("n", nu.human_bytes(F.col("n")).alias("all"), nu.human_bytes(F.col("n"), "KiB").alias("least"))
    assert [r["all"] for r in n.orderBy("n").collect()] == ["1023 B", "1.0 KiB", "1.0 MiB", "3.0 GiB", "5.0 TiB", "5120.0 TiB"]
    assert [r["least"] for r in n.orderBy("n").collect()][:4] == ["1023 B", "1.0 KiB", "1024.0 KiB", "3145728.0 KiB"]


def test_window_counts_by_the_nearest_second(spark, tmp_path):
    parts = ("00:00:00", "02:59:59.499999", "02:59:59.5", "02:59:59.500001", "02:59:59.999999", "03:00:00", "03:00:00.5", "05:59:58.5", "05:59:59.5", "23:59:59.7")
    rows = [(i, f"2024-01-{d:02d} {p}", "view" if i % 3 else "click") for d in (1, 2) for i, p in enumerate(parts)]
    events = spark.createDataFrame(rows, "event_id long, s string, event_type string")
    ts = F.expr("to_timestamp_ntz(s)").alias("ts")
    events.select("event_id", ts, F.lit(1).cast("long").alias("user_id"), "event_type", F.lit(0.5).alias("value"), F.lit("").alias("props")).write.parquet(f"{tmp_path}/events.parquet")
    got = same_as_sql(spark, tmp_path, "s_window_counts", "events")
    assert sum(r["n"] for r in got) == 2 * len(rows)
