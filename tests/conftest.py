import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def oracle(sf: str):
    """A DuckDB connection with the driver's tables as views."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(DATA, sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def normal(rows):
    return sorted(tuple(str(x) for x in r) for r in rows)


def same_as_oracle(spark, con, query, sql: str, sf: str) -> None:
    df = query(spark, f"{DATA}/{sf}")
    names = sorted(df.columns)
    got = normal(df.select(*(f"`{n}`" for n in names)).collect())
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(columns) == names
    order = [columns.index(n) for n in names]
    assert got == normal([tuple(r[i] for i in order) for r in result.fetchall()])
