"""Holm's adjustment over the whole part table, against brute force."""

from collections import defaultdict

import pytest
from conftest import DATA

from spanmill.plans import catalog


def test_holm_adjusts_every_part_within_its_brand(spark):
    sf = f"{DATA}/sf0.001"
    parts = spark.read.parquet(f"{sf}/part.parquet").collect()
    families = defaultdict(list)
    for r in parts:
        if r["p_size"] is not None and r["p_size"] % 9:
            families[r["p_brand"]].append((r["p_size"] / 2000.0, r["p_partkey"]))
    want = {r["p_partkey"]: None for r in parts}
    for members in families.values():
        most = 0.0
        for i, (p, key) in enumerate(sorted(members)):
            most = max(most, min(1.0, (len(members) - i) * p))
            want[key] = most
    got = {r["p_partkey"]: r["adjusted"] for r in catalog.QUERIES["q_holm"](spark, sf).collect()}
    assert len(parts) > 40 and got.keys() == want.keys()
    for key, adjusted in want.items():
        assert got[key] == (None if adjusted is None else pytest.approx(adjusted, abs=1e-6))
