"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.llm.shared import Staging


def _large_star(links: DataFrame) -> DataFrame:
    """Links (a, b), a > b: each node's greater neighbours go to the least of its neighbours and itself."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
    moved = links.select(F.col("b").alias("a"), F.col("a").alias("up")).join(least, "a")
    return moved.select(F.col("up").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links (a, b), a > b: a node and its lesser neighbours go to the least of them."""
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    moved = links.join(least, "a").where("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def connected(staging: Staging, links: DataFrame, tag: str, rounds: list[int] | None = None) -> DataFrame:
    """(id, comp) of every id in `links` (a, b): comp is the least id reachable. Links of an id to itself count as none
    but name the id; an empty table gives an empty result.

    Large stars and small stars take turns until nothing moves, so that the rounds grow with the logarithm of a
    component's size, whatever the order of its ids. The links never grow in number. Each half round is written to the
    shared folder, and its joins have plain sides, of which a hub's can be split; nothing but a count and a checksum
    reaches the driver. The number of rounds is appended to `rounds`.
    """
    ids = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
    now = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = staging.write(now, f"{tag}-0")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    step, before = 0, state(now)
    while before[0]:
        step += 1
        large = staging.write(_large_star(now), f"{tag}-{step}-large")
        staging.drop(f"{tag}-{step - 1}")
        now = staging.write(_small_star(large), f"{tag}-{step}")
        staging.drop(f"{tag}-{step}-large")
        after = state(now)
        if after == before:
            break
        before = after
    if rounds is not None:
        rounds.append(step)
    return ids.join(now.select(F.col("a").alias("id"), F.col("b").alias("comp")), "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))
