"""Mixing sources to target weights by hash-seeded Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.llm.shared import Staging, free_names, input_bytes, key_hash, named, parts_for

#: Text bytes of one task's output.
PART_BYTES = 32 << 20
UNIT = float(1 << 52)
#: The columns that poisson_mix() adds: a row's mean repetition rate, the number of its copy, the order of the shuffle.
ADDED = ("mix_mean", "mix_copy", "mix_key")


#: A Poisson part has a mean of at most this, so that exp(-mean) never underflows.
MOST_MEAN = 16.0
#: Terms of a part's distribution; from the 96th on those of a mean of 16 are below 2^-52, the resolution of a draw.
TERMS = 96


def poisson_table(mean: Column) -> Column:
    """A struct (split, cdf): the equal Poisson parts of a mean, each of at most MOST_MEAN, and P(part <= n), n = 0, 1, ...

    Values above the largest possible draw are left out: no draw reaches them.
    """
    split = F.greatest(F.ceil(mean / MOST_MEAN), F.lit(1)).cast("int")
    part = mean / split
    first = F.struct(F.exp(-part).alias("p"), F.array(F.exp(-part)).alias("c"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * part / k
        return F.struct(p.alias("p"), F.concat(s["c"], F.array(F.element_at(s["c"], -1) + p)).alias("c"))

    cdf = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), first, step, lambda s: s["c"])
    return F.struct(split.alias("split"), F.filter(cdf, lambda c: c <= 1 - 1 / UNIT).alias("cdf"))


def poisson_count(table: Column, seed: int, ident: Column) -> Column:
    """The sum over the table's parts of the smallest n with P(part <= n) > u, for u in [0, 1) hashed from
    (seed, part, ident). The parts' counts add up to a Poisson draw of the whole mean; none is capped."""
    draws = F.transform(F.sequence(F.lit(0), table["split"] - 1), lambda j: key_hash(F.lit(f"draw{seed}"), j.cast("string"), ident) / F.lit(UNIT))
    return F.aggregate(draws, F.lit(0), lambda s, u: s + F.size(F.filter(table["cdf"], lambda c: c <= u)))


def repetition_means(docs: DataFrame, weight: Column, source_col: str = "source") -> DataFrame:
    """One row per source (null is a source): rows, and the mean repetition rate that gives it its share of the weights.

    `weight` is an expression of `rows`. Means keep the expected number of all rows as it is.
    """
    counts = docs.groupBy(named(source_col).alias("source")).agg(F.count(F.lit(1)).alias("rows"))
    counts = counts.withColumn("weight", weight.cast("double"))
    sums = counts.agg(F.sum("rows").alias("rows"), F.sum("weight").alias("weight")).first()
    return counts.select("source", "rows", (F.col("weight") / F.lit(sums["weight"]) * F.lit(sums["rows"]) / F.col("rows")).alias("mean"))


def poisson_mix(
    spark: SparkSession,
    docs: DataFrame,
    weight: Column | None = None,
    seed: int = 7,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    added: tuple[str, str, str] = ADDED,
) -> DataFrame:
    """All columns of `docs`, each row as often as its Poisson draw says, in a global random order.

    A row's draw depends on (seed, id, MD5 of the text) only, so no executor's loss changes a result; rows without an id
    or of a repeated one draw by their texts, and rows alike in both are drawn alike. `weight` is a source's target
    weight as an expression of its `rows`; by default their square root. The mean repetition rate of source s is (its
    share of the weights) * (all rows) / (its rows). The columns `added` hold that mean, the copy's number from 0 and the
    key of the shuffle; columns of those names are replaced, all others pass, whatever their names. A null source is
    a source of its own; a null id counts as the empty string, a null text as an empty one; nulls in other columns,
    empty and long texts pass unchanged. An empty table gives an empty result.

    The distributions are tabled once a source; the means have a row per source, and their join is left to the optimizer,
    which broadcasts them only below the session's size threshold and else splits a hot source (adaptive skew join).
    Rows travel once, to their place in the random order, which is uniform whatever the sources.
    """
    staging = Staging(spark, "poisson_mix")
    weight = F.sqrt("rows") if weight is None else weight
    source, table, n = free_names([*docs.columns, *added], "__source", "__table", "__n")
    means = repetition_means(docs, weight, source_col).withColumn("table", poisson_table(F.col("mean")))
    mean, copy, key = added
    means = staging.write(means, "means").select(F.col("source").alias(source), F.col("mean").alias(mean), F.col("table").alias(table))
    ident = F.concat_ws(":", F.coalesce(named(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(named(text_col), F.lit("")).cast("binary")))
    docs = docs.drop(*added)
    joined = docs.join(means, named(source_col).eqNullSafe(F.col(source))).drop(source)
    count = F.when(named(mean) > 0, poisson_count(F.col(table), seed, ident)).otherwise(F.lit(0))
    copies = (
        joined.withColumn(n, count)
        .where(F.col(n) > 0)
        .withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
        .drop(n, table)
        .withColumn(key, key_hash(F.lit(f"order{seed}"), ident, named(copy).cast("string")))
    )
    # The keys are uniform, so hashed partitions are even and need no sampling pass over the texts.
    parts = parts_for(spark, input_bytes(docs), PART_BYTES, factor=2)
    return copies.repartition(parts, named(key)).sortWithinPartitions(named(key), named(copy))
