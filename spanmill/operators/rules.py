"""Predicates from data: bounds on metrics, rows within all bounds, and the search for bounds that cover all positives.

A bound is a tuple (metric, sign, value), as a row of a table or of a settings file holds it; a rule is some bounds.
"""

from __future__ import annotations

import functools
import itertools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.functions.numeric import outward

Bound = tuple[str, str, float]
SIGNS = frozenset(("<", "<=", ">", ">="))
#: Bounds whose outcomes share one integer.
_WORD = 62


def meets(bound: Bound) -> Column:
    """Whether a row's metric is within the bound; a null or NaN metric is within none."""
    metric, sign, value = bound
    if sign not in SIGNS:
        raise ValueError(f"{sign!r} is none of {sorted(SIGNS)}")
    known = F.nanvl(F.col(metric).cast("double"), F.lit(None).cast("double"))
    return F.coalesce(F.call_function(f"`{sign}`", known, F.lit(float(value))), F.lit(False))


def meets_all(rule: Sequence[Bound]) -> Column:
    """Whether a row is within every bound. No bounds are no rule: they would match every row."""
    if not rule:
        raise ValueError("a rule without bounds")
    return F.forall(F.array(*map(meets, rule)), lambda met: met)


def flagged(rows: DataFrame, rule: Sequence[Bound], order: Sequence[str]) -> DataFrame:
    """The rows that match, in a named order."""
    return rows.where(meets_all(rule)).orderBy(*order)


def covering_conditions(rows: DataFrame, positive: str, metrics: Sequence[str], step: float) -> DataFrame:
    """Per metric the tightest one-sided threshold that covers all positives: (metric, op, threshold).

    The side is that of the positives' median against the others'; the threshold is rounded outward. One pass.
    """
    p = F.col(positive)
    named = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics)))
    long = rows.select(p.alias("__p"), named.alias("__m")).select("__p", "__m.*").where("x is not null and not isnan(x)")
    stats = long.groupBy("metric").agg(
        F.median(F.when(F.col("__p"), F.col("x"))).alias("mp"),
        F.median(F.when(~F.col("__p"), F.col("x"))).alias("mn"),
        F.min(F.when(F.col("__p"), F.col("x"))).alias("lo"),
        F.max(F.when(F.col("__p"), F.col("x"))).alias("hi"),
    )
    low = F.col("mp") >= F.col("mn")
    return stats.select(
        "metric",
        F.when(low, ">=").otherwise("<=").alias("op"),
        F.when(low, outward(F.col("lo"), step, ">=")).otherwise(outward(F.col("hi"), step, "<=")).alias("threshold"),
    )


def candidate_rules(rows: DataFrame, positive: str, bounds: Sequence[Bound], most: int = 3, limit: int = 20) -> DataFrame:
    """All conjunctions of up to `most` bounds by the negatives they hit: (rule, hits, covered), the best first.

    Rows are scanned once: each row becomes a bitmask of the bounds it meets, of as many words as these need, equal
    masks are counted, and the conjunctions are tested on the masks.
    """
    words = [f"m{w}" for w in range(-(-len(bounds) // _WORD))]
    bits = [[F.when(meets(b), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, b in enumerate(bounds[w * _WORD : (w + 1) * _WORD])] for w in range(len(words))]
    masks = [functools.reduce(operator.add, b).alias(w) for w, b in zip(words, bits, strict=True)]
    counts = rows.groupBy(*masks, F.col(positive).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    combos = itertools.chain.from_iterable(itertools.combinations(range(len(bounds)), k) for k in range(1, most + 1))

    def option(combo: tuple[int, ...]) -> Column:
        text = "&".join(f"{bounds[i][0]}{bounds[i][1]}{bounds[i][2]:g}" for i in combo)
        needs = [sum(1 << (i % _WORD) for i in combo if i // _WORD == w) for w in range(len(words))]
        return F.struct(F.lit(text).alias("rule"), *(F.lit(n).cast("long").alias(f"n{w}") for w, n in enumerate(needs)))

    tested = counts.withColumn("o", F.explode(F.array(*map(option, combos))))
    hit = functools.reduce(operator.and_, (F.col(w).bitwiseAND(F.col(f"o.n{i}")) == F.col(f"o.n{i}") for i, w in enumerate(words)))
    total = lambda test: F.coalesce(F.sum(F.when(test & hit, F.col("n"))), F.lit(0).cast("long"))
    return tested.groupBy("o.rule").agg(total(~F.col("p")).alias("hits"), total(F.col("p")).alias("covered")).orderBy("hits", F.desc("covered"), "rule").limit(limit)
