"""Reproducible splits and samples, keyed by hashes: no row's fate depends on another's place in the input."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanmill.functions.numeric import hash_uniform
from spanmill.operators.ordering import numbered


def hash_order(seed: int, *keys: str | Column) -> Column:
    """A random-looking order that depends on the seed and the keys only."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k for k in keys)), 256)


def greedy_split(groups: DataFrame, group: str, size: str, ratios: Mapping[str, float], seed: int = 42) -> DataFrame:
    """(group, split): groups in descending size go to the split that lacks most of its target; ties by split order.

    Equal sizes are put in hash order. The rule is sequential: the groups (one row each, not the items) stream in order
    through one task, whose state is what each split lacks; pre-aggregate items to groups first.
    """
    names = list(ratios)
    whole = sum(ratios.values())
    if whole <= 0:
        raise ValueError("ratios must have a positive sum")
    total = groups.agg(F.sum(size)).first()[0] or 0

    def place(frames):
        lack = [float(total) * (ratios[n] / whole) for n in names]
        for frame in frames:
            out = []
            for n in frame["__n"]:
                to = lack.index(max(lack))
                lack[to] -= n
                out.append(names[to])
            frame["split"] = out
            yield frame[[group, "split"]]

    ordered = groups.select(group, F.col(size).alias("__n"), hash_order(seed, group).alias("__h")).repartition(1).sortWithinPartitions(F.desc("__n"), "__h", group)
    return ordered.mapInPandas(place, f"`{group}` {groups.schema[group].dataType.simpleString()}, split string")


def split_summary(items: DataFrame, assignment: DataFrame, group: str, amount: str) -> DataFrame:
    """Groups, items and amount of each split; unassigned items are left out."""
    out = items.join(assignment, group).groupBy("split")
    return out.agg(F.count_distinct(group).alias("groups"), F.count(F.lit(1)).alias("n"), F.sum(amount).alias("total"))


def overlaps(assignment: DataFrame, key: str) -> DataFrame:
    """Keys in more than one split: (key, first split, second split) for each pair. One grouping, no self-join."""
    pairs = F.transform(F.col("splits"), lambda a: F.transform(F.filter("splits", lambda b: b > a), lambda b: F.struct(a.alias("one"), b.alias("two"))))
    many = assignment.groupBy(key).agg(F.array_sort(F.collect_set("split")).alias("splits")).where(F.size("splits") > 1)
    return many.select(key, F.explode(F.flatten(pairs)).alias("p")).select(key, "p.one", "p.two")


def stratified_split(items: DataFrame, stratum: str, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """Adds `part`: of each stratum the first round-half-even(n * ratio) in hash order are `eval`, the others `train`."""
    n = F.count(F.lit(1)).over(Window.partitionBy(stratum))
    at = F.row_number().over(Window.partitionBy(stratum).orderBy(hash_order(seed, stratum, key), key))
    return items.withColumn("part", F.when(at <= F.bround(n * F.lit(float(ratio)), 0), "eval").otherwise("train"))


def sample_exactly(items: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows without replacement in hash order; a total order, so TakeOrdered keeps n rows per task."""
    return items.orderBy(hash_order(seed, key), key).limit(n)


def sample_by_stratum(items: DataFrame, allocation: DataFrame, stratum: str, key: str, seed: int = 42) -> DataFrame:
    """The allocated number of rows (stratum, allocated) of each stratum, in hash order."""
    at = F.row_number().over(Window.partitionBy(stratum).orderBy(hash_order(seed, key), key))
    return items.withColumn("__at", at).join(allocation, stratum).where("__at <= allocated").drop("__at", "allocated")


def comparison_group(items: DataFrame, error: str, key: str, n: int, exclude: DataFrame, seed: int = 42) -> DataFrame:
    """n rows whose error is at most the median of all, without the excluded ones."""
    median = items.agg(F.median(error)).first()[0]
    pool = items.where(F.col(error) <= F.lit(median)).join(exclude.select(key), key, "left_anti")
    return sample_exactly(pool, n, key, seed)


def apportioned(weights: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Adds `allocated`: whole numbers by largest remainders, ties by key, that sum to `total`. One row per category."""
    exact = F.lit(total) * F.col(weight) / F.sum(weight).over(Window.partitionBy())
    out = weights.withColumn("__exact", exact).withColumn("__floor", F.floor("__exact").cast("long"))
    left = F.lit(total) - F.sum("__floor").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("__exact") - F.col("__floor"), 9)), key))
    return out.withColumn("allocated", F.col("__floor") + (rank <= left).cast("long")).drop("__exact", "__floor")


def evenly_spaced(items: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """n rows at equal steps of a total order, the first among them."""
    count = items.count()
    step = max(count // n, 1)
    return numbered(items, order, "__at").where((F.col("__at") % step == 0) & (F.col("__at") < step * n)).drop("__at")


def fixed_groups(items: DataFrame, group: str, key: str, size: int, seed: int = 42) -> DataFrame:
    """Groups of exactly `size` items of one group in hash order: adds `part` and `place`; the rest is dropped."""
    at = F.row_number().over(Window.partitionBy(group).orderBy(hash_order(seed, key), key)) - 1
    out = items.withColumn("part", F.floor(at / size).cast("int")).withColumn("place", (at % size).cast("int"))
    full = F.count(F.lit(1)).over(Window.partitionBy(group, "part"))
    return out.withColumn("__n", full).where(F.col("__n") == size).drop("__n")


def concat_groups(items: DataFrame, group: str, key: str, sizes: tuple[int, int] = (3, 5), gap_units: tuple[int, int] = (1, 10), unit: float = 0.1, rate: int = 16000, seed: int = 42, epoch: int = 0) -> DataFrame:
    """Random groups of items of one group (a speaker, say) for concatenation.

    In hash order of each group's items, sizes are drawn between the bounds until fewer than the lower bound are left;
    the rest is not used. A gap of a whole number of units follows each item but a group's last. Draws are keyed by
    (seed, epoch, group), so a group's result does not depend on the others. Adds part, place, gap (in samples).
    The cut is sequential in a group, so a group's keys, not its rows, are folded, in one expression.
    """
    low, high = sizes
    if not 1 <= low <= high:
        raise ValueError("sizes must be ascending and positive")
    s = F.lit(f"{seed}.{epoch}")
    ids = [F.col(group).cast("string"), F.col(key).cast("string")]
    item = F.struct(F.sha2(F.concat_ws(":", s, *ids), 256).alias("h"), F.col(key).alias("key"), hash_uniform(s, F.lit("size"), *ids).alias("u"), hash_uniform(s, F.lit("gap"), *ids).alias("v"))
    lists = items.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("__all"))
    n = F.size("__all")
    kind = "array<struct<i:int,part:int,place:int,last:boolean>>"
    start = F.struct(F.lit(0).alias("first"), F.lit(0).alias("end"), F.lit(-1).alias("part"), F.array().cast(kind).alias("out"))

    def step(acc: Column, i: Column) -> Column:
        new = (i == acc["end"]) & (n - i >= low)
        take = F.least(F.lit(low) + F.floor(F.get("__all", i)["u"] * (high - low + 1)).cast("int"), n - i)
        first, end = F.when(new, i).otherwise(acc["first"]), F.when(new, i + take).otherwise(acc["end"])
        part = F.when(new, acc["part"] + 1).otherwise(acc["part"])
        placed = F.struct(i.alias("i"), part.alias("part"), (i - first).alias("place"), (i == end - 1).alias("last"))
        return F.struct(first.alias("first"), end.alias("end"), part.alias("part"), F.when(i < end, F.concat(acc["out"], F.array(placed))).otherwise(acc["out"]).cast(kind).alias("out"))

    cut = F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda acc: acc["out"])
    rows = lists.select(group, "__all", F.explode(cut).alias("p"))
    units = F.lit(gap_units[0]) + F.floor(F.get("__all", F.col("p.i"))["v"] * (gap_units[1] - gap_units[0] + 1))
    gap = F.when(F.col("p.last"), F.lit(0).cast("long")).otherwise(F.bround(units * unit * rate, 0).cast("long"))
    return rows.select(group, F.get("__all", F.col("p.i"))["key"].alias(key), "p.part", "p.place", gap.alias("gap"))


def epoch_concat_groups(items: DataFrame, group: str, key: str, count: int, epoch: int, most_passes: int = 10_000, seed: int = 42, **spec) -> DataFrame:
    """concat_groups() in as many passes with their own draws as give `count` groups, which are taken in hash order of the
    passes' groups, whole passes first.

    The first pass tells how many groups one gives; the others are planned by it, and more follow while groups lack.
    Raises ValueError if a pass gives none or `most_passes` do not give enough.
    """
    one = lambda p: concat_groups(items, group, key, seed=seed, epoch=epoch * 1_000_000 + p, **spec).withColumn("pass", F.lit(p))
    out = one(0)
    found, passes = out.select(group, "part", "pass").distinct().count(), 1
    if not found and count:
        raise ValueError("no group has enough items")
    while found < count:
        more = min(most_passes - passes, max(1, -(-(count - found) * passes // found)))
        if more <= 0:
            raise ValueError(f"{most_passes} passes give {found} of {count} groups")
        for p in range(passes, passes + more):
            out = out.unionByName(one(p))
        passes += more
        found = out.select(group, "part", "pass").distinct().count()
    names = out.select(group, "part", "pass").distinct()
    order = hash_order(seed + epoch, group, "part", "pass")
    # Rows of passes before the last are all wanted, if the last is needed at all.
    return out.join(names.orderBy((F.col("pass") == passes - 1).cast("int"), order, group, "part", "pass").limit(count), [group, "part", "pass"])


def length_batches(items: DataFrame, length: str, key: str, batch: int, pool_batches: int = 16, seed: int = 42, epoch: int = 0) -> DataFrame:
    """Batches of similar lengths: a hash shuffle is cut into pools of `batch * pool_batches`, each pool sorted by length
    and cut into batches, and the batches shuffled. Adds batch (from 0) and place."""
    order = [hash_order(seed, F.lit(str(epoch)), F.col(key).cast("string")), key]
    pooled = numbered(items, order, "__row").withColumn("__pool", F.floor(F.col("__row") / (batch * pool_batches)).cast("int"))
    inside = F.row_number().over(Window.partitionBy("__pool").orderBy(length, key)) - 1
    out = pooled.drop("__row").withColumn("__in", inside)
    out = out.withColumn("__cut", F.floor(F.col("__in") / batch).cast("int")).withColumn("place", (F.col("__in") % batch).cast("int"))
    cuts = out.select("__pool", "__cut").distinct()
    mixed = numbered(cuts, [hash_order(seed + 1, F.lit(str(epoch)), F.concat_ws(":", "__pool", "__cut")), "__pool", "__cut"], "batch")
    return out.join(mixed.withColumn("batch", F.col("batch").cast("int")), ["__pool", "__cut"]).drop("__pool", "__cut", "__in")


def drawn_from(wanted: DataFrame, base: DataFrame, key: str, value: str, seed: int = 42) -> DataFrame:
    """Adds to each wanted row a value drawn with replacement from the base rows: a hash-indexed equi-join."""
    n = base.count()
    index = F.floor(hash_uniform(F.lit(str(seed)), F.col(key).cast("string")) * n).cast("long")
    return wanted.withColumn("__n", index).join(numbered(base.select(value), [value], "__n"), "__n").drop("__n")


def rotated_order(names: Sequence[str], rounds: DataFrame, round_col: str = "round") -> DataFrame:
    """Each round's measuring order: a rotation by the round's number."""
    n = len(names)
    place = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return rounds.withColumn("place", place).withColumn("name", F.get(F.array(*map(F.lit, names)), F.pmod(F.col("place") + F.col(round_col), F.lit(n)).cast("int")))
