"""Augmentation chains: their description, its check before a job starts, and their run over waveforms and features."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.functions.numeric import hash_uniform
from spanmill.operators import composed

#: The steps in the order in which they run, each with the ranges it draws from and the value at which a range does nothing.
STEPS: dict[str, dict[str, float | None]] = {
    "stretch": {"factor": 1.0},
    "reverb": {},
    "noise": {"snr": None},
    "band": {},
    "volume": {"db": 0.0},
    "mask": {"width": 0.0, "masks": 0.0},
}


@dataclass(frozen=True)
class Step:
    """How likely a step is and the ranges its parameters are drawn from."""

    chance: float
    ranges: Mapping[str, tuple[float, float]] = field(default_factory=dict)

    def faults(self, name: str, limits: Mapping[str, tuple[float, float]]) -> list[str]:
        """What would keep the step from ever doing anything, make it fail, or take it out of its limits."""
        if name not in STEPS:
            return [f"{name}: no such step"]
        out = [] if 0 < self.chance <= 1 else [f"{name}: a chance of {self.chance} is not in (0, 1]"]
        wanted = STEPS[name]
        out += [f"{name}: no range {r}" for r in wanted if r not in self.ranges]
        for r, (low, high) in self.ranges.items():
            at = f"{name}.{r}"
            bound = limits.get(at, (-math.inf, math.inf))
            if r not in wanted:
                out.append(f"{at}: no such range")
            elif not (math.isfinite(low) and math.isfinite(high)) or low > high:
                out.append(f"{at}: {low} to {high} is not a range")
            elif low == high == wanted[r]:
                out.append(f"{at}: never changes anything")
            elif low < bound[0] or high > bound[1]:
                out.append(f"{at}: {low} to {high} leaves {bound[0]} to {bound[1]}")
            elif name == "stretch" and low <= 0:
                out.append(f"{at}: {low} is not positive")
        return out


def faults(chain: Mapping[str, Step], limits: Mapping[str, tuple[float, float]] | None = None) -> list[str]:
    """All faults of a chain; steps that are not in it are not applied and not judged."""
    return [f for name, step in chain.items() for f in step.faults(name, limits or {})]


def described(chain: Mapping[str, Step]) -> list[str]:
    """A line a step, in the order of the run."""
    text = lambda s: "".join(f", {r} {low:g} to {high:g}" for r, (low, high) in s.ranges.items())
    return [f"{name}: {100 * chain[name].chance:g} %{text(chain[name])}" if name in chain else f"{name}: off" for name in STEPS]


def run(
    rows: DataFrame, chain: Mapping[str, Step], key: str, samples: str, response: str, noise: str, rate: float, limits: Mapping[str, tuple[float, float]] | None = None, seed: int = 42, epoch: int = 0
) -> DataFrame:
    """Plans and applies the chain's steps on waveforms: adds stretch, selected, skipped, applied, augmented and
    `seconds`, the duration after the chain. Raises ValueError if the chain has faults; nothing is computed then."""
    wrong = faults(chain, limits)
    if wrong:
        raise ValueError("; ".join(wrong))
    chances = {name: chain[name].chance for name in STEPS if name in chain and name != "mask"}
    between = lambda name, r, other: chain[name].ranges[r] if name in chain else other
    planned = composed.augmentation_plan(rows, key, chances, between("stretch", "factor", (0.5, 2.0)), seed=seed, epoch=epoch)
    out = composed.augmented(planned, key, samples, response, noise, rate, between("noise", "snr", (0.0, 20.0)), between("volume", "db", (-6.0, 6.0)), seed=seed)
    return out.withColumn("seconds", F.size("augmented") / float(rate))


def masks(key: Column, bands: Column, step: Step, seed: int = 42, epoch: int = 0) -> Column:
    """The bands a step masks, as an array of (first, width): widths and places are drawn by the key; empty if the step
    is not drawn. Masks of no width are left out."""
    s, k = F.lit(f"{seed}.{epoch}"), key.cast("string")
    u = lambda name, i: hash_uniform(s, F.lit(name), k, i.cast("string"))
    whole = lambda name, i, low, high: (low + F.floor(u(name, i) * (high - low + 1))).cast("int")
    (least, most), (narrow, wide) = ((int(v) for v in step.ranges[r]) for r in ("masks", "width"))
    n = whole("masks", F.lit(0), F.lit(least), F.lit(most))

    def one(i: Column) -> Column:
        width = F.least(whole("width", i, F.lit(narrow), F.lit(wide)), bands)
        return F.struct(whole("first", i, F.lit(0), bands - width).alias("first"), width.alias("width"))

    drawn = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), one), lambda m: m["width"] > 0)
    hit = (hash_uniform(s, F.lit("mask"), k) < step.chance) & (n > 0)
    return F.when(hit, drawn).otherwise(F.filter(drawn, lambda m: F.lit(False)))


def feature_masked(rows: DataFrame, key: str, features: str, step: Step, value: float = 0.0, seed: int = 42, epoch: int = 0) -> DataFrame:
    """Adds `masks` and `masked_features`: in every frame the drawn bands hold `value`. Frames are arrays of bands."""
    at = masks(F.col(key), F.coalesce(F.size(F.get(features, F.lit(0))), F.lit(0)), step, seed, epoch)
    held = lambda i: F.exists("masks", lambda m: (i >= m["first"]) & (i < m["first"] + m["width"]))
    frame = lambda f: F.transform(f, lambda v, i: F.when(held(i), F.lit(value)).otherwise(v))
    return rows.withColumn("masks", at).withColumn("masked_features", F.transform(features, frame))
