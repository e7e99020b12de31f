"""Scalar functions: rates, bands, bins, rounding. All are expressions, evaluated in the JVM."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Left-closed rate bands and bins.
BANDS = (("under4", None, 4.0), ("4to6", 4.0, 6.0), ("6to8", 6.0, 8.0), ("over8", 8.0, None))
BAND_KEYS = tuple(key for key, _, _ in BANDS)
BIN_LOW, BIN_HIGH, BIN_COUNT = 6.0, 14.0, 8
BIN_KEYS = ("lt6", *(f"{k}to{k + 1}" for k in range(6, 14)), "ge14")
EPSILON = 1e-10
BYTE_UNITS = ("KiB", "MiB", "GiB", "TiB")


def finite(x: Column) -> Column:
    """NaN and infinities become null: null is this library's only 'undefined'."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(math.inf)), F.lit(None)).otherwise(x)


def rate(count: Column, seconds: Column) -> Column:
    """Count over duration; a duration that is not positive is an error."""
    bad = F.raise_error(F.concat(F.lit("duration must be positive: "), F.coalesce(seconds.cast("string"), F.lit("null"))))
    return F.when(seconds > 0, count.cast("double") / seconds).otherwise(bad.cast("double"))


def rate_or_zero(count: Column, seconds: Column) -> Column:
    return F.when(seconds <= 0, F.lit(0.0)).otherwise(count / seconds)


def band(x: Column) -> Column:
    """Band key of a rate; null for null and NaN (which Spark would order above all numbers)."""
    x = finite(x)
    return F.when(x.isNull(), F.lit(None)).when(x < 4, "under4").when(x < 6, "4to6").when(x < 8, "6to8").otherwise("over8")


def band_strict(x: Column) -> Column:
    """As band(), but NaN is an error."""
    return F.when(F.isnan(x), F.raise_error(F.lit("NaN has no band")).cast("string")).otherwise(band(x))


def bin_code(x: Column) -> Column:
    """0 below 6, 1 to 8 for [6, 7) to [13, 14), 9 from 14 on."""
    return F.width_bucket(x, F.lit(BIN_LOW), F.lit(BIN_HIGH), F.lit(BIN_COUNT))


def bin_key(x: Column) -> Column:
    return F.get(F.array(*map(F.lit, BIN_KEYS)), bin_code(x).cast("int"))


def tenth_bin(ratio: Column) -> Column:
    """0 to 9; the last bin is closed."""
    return F.least(F.greatest(F.floor(ratio * 10), F.lit(0)), F.lit(9)).cast("int")


def part_of(part: Column, total: Column) -> Column:
    """part / total within [0, 1]; 0 where total is below 1."""
    return F.when(total < 1, F.lit(0.0)).otherwise(F.least(F.greatest(part / total, F.lit(0.0)), F.lit(1.0)))


def digitized(x: Column, edges: Sequence[float]) -> Column:
    """How many edges are at most x: left-closed bins."""
    out = F.lit(0)
    for e in edges:
        out = out + (x >= F.lit(float(e))).cast("int")
    return out


def edge_labels(edges: Sequence[float], form: str = "{:g}") -> list[str]:
    text = [form.format(e) for e in edges]
    return [f"<{text[0]}", *(f"{a}-{b}" for a, b in zip(text, text[1:], strict=False)), f">={text[-1]}"]


def stretched_length(samples: Column, speed: Column) -> Column:
    """Samples at `speed` times the speed, rounded half to even."""
    return F.bround(samples.cast("double") / speed, 0).cast("long")


def rate_after_stretch(x: Column, stretch: Column) -> Column:
    """A count is unchanged by a time stretch; a rate is divided by it."""
    return x / stretch


def frame_count(samples: Column, hop: int = 160) -> Column:
    return F.lit(1) + F.floor(samples / hop).cast("long")


def decibels(power: Column) -> Column:
    return 10 * F.log10(power + EPSILON)


def outward(x: Column, step: float, op: str) -> Column:
    """A threshold moved to the next step away from the values it covers: down for lower bounds, up for upper ones."""
    steps = x / step
    return (F.floor(steps + 1e-9) if op.startswith(">") else F.ceil(steps - 1e-9)) * step


def stretch_cdf(x: Column, low: float, high: float, kind: str = "uniform") -> Column:
    """Distribution function of a uniform or log-uniform draw from [low, high]."""
    inner = (x - low) / (high - low) if kind == "uniform" else F.ln(x / low) / math.log(high / low)
    return F.when(x <= low, 0.0).when(x >= high, 1.0).otherwise(inner)


def drawn_between(u: Column, low: float, high: float, kind: str = "uniform") -> Column:
    """A draw from [low, high) by a uniform u in [0, 1)."""
    return low + u * (high - low) if kind == "uniform" else F.exp(math.log(low) + u * math.log(high / low))


def hash_uniform(*parts: Column) -> Column:
    """A uniform number in [0, 1) keyed by its parts: 52 bits of SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def key_number(key: Column) -> Column:
    """The first 8 bytes of SHA-256, big endian, as an unsigned 64-bit number."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def human_bytes(n: Column, largest: str = "TiB") -> Column:
    """Bytes in the largest unit, up to `largest`, that they fill; numbers of the largest unit have no bound."""
    units = BYTE_UNITS[: BYTE_UNITS.index(largest) + 1]
    out = F.format_string(f"%.1f {largest}", n / float(1 << (10 * len(units))))
    for power, unit in reversed(list(enumerate(units[:-1], 1))):
        out = F.when(n < float(1 << (10 * (power + 1))), F.format_string(f"%.1f {unit}", n / float(1 << (10 * power)))).otherwise(out)
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).otherwise(out)


def clock(seconds: Column) -> Column:
    """h:mm:ss."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60)))


def improved(x: Column, best: Column, mode: str = "min", delta: float = 0.0) -> Column:
    """Whether x beats the best so far by more than delta; anything beats null."""
    return F.coalesce(x < best - delta if mode == "min" else x > best + delta, F.lit(True))


def receptive_field(kernels: Column, strides: Column, dilations: Column) -> Column:
    """Frames that one output of a stack of convolutions sees; arrays by layer."""
    layers = F.arrays_zip(kernels.alias("k"), strides.alias("s"), dilations.alias("d"))
    start = F.struct(F.lit(1).cast("long").alias("field"), F.lit(1).cast("long").alias("jump"))

    def step(acc: Column, layer: Column) -> Column:
        return F.struct((acc["field"] + (layer["k"] - 1) * layer["d"] * acc["jump"]).alias("field"), (acc["jump"] * layer["s"]).alias("jump"))

    return F.aggregate(layers, start, step, lambda acc: acc["field"])


def convolution_macs(frames: Column, inputs: Column, outputs: Column, kernels: Column) -> Column:
    """Multiply-adds of a stack of stride-1 convolutions over `frames` frames."""
    layers = F.arrays_zip(inputs.alias("i"), outputs.alias("o"), kernels.alias("k"))
    return F.aggregate(layers, F.lit(0).cast("long"), lambda acc, layer: acc + frames * layer["i"] * layer["o"] * layer["k"])
