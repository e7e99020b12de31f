"""Array kernels as expressions: frames, energy, mixing, masks, sequence state. No Python in the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanmill.functions.numeric import decibels


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def power(x: Column) -> Column:
    """Mean square; 0 for an empty array."""
    return F.when(F.size(x) == 0, 0.0).otherwise(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / F.size(x))


def mean(x: Column) -> Column:
    return F.try_divide(total(x), F.size(x).cast("double"))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: a lambda's argument is, an expression that occurs twice is not."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sorted_quantile(s: Column, q: float) -> Column:
    """Linear-interpolation quantile of a sorted array without nulls; null if it is empty."""
    at = (F.size(s) - 1) * F.lit(float(q))
    low = F.floor(at).cast("int")
    weight = at - low
    return F.when(F.size(s) > 0, F.get(s, low) * (1 - weight) + F.coalesce(F.get(s, low + 1), F.get(s, low)) * weight)


def quantile(x: Column, q: float) -> Column:
    return let(F.array_sort(x), lambda s: sorted_quantile(s, q))


def frames(x: Column, size: int) -> Column:
    """Consecutive frames without overlap; the rest is dropped. Fewer samples than a frame are one short frame."""
    count = F.floor(F.size(x) / size).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.slice(x, i * size + 1, F.lit(size)))
    return F.when(count > 0, cut).otherwise(F.array(F.when(F.size(x) > 0, x).otherwise(F.array(F.lit(0.0)))))


def frame_rms(x: Column, size: int, hop: int) -> Column:
    """Root mean square of overlapping full frames; empty if there is none."""
    count = F.floor((F.size(x) - size) / hop).cast("int") + 1
    cut = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.sqrt(power(F.slice(x, i * hop + 1, F.lit(size)))))
    return F.when(F.size(x) >= size, cut).otherwise(F.array().cast("array<double>"))


def log_envelope(rms: Column, floor_db: float = -60.0) -> Column:
    """20 log10, not below floor_db under the maximum."""
    least = F.greatest(F.array_max(rms), F.lit(1e-10)) * 10 ** (floor_db / 20)
    # The floor is an array of its own, not let(): Spark does not find a Python function over nested lambdas in its input.
    return F.zip_with(rms, F.array_repeat(least, F.size(rms)), lambda v, low: 20 * F.log10(F.greatest(v, low)))


def smoothed(x: Column, radius: int) -> Column:
    """Moving average of 2 radius + 1 values; the ends repeat."""
    last = F.size(x) - 1
    clamp = lambda i: F.least(F.greatest(i, F.lit(0)), last)
    around = F.sequence(F.lit(-radius), F.lit(radius))
    return F.transform(x, lambda _, i: F.aggregate(around, F.lit(0.0), lambda a, k: a + F.get(x, clamp(i + k))) / (2 * radius + 1))


def rising_crossings(x: Column, min_distance: int, active: Column | None = None) -> Column:
    """Counts rises from at most 0 to above 0, thinned greedily: one counts only if the last counted one is at least
    `min_distance` samples back; samples that are not active never count."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-(10**9)).alias("last"))
    on = (lambda i: F.get(active, i)) if active is not None else (lambda i: F.lit(True))

    def step(acc: Column, i: Column) -> Column:
        hit = (F.get(x, i - 1) <= 0) & (F.get(x, i) > 0) & on(i) & (i - acc["last"] >= min_distance)
        return F.struct((acc["n"] + hit.cast("int")).alias("n"), F.when(hit, i).otherwise(acc["last"]).alias("last"))

    inner = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(x) - 1, F.lit(1))), start, step, lambda acc: acc["n"])
    return F.when(F.size(x) > 1, inner).otherwise(0)


def local_maxima(x: Column) -> Column:
    """Inner samples above the one before and not below the one after."""
    hit = lambda i: ((F.get(x, i) > F.get(x, i - 1)) & (F.get(x, i) >= F.get(x, i + 1))).cast("int")
    inner = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(x) - 2, F.lit(1))), F.lit(0), lambda a, i: a + hit(i))
    return F.when(F.size(x) > 2, inner).otherwise(0)


def energy(x: Column, frame: int = 320, rel_db: float = 15.0, abs_db: float = -45.0) -> Column:
    """Levels of a waveform in dB of full scale, quantiles over frames, and the shares of loud frames."""
    share = lambda db, level: F.size(F.filter(db, lambda v: v > level)) / F.size(db)
    peak = F.array_max(F.transform(x, F.abs))

    def levels(db: Column) -> Column:
        return F.struct(
            decibels(power(x)).alias("rms_db"),
            F.when(F.size(x) > 0, 20 * F.log10(peak + 1e-10)).otherwise(-200.0).alias("peak_db"),
            *(sorted_quantile(db, q / 100).alias(f"frame_p{q}") for q in (10, 50, 90, 99)),
            (sorted_quantile(db, 0.95) - sorted_quantile(db, 0.10)).alias("frame_range"),
            let(sorted_quantile(db, 0.10), lambda floor: share(db, floor + rel_db)).alias("rel_share"),
            share(db, F.lit(abs_db)).alias("abs_share"),
        )

    return let(F.array_sort(F.transform(frames(x, frame), lambda f: decibels(power(f)))), levels)


def waveform_stats(x: Column, threshold: float = 1e-3) -> Column:
    return F.struct(
        F.sqrt(power(x)).alias("rms"),
        F.array_max(F.transform(x, F.abs)).alias("peak"),
        (F.size(F.filter(x, lambda v: F.abs(v) < threshold)) / F.size(x)).alias("silent_share"),
    )


def frame_output_stats(x: Column, thresholds=(0.01, 0.05)) -> Column:
    """Sum, quantiles, the share of the top tenth, and the shares over thresholds, of per-frame outputs."""

    def stats(s: Column) -> Column:
        top = F.slice(F.reverse(s), F.lit(1), F.greatest(F.ceil(F.size(s) * 0.1).cast("int"), F.lit(1)))
        return F.struct(
            F.size(s).alias("frames"),
            total(s).alias("sum"),
            mean(s).alias("mean"),
            sorted_quantile(s, 0.5).alias("median"),
            sorted_quantile(s, 0.9).alias("p90"),
            sorted_quantile(s, 0.99).alias("p99"),
            F.array_max(s).alias("max"),
            F.array_min(s).alias("min"),
            F.when(total(s) > 0, total(top) / total(s)).alias("top_tenth_share"),
            *((F.size(F.filter(s, lambda v: v > t)) / F.size(s)).alias(f"over_{t:g}".replace(".", "p")) for t in thresholds),
        )

    return let(F.array_sort(x), stats)


def fitted(noise: Column, size: Column, offset: Column) -> Column:
    """`size` samples of a noise from `offset` on, repeated as needed."""
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.get(noise, F.pmod(offset + i, F.size(noise)).cast("int")))


def mixed_at(signal: Column, noise: Column, snr_db: Column) -> Column:
    """signal + noise at a signal-to-noise ratio; a silent signal or noise leaves the signal as it is."""
    scale = F.sqrt(power(signal) / (power(noise) * F.pow(F.lit(10.0), snr_db / 10)))
    loud = (power(signal) > 0) & (power(noise) > 0)
    return F.when(loud, let(scale, lambda k: F.zip_with(signal, noise, lambda a, b: a + k * b))).otherwise(signal)


def gained(x: Column, gain_db: Column, limit: float | None = 0.99) -> Column:
    """A gain in dB, reduced so that the peak stays within the limit."""
    scale = F.pow(F.lit(10.0), gain_db / 20)
    peak = F.array_max(F.transform(x, F.abs)) * scale
    kept = F.when(peak > limit, scale * limit / peak).otherwise(scale) if limit is not None else scale
    return let(kept, lambda k: F.transform(x, lambda v: v * k))


def masked(x: Column, first: Column, width: Column, value: float = 0.0) -> Column:
    """Elements [first, first + width) replaced."""
    return F.transform(x, lambda v, i: F.when((i >= first) & (i < first + width), F.lit(value)).otherwise(v))


def normalized(x: Column, means: Column, stds: Column) -> Column:
    centred = F.zip_with(x, means, lambda a, b: a - b)
    return F.zip_with(centred, stds, lambda a, b: a / F.when(b > 0, b).otherwise(1.0))


def padded(x: Column, size: Column, value: float = 0.0) -> Column:
    more = F.greatest(size - F.size(x), F.lit(0)).cast("int")
    return F.concat(x, F.array_repeat(F.lit(value), more))


def listening_level(x: Column, peak: float = 0.9, silence: int = 0) -> Column:
    """Scaled to a peak, with silence on both sides; a silent waveform is not scaled."""
    top = F.array_max(F.transform(x, F.abs))
    scaled = F.transform(x, lambda v: F.when(top > 0, v * peak / top).otherwise(v))
    quiet = F.array_repeat(F.lit(0.0), F.lit(silence))
    return F.concat(quiet, scaled, quiet)


def channel_mean(channels: Column) -> Column:
    """The mean of equally long channels, sample by sample."""
    first = F.get(channels, F.lit(0))
    return F.transform(first, lambda _, i: F.aggregate(channels, F.lit(0.0), lambda a, c: a + F.get(c, i)) / F.size(channels))


def pieces_joined(pieces: Column, gap: int) -> Column:
    """Arrays put one behind the other with `gap` zeros between."""
    quiet = F.array_repeat(F.lit(0.0), F.lit(gap))
    return F.flatten(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(quiet, p))))
