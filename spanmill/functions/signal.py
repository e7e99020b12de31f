"""NumPy signal kernels for Arrow batches, where expressions do not reach: spectra, filters, alignment."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class MelConfig:
    """Fixed values of the log-mel features."""

    rate: int = 16000
    size: int = 400
    hop: int = 160
    mels: int = 80
    low: float = 0.0
    high: float = 8000.0
    offset: float = 1e-6


MEL = MelConfig()


def to_mono(x: np.ndarray) -> np.ndarray:
    return x.mean(axis=1) if x.ndim == 2 else x


def resampled(x: np.ndarray, rate: int, target: int, half: int = 32) -> np.ndarray:
    """Windowed-sinc resampling: round(n * target / rate) samples, low-passed at the lower Nyquist frequency."""
    if rate == target or x.size == 0:
        return x
    step = rate / target
    cut = min(1.0, target / rate)
    n = int(round(x.size * target / rate))
    reach = int(np.ceil(half / cut))
    out = np.empty(n)
    taps = np.arange(-reach, reach + 1)
    padded = np.pad(x.astype(np.float64), reach + 1)
    for first in range(0, n, 8192):
        at = np.arange(first, min(first + 8192, n)) * step
        base = np.floor(at).astype(np.int64)
        t = taps[None, :] - (at - base)[:, None]
        w = np.where(np.abs(t) <= reach, 0.5 + 0.5 * np.cos(np.pi * t / reach), 0.0) * cut * np.sinc(cut * t)
        out[first : first + at.size] = (padded[base[:, None] + taps[None, :] + reach + 1] * w).sum(axis=1) / w.sum(axis=1)
    return out


@functools.lru_cache(maxsize=4)
def mel_filters(c: MelConfig = MEL) -> np.ndarray:
    """(bins, mels) triangles on the scale 2595 log10(1 + f / 700), without area scaling."""
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    centres = 700 * (10 ** (np.linspace(to_mel(c.low), to_mel(c.high), c.mels + 2) / 2595) - 1)
    f = np.linspace(0, c.rate / 2, c.size // 2 + 1)[:, None]
    up = (f - centres[None, :-2]) / (centres[1:-1] - centres[:-2])
    down = (centres[None, 2:] - f) / (centres[2:] - centres[1:-1])
    return np.maximum(0, np.minimum(up, down))


@functools.lru_cache(maxsize=4)
def _hann(size: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)


def log_mel(x: np.ndarray, c: MelConfig = MEL) -> np.ndarray:
    """(1 + n // hop, mels): reflected ends, periodic Hann window, power spectrum, ln(mel + offset), in x's precision."""
    if x.dtype not in (np.float32, np.float64):
        x = x.astype(np.float64)
    if x.size <= c.size // 2:
        x = np.pad(x, (0, c.size // 2 + 1 - x.size))
    padded = np.pad(x, c.size // 2, mode="reflect")
    frames = np.lib.stride_tricks.sliding_window_view(padded, c.size)[:: c.hop]
    spectrum = np.fft.rfft(frames * _hann(c.size).astype(x.dtype), axis=1)
    power = spectrum.real**2 + spectrum.imag**2
    return np.log(power @ mel_filters(c).astype(power.dtype) + power.dtype.type(c.offset))


@functools.lru_cache(maxsize=16)
def _butter(order: int, edges: tuple[float, float], rate: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Second-order sections of a Butterworth band-pass by the bilinear transform."""
    low, high = (2 * rate * np.tan(np.pi * f / rate) for f in edges)
    wide, centre = high - low, np.sqrt(low * high)
    proto = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    half = proto * wide / 2
    root = np.sqrt(half**2 - centre**2)
    poles = np.concatenate((half + root, half - root))
    z = (2 * rate + poles) / (2 * rate - poles)
    z = z[np.argsort(-np.abs(z.imag))]
    upper = z[z.imag > 0] if np.any(z.imag > 1e-12) else z[::2]
    sections = [(np.array([1.0, 0.0, -1.0]), np.array([1.0, -2 * p.real, abs(p) ** 2])) for p in upper[:order]]
    w = np.exp(-2j * np.pi * np.sqrt(edges[0] * edges[1]) / rate)
    gain = abs(np.prod([(b[0] + b[1] * w + b[2] * w**2) / (a[0] + a[1] * w + a[2] * w**2) for b, a in sections]))
    return [(b / gain ** (1 / len(sections)), a) for b, a in sections]


#: Samples that a recursive filter takes at once.
BLOCK = 128


@functools.lru_cache(maxsize=64)
def _block(b: tuple[float, ...], a: tuple[float, ...]) -> tuple[np.ndarray, ...]:
    """A second-order section over BLOCK samples as matrices, by running it on unit samples and on unit states:
    samples -> outputs, state -> outputs, samples -> next state, state -> next state."""
    runs = np.vstack([np.zeros((2, BLOCK)), np.eye(BLOCK)])
    z1, z2 = np.zeros(BLOCK + 2), np.zeros(BLOCK + 2)
    z1[0] = z2[1] = 1.0
    y = np.empty_like(runs)
    for i in range(BLOCK):
        v = runs[:, i]
        y[:, i] = out = b[0] * v + z1
        z1, z2 = b[1] * v - a[1] * out + z2, b[2] * v - a[2] * out
    end = np.stack([z1, z2], axis=1)
    return y[2:], y[:2], end[2:], end[:2]


def _section(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The section's output from rest; only the state between blocks is carried one by one."""
    by_x, by_state, next_x, next_state = _block(tuple(b.tolist()), tuple(a.tolist()))
    blocks = np.pad(x, (0, -x.size % BLOCK)).reshape(-1, BLOCK)
    (p, q), (r, s) = next_state.tolist()
    states, z1, z2 = [], 0.0, 0.0
    for g1, g2 in (blocks @ next_x).tolist():
        states.append((z1, z2))
        z1, z2 = g1 + p * z1 + r * z2, g2 + q * z1 + s * z2
    return (blocks @ by_x + np.array(states).reshape(-1, 2) @ by_state).ravel()[: x.size]


def band_pass(x: np.ndarray, low: float, high: float, rate: float, order: int = 2) -> np.ndarray:
    """Zero-phase Butterworth band-pass: forward and backward over odd-reflected ends."""
    if x.size < 2:
        return np.zeros_like(x, dtype=np.float64)
    pad = min(x.size - 1, 3 * (2 * order + 1) * 4)
    y = np.concatenate((2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1])).astype(np.float64)
    for _ in range(2):
        for b, a in _butter(order, (low, high), rate):
            y = _section(b, a, y)
        y = y[::-1]
    return y[pad : pad + x.size]


def _bases(heights: np.ndarray, lows: np.ndarray) -> np.ndarray:
    """For each height the least value back to the nearest greater height, or to the start; lows[k] is the least value
    from height k - 1 up to height k."""
    out, higher = np.empty(heights.size), []
    for k, (height, low) in enumerate(zip(heights.tolist(), lows.tolist(), strict=True)):
        while higher and higher[-1][0] <= height:
            low = min(low, higher.pop()[1])
        higher.append((height, low))
        out[k] = low
    return out


def peak_count(x: np.ndarray, prominence: float, distance: int, active: np.ndarray | None = None) -> int:
    """Local maxima, thinned to the higher ones within `distance`, of at least a prominence, where active."""
    rise = np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] >= x[2:])) + 1
    if rise.size == 0:
        return 0
    near, kept = np.zeros(x.size, bool), np.zeros(rise.size, bool)
    for k in np.lexsort((rise, -x[rise])).tolist():
        at = int(rise[k])
        if not near[at]:
            kept[k] = True
            near[max(0, at - distance + 1) : at + distance] = True
    # Maxima and both ends; what lies between two of them is never a peak's wall, only its valley.
    nodes = np.concatenate(([0], rise, [x.size - 1]))
    valleys = np.minimum.reduceat(x, nodes)
    heights = x[nodes]
    left = _bases(heights, np.concatenate((heights[:1], np.minimum(valleys[:-1], heights[1:]))))
    right = _bases(heights[::-1], np.concatenate((valleys[-1:], valleys[:-1][::-1])))[::-1]
    tall = heights - np.maximum(left, right) >= prominence
    return int(np.sum(kept & tall[1:-1] & (True if active is None else active[rise])))


def reverberated(x: np.ndarray, response: np.ndarray) -> np.ndarray:
    """Convolved, aligned to the direct sound (the response's largest value), trimmed to the input's length."""
    n = 1 << int(np.ceil(np.log2(max(x.size + response.size - 1, 1))))
    y = np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(response, n), n)
    first = int(np.argmax(np.abs(response)))
    return y[first : first + x.size]


def viterbi(emission: np.ndarray, tokens: Sequence[int], blank: int) -> np.ndarray:
    """The likeliest frame labels that collapse to the tokens; raises ValueError if the frames are too few."""
    need = len(tokens) + sum(a == b for a, b in zip(tokens, tokens[1:], strict=False))
    if not tokens or emission.shape[0] < need:
        raise ValueError(f"{emission.shape[0]} frames for {need}")
    states = np.full(2 * len(tokens) + 1, blank)
    states[1::2] = tokens
    jump = np.zeros(states.size, bool)
    jump[3::2] = states[3::2] != states[1:-2:2]
    score = np.full(states.size, -np.inf)
    score[:2] = emission[0, states[:2]]
    back = np.zeros((emission.shape[0], states.size), np.int8)
    for t in range(1, emission.shape[0]):
        one = np.concatenate(([-np.inf], score[:-1]))
        two = np.where(jump, np.concatenate(([-np.inf, -np.inf], score[:-2])), -np.inf)
        options = np.stack([score, one, two])
        back[t] = options.argmax(axis=0)
        score = options.max(axis=0) + emission[t, states]
    at = states.size - 1 if score[-1] >= score[-2] else states.size - 2
    labels = np.empty(emission.shape[0], np.int64)
    for t in range(emission.shape[0] - 1, -1, -1):
        labels[t] = states[at]
        at -= int(back[t, at])
    return labels


def ctc_loss(emission: np.ndarray, tokens: Sequence[int], blank: int) -> float:
    """Negative log likelihood of the tokens over all paths (forward recursion); infinite if no path exists."""
    states = np.full(2 * len(tokens) + 1, blank)
    states[1::2] = tokens
    jump = np.zeros(states.size, bool)
    jump[3::2] = states[3::2] != states[1:-2:2]
    score = np.full(states.size, -np.inf)
    score[:2] = emission[0, states[:2]]
    for t in range(1, emission.shape[0]):
        one = np.concatenate(([-np.inf], score[:-1]))
        two = np.where(jump, np.concatenate(([-np.inf, -np.inf], score[:-2]))[: states.size], -np.inf)
        score = np.logaddexp(np.logaddexp(score, one), two) + emission[t, states]
    return float(-np.logaddexp(score[-1], score[-2]) if states.size > 1 else -score[-1])


def ctc_loss_udf(blank: int):
    """(emission, tokens) -> ctc_loss(); null without frames."""

    @F.pandas_udf(T.DoubleType())
    def run(emission: pd.Series, tokens: pd.Series) -> pd.Series:
        def one(e, t):
            if e is None or t is None or not len(e):
                return None
            return ctc_loss(np.array([np.asarray(r, np.float64) for r in e]), [int(x) for x in t], blank)

        return pd.Series([one(e, t) for e, t in zip(emission, tokens, strict=True)], dtype="float64")

    return run


def log_mel_udf(c: MelConfig = MEL):
    """samples -> frames of mels. Arrow in and out: no Python object per frame or number."""

    @F.arrow_udf(T.ArrayType(T.ArrayType(T.FloatType())))
    def run(x: pa.Array) -> pa.Array:
        lengths = x.value_lengths().fill_null(0).to_numpy()
        flat, at = x.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(lengths)))
        known = x.is_valid().to_numpy(zero_copy_only=False)
        rows = [log_mel(flat[a:b], c).astype(np.float32) if ok else np.empty((0, c.mels), np.float32) for a, b, ok in zip(at[:-1], at[1:], known, strict=True)]
        frames = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
        numbers = np.concatenate(rows).ravel() if rows else np.empty(0, np.float32)
        inner = pa.ListArray.from_arrays(pa.array(np.arange(frames[-1] + 1, dtype=np.int32) * c.mels), pa.array(numbers))
        return pa.ListArray.from_arrays(pa.array(frames), inner, mask=pa.array(~known))

    return run


def log_mel_pcm_udf(c: MelConfig = MEL):
    """16-bit PCM bytes -> float16 frames as bytes, (1 + n // hop) * mels numbers a row: the storage form of features.

    Binary in and out: neither Spark nor Python touches single numbers.
    """

    @F.arrow_udf(T.BinaryType())
    def run(x: pa.Array) -> pa.Array:
        out = [None if v is None else log_mel(np.frombuffer(v, "<i2").astype(np.float32) / 32768, c).astype(np.float16).tobytes() for v in x.to_pylist()]
        return pa.array(out, pa.binary())

    return run


def band_pass_udf(low: float, high: float, rate: float, order: int = 2):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else band_pass(np.asarray(v, np.float64), low, high, rate, order))

    return run


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def reverberated_udf(x: pd.Series, response: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else reverberated(np.asarray(a, np.float64), np.asarray(b, np.float64)) for a, b in zip(x, response, strict=True)])


def syllable_udf(rate: float, low: float = 1.5, high: float = 9.0, prominence: float = 1.0, distance_sec: float = 0.1, floor_db: float = -40.0):
    """log envelope -> syllables: band-pass, peaks with prominence and distance where the level is near the maximum."""

    @F.pandas_udf(T.IntegerType())
    def run(s: pd.Series) -> pd.Series:
        def one(v):
            if v is None or len(v) < 3:
                return 0
            x = np.asarray(v, np.float64)
            y = band_pass(x, low, min(high, rate / 2 * 0.95), rate)
            return peak_count(y, prominence, max(1, round(distance_sec * rate)), x > x.max() + floor_db)

        return s.map(one).astype("int32")

    return run


def aligned_udf(blank: int):
    """(emission, tokens) -> frame spans of the tokens as (token, start, end), or null if they do not fit."""
    kind = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("token", "start", "end")]))

    @F.pandas_udf(kind)
    def run(emission: pd.Series, tokens: pd.Series) -> pd.Series:
        def one(e, t):
            try:
                labels = viterbi(np.array([np.asarray(r, np.float64) for r in e]), [int(x) for x in t], blank)
            except ValueError:
                return None
            cut = np.flatnonzero(np.diff(labels)) + 1
            edges = [0, *cut.tolist(), labels.size]
            return [{"token": int(labels[a]), "start": a, "end": b} for a, b in zip(edges, edges[1:], strict=False) if labels[a] != blank]

        return pd.Series([one(e, t) for e, t in zip(emission, tokens, strict=True)])

    return run
