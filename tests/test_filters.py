"""The block form of recursive filters and the one-pass peak count against plain loops."""

import numpy as np
import pytest

from spanmill.functions import signal as sg


def plain_section(b, a, x):
    y = []
    for i, v in enumerate(x):
        past = lambda values, k, i=i: values[i - k] if i >= k else 0.0
        y.append(b[0] * v + b[1] * past(x, 1) + b[2] * past(x, 2) - a[1] * past(y, 1) - a[2] * past(y, 2))
    return np.array(y)


def plain_peaks(x, prominence, distance, active):
    tops = [i for i in range(1, len(x) - 1) if x[i - 1] < x[i] >= x[i + 1]]
    kept = []
    for i in sorted(tops, key=lambda i: (-x[i], i)):
        if all(abs(i - j) >= distance for j in kept):
            kept.append(i)
    count = 0
    for i in kept:
        first, last = i, i
        while first > 0 and x[first - 1] <= x[i]:
            first -= 1
        while last < len(x) - 1 and x[last + 1] <= x[i]:
            last += 1
        count += x[i] - max(min(x[first : i + 1]), min(x[i : last + 1])) >= prominence and bool(active[i])
    return count


@pytest.mark.parametrize("size", [0, 1, 2, sg.BLOCK - 1, sg.BLOCK, sg.BLOCK + 1, 1000])
def test_sections_in_blocks(size):
    x = np.random.default_rng(size).normal(size=size)
    for b, a in sg._butter(2, (1.5, 9.0), 100.0):
        assert sg._section(b, a, x) == pytest.approx(plain_section(b, a, x), abs=1e-9)


def test_peaks_against_a_plain_count():
    rng = np.random.default_rng(5)
    for turn in range(600):
        size = int(rng.integers(3, 80))
        x = rng.integers(0, 6, size).astype(float) if turn % 2 else rng.normal(size=size)
        active, prominence, distance = rng.random(size) < 0.8, float(rng.choice([0.1, 1.0, 2.0])), int(rng.integers(1, 8))
        assert sg.peak_count(x, prominence, distance, active) == plain_peaks(x.tolist(), prominence, distance, active)


def test_a_flat_envelope_has_no_peaks():
    assert sg.peak_count(np.zeros(50), 0.1, 3) == 0
