"""NumPy kernels on the UTF-8 bytes of Arrow string columns: words, fingerprints, shingles. No Spark here."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text that a kernel handles at once; a longer text is handled alone.
SLICE_BYTES = 1 << 20
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_U = np.uint64
_rng = np.random.default_rng(20240607)
BASES = _rng.integers(1 << 62, 1 << 63, 2, dtype=np.uint64) | _U(1)
_PLACES = _rng.integers(1 << 62, 1 << 63, (2, 64), dtype=np.uint64) | _U(1)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and each row's offset in them."""
    if len(col) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    at = np.frombuffer(col.buffers()[1], dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def sliced(batch: pa.RecordBatch, col: str, most: int = SLICE_BYTES):
    """Consecutive parts of a batch with about `most` bytes in `col`; every row is in exactly one part."""
    n = batch.num_rows
    _, at = utf8(batch.column(batch.schema.get_field_index(col)))
    first = 0
    while first < n:
        last = int(np.searchsorted(at, at[first] + most, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield batch.slice(first, last - first)
        first = last


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and each row's offset in them."""
    if data.size == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(at.size, np.int64)
    sep = _SEPARATOR[data]
    before = np.empty(sep.size, bool)
    before[0] = True
    before[1:] = sep[:-1]
    before[at[:-1][at[:-1] < sep.size]] = True
    after = np.empty(sep.size, bool)
    after[-1] = True
    after[:-1] = sep[1:]
    after[at[1:][at[1:] > 0] - 1] = True
    starts = np.flatnonzero(~sep & before)
    ends = np.flatnonzero(~sep & after) + 1
    return starts, ends, np.searchsorted(starts, at)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit avalanche."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def word_prints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit fingerprint of each word, by one of two independent bases."""
    if starts.size == 0:
        return np.empty(0, np.uint64)
    size = ends - starts
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    letters = data[np.repeat(starts, size) + place].astype(np.uint64) + _U(1)
    powers = np.full(int(size.max()), BASES[which], np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    total = np.add.reduceat(letters * powers[place], first)
    return mixed(total ^ (size.astype(np.uint64) * _U(0x9E3779B97F4A7C15)))


def run_prints(prints: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Fingerprints of all `size` consecutive words, by their first word; no regard to rows."""
    n = prints.size - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total += prints[j : j + n] * _PLACES[which, j]
    return mixed(total)


def starts_of_runs(at: np.ndarray, size: int) -> np.ndarray:
    """Word positions at which `size` words of one row begin."""
    n = int(at[-1])
    room = np.repeat(at[1:], np.diff(at)) - np.arange(n)
    return np.flatnonzero(room >= size)
