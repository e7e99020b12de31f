"""Text functions: kana units, normalisation, edit distance, label sequences, names."""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters that make up readings, and those that join the character before them.
KANA = "ァ-ヺー"
SMALL = "ャュョァィゥェォヮ"
LONG_MARK, NASAL, GEMINATE = "ー", "ン", "ッ"
CHUNK_BREAKS = "。．！？!?、，,・…　 \t\n"
NOT_TEXT_TOKENS = ("|", "[UNK]", "[PAD]")
_FULL = f"[{KANA}&&[^{SMALL}]]"
_KATAKANA = "".join(chr(c) for c in range(0x30A1, 0x30F7))
_HIRAGANA = "".join(chr(c - 0x60) for c in range(0x30A1, 0x30F7))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition; neither Spark nor the oracle has it built in."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def byte_chunks(text: Column, most: int = 2048) -> Column:
    """Pieces of at most `most` UTF-8 bytes, cut behind a break character where one is in reach, else anywhere."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(s: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            out, rest = [], x
            while len(rest.encode()) > most:
                fits = len(rest.encode()[:most].decode(errors="ignore")) or 1
                breaks = max(rest.rfind(c, 0, fits) for c in CHUNK_BREAKS)
                at = breaks + 1 if breaks >= 0 else fits
                out.append(rest[:at])
                rest = rest[at:]
            return out + [rest] * bool(rest)

        return s.map(one)

    return cut(text)


def reading_only(s: Column) -> Column:
    """Drops punctuation, separators and control characters."""
    return F.regexp_replace(s, r"[\p{P}\p{Z}\p{C}]", "")


def has_other(kana: Column) -> Column:
    """Whether any character is neither katakana nor the long mark."""
    return kana.rlike(f"[^{KANA}]")


def unit_count(kana: Column) -> Column:
    """Units (morae): kana less small ones that follow a kana which is not small."""
    return F.regexp_count(kana, F.lit(f"[{KANA}]")) - F.regexp_count(kana, F.lit(f"(?<={_FULL})[{SMALL}]"))


def units(kana: Column) -> Column:
    """The units as an array; its size is unit_count()."""
    return F.regexp_extract_all(kana, F.lit(f"{_FULL}[{SMALL}]?|[{SMALL}]"), F.lit(0))


def to_hiragana(kana: Column) -> Column:
    return F.translate(kana, _KATAKANA, _HIRAGANA)


def to_katakana(kana: Column) -> Column:
    return F.translate(kana, _HIRAGANA, _KATAKANA)


def annotation(s: Column) -> Column:
    """An annotated reading as katakana only."""
    return F.regexp_replace(to_katakana(nfkc(s)), f"[^{KANA}]", "")


def in_vocabulary(kana: Column, vocabulary: Sequence[str], fallback: Mapping[str, str]) -> Column:
    """Hiragana characters of a vocabulary, by a fallback where a character is missing; others are dropped."""
    known = F.array(*map(F.lit, sorted(set(vocabulary) - set(NOT_TEXT_TOKENS))))
    chars = F.transform(F.filter(F.split(to_hiragana(kana), ""), lambda c: c != ""), lambda c: _replaced(c, known, fallback))
    return F.array_join(F.filter(chars, lambda c: F.array_contains(known, c)), "")


def _replaced(c: Column, known: Column, fallback: Mapping[str, str]) -> Column:
    out = c
    for a, b in fallback.items():
        out = F.when((c == a) & ~F.array_contains(known, c), F.lit(b)).otherwise(out)
    return out


def unit_tokens(unit: Column, ids: Mapping[str, int], fallback: Mapping[str, str]) -> Column:
    """Token ids of a unit's characters; null if any has none."""
    known = F.create_map(*(F.lit(x) for kv in ids.items() for x in kv))
    keys = F.array(*map(F.lit, ids))
    got = F.transform(F.filter(F.split(to_hiragana(unit), ""), lambda c: c != ""), lambda c: F.try_element_at(known, _replaced(c, keys, fallback)))
    return F.when(F.forall(got, lambda x: x.isNotNull()), got)


def unit_class(unit: Column) -> Column:
    """Flags of a unit: long vowel, nasal, geminate, any of these, contracted."""
    flags = {"long": unit == LONG_MARK, "nasal": unit == NASAL, "geminate": unit == GEMINATE}
    special = unit.isin(LONG_MARK, NASAL, GEMINATE)
    contracted = (F.length(unit) == 2) & F.substring(unit, 2, 1).isin(*SMALL)
    return F.struct(*(v.alias(k) for k, v in flags.items()), special.alias("special"), contracted.alias("contracted"))


#: Classes of characters: not kana, kana that begin a unit (the last three alone are special), small ones; left out.
_OTHER, _PLAIN, _LONG, _NASAL, _GEMINATE, _SMALL_ONE, _OUT = range(7)
_BEGIN = slice(_PLAIN, _SMALL_ONE)
#: Bytes of text whose classes are held at a time; the rest of a batch is held in Arrow.
_CLASS_BYTES = 1 << 20
_COUNTS = ("long", "nasal", "geminate", "special", "contracted", "units")


def _class_table(spelling: Mapping[str, str] | None) -> np.ndarray:
    """Classes by code point; the last one is that of all code points beyond."""
    of = {chr(c): _PLAIN for c in [*range(ord("ァ"), ord("ヺ") + 1)]} | dict.fromkeys(SMALL, _SMALL_ONE) | {LONG_MARK: _LONG, NASAL: _NASAL, GEMINATE: _GEMINATE}
    rest = _OTHER if spelling is None else _OUT
    if spelling is not None:
        of = {c: of.get(k, _OTHER) for c, k in spelling.items()}
    table = np.full(max(map(ord, of), default=0) + 2, rest, np.uint8)
    for c, k in of.items():
        table[ord(c)] = k
    return table


def _class_counts(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    """A row a text, a column for each of _COUNTS: each character's class and whether a small one follows, counted."""
    rows = [(x or b"").decode("utf-8", "replace") for x in texts.cast(pa.large_binary()).to_pylist()]
    codes = np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32)
    kinds, ends = table[np.minimum(codes, table.size - 1)], np.cumsum([len(x) for x in rows])
    kept = np.flatnonzero(kinds != _OUT)
    kinds, ends = kinds[kept], np.searchsorted(kept, ends)
    before = np.zeros(kinds.size, np.uint8)
    before[:-1] = kinds[1:] == _SMALL_ONE
    lengths = np.diff(ends, prepend=0)
    before[ends[lengths > 0] - 1] = 0
    keys = np.repeat(np.arange(len(rows)) * (2 * _OUT), lengths) + (kinds + before * np.uint8(_OUT))
    alone, joined = np.bincount(keys, minlength=len(rows) * 2 * _OUT).reshape(-1, 2, _OUT).transpose(1, 0, 2)
    special = alone[:, _LONG : _GEMINATE + 1]
    contracted = joined[:, _BEGIN].sum(axis=1)
    smalls = alone[:, _SMALL_ONE] + joined[:, _SMALL_ONE]
    return np.column_stack((special, special.sum(axis=1), contracted, alone[:, _BEGIN].sum(axis=1) + smalls))


def special_counts(kana: Column, spelling: Mapping[str, str] | None = None) -> Column:
    """How many units of a reading are of each class, in one pass over its characters.

    spelling: the kana of the characters that have any; the others are left out of the reading.
    """
    table = _class_table(spelling)

    @F.arrow_udf(T.StructType([T.StructField(n, T.LongType()) for n in _COUNTS]))
    def counts(texts: pa.Array) -> pa.Array:
        place = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // _CLASS_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(texts)]
        found = np.concatenate([_class_counts(texts.slice(a, b - a), table) for a, b in zip(cuts, cuts[1:], strict=False)])
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found.T], names=list(_COUNTS), mask=texts.is_null())

    return counts(kana)


def word_lengths(readings: Column) -> Column:
    """Units of each word's reading, without words of none."""
    return F.filter(F.transform(readings, unit_count), lambda n: n > 0)


def error_rate(ref: Column, hyp: Column) -> Column:
    """Edit distance over the reference's characters; for an empty reference 0 if both are empty, else 1."""
    some = F.levenshtein(ref, hyp) / F.greatest(F.length(ref), F.lit(1))
    return F.when(ref == "", F.when(hyp == "", 0.0).otherwise(1.0)).otherwise(some)


@F.pandas_udf(T.IntegerType())
def token_distance(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """Edit distance of token arrays: a row of the table at a time; insertions are a running minimum along the row."""

    def one(a, b):
        if a is None or b is None:
            return None
        ids: dict = {}
        x, y = (np.array([ids.setdefault(t, len(ids)) for t in v], np.int64) for v in (a, b))
        steps = np.arange(y.size + 1)
        row = steps
        for i, token in enumerate(x, 1):
            best = np.minimum(row[1:] + 1, row[:-1] + (y != token))
            row = np.minimum.accumulate(np.concatenate(([i], best)) - steps) + steps
        return int(row[-1])

    return pd.Series([one(a, b) for a, b in zip(ref, hyp, strict=True)], dtype="Int32")


def collapsed(labels: Column, blank) -> Column:
    """Merges repeats, then drops blanks."""
    changed = F.filter(labels, lambda x, i: (i == 0) | (x != F.get(labels, i - 1)))
    return F.filter(changed, lambda x: x != F.lit(blank))


def token_text(tokens: Column, names: Mapping[int, str]) -> Column:
    known = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.array_join(F.filter(F.transform(tokens, lambda t: F.element_at(known, t)), lambda t: ~t.isin(*NOT_TEXT_TOKENS)), "")


_EDITS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("op", "gold", "estimate")]))


def _gaps(blocks: list, n: int, m: int) -> tuple[np.ndarray, ...]:
    """Windows (a from, a to, b from, b to) between blocks (i, j, length), without those that are empty on a side."""
    rows = np.array(sorted(blocks), np.int64).reshape(-1, 3)
    a0, b0 = np.append(0, rows[:, 0] + rows[:, 2]), np.append(0, rows[:, 1] + rows[:, 2])
    a1, b1 = np.append(rows[:, 0], n), np.append(rows[:, 1], m)
    some = (a1 > a0) & (b1 > b0)
    return a0[some], a1[some], b0[some], b1[some]


def _places(lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the windows [lo, hi) that have room for `length`, and the window of each."""
    room = np.maximum(hi - lo - length + 1, 0)
    window = np.repeat(np.arange(lo.size), room)
    return np.arange(window.size) - np.repeat(np.cumsum(room) - room, room) + lo[window], window


def matching_blocks(a: str, b: str) -> list[tuple[int, int, int]]:
    """The blocks (i, j, length) of difflib.SequenceMatcher(None, a, b, autojunk=False), in order.

    difflib splits each window at its longest block (ties: first in a, then in b), in a time that grows with the square
    of a text and more. Here all windows are split together, longest blocks first: of one length, a window's blocks are
    the first ones of a scan from left to right, and what lies between them has shorter blocks only.
    """
    codes = np.frombuffer((a + b).encode("utf-32-le", "surrogatepass"), np.uint32)
    n, m = len(a), len(b)
    top = n + m + 1
    #: Names of the substrings of 1, 2, 4, ... characters at each place; one that runs over the end is never looked up.
    names = [np.unique(codes, return_inverse=True)[1].astype(np.int64)]

    def shared(length, windows):
        """Places in `a` whose substring is in their window of `b`: place, window, from and to in the last, places in `b`."""
        a0, a1, b0, b1 = windows
        i, u = _places(a0, a1, length)
        j, v = _places(b0, b1, length)
        if not i.size or not j.size:
            return None
        k = length.bit_length() - 1
        while len(names) <= k:
            step = 1 << (len(names) - 1)
            pair = names[-1] * top
            pair[: max(pair.size - step, 0)] += names[-1][step:] + 1
            names.append(np.unique(pair, return_inverse=True)[1].astype(np.int64))
        name, rest = names[k], length - (1 << k)
        ka, kb = ((name[p] * top + name[p + rest]) if rest else name[p] for p in (i, n + j))
        if top**2 * (a0.size + 1) >= 1 << 62:
            both = np.unique(np.concatenate((ka, kb)), return_inverse=True)[1].astype(np.int64)
            ka, kb = both[: ka.size], both[ka.size :]
        ka, kb = ka * a0.size + u, kb * a0.size + v
        order = np.argsort(kb, kind="stable")
        kb = kb[order]
        first = np.searchsorted(kb, ka)
        hit = np.flatnonzero(kb[np.minimum(first, kb.size - 1)] == ka)
        if not hit.size:
            return None
        return i[hit].tolist(), u[hit].tolist(), first[hit].tolist(), np.searchsorted(kb, ka[hit], "right").tolist(), j[order].tolist()

    def longest(low, high, windows):
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if shared(mid, windows) else (low, mid - 1)
        return low

    blocks: list[tuple[int, int, int]] = []
    windows, high = _gaps(blocks, n, m), 1
    while high <= min(n, m) and shared(high, windows):
        high *= 2
    length = longest(high // 2, min(high - 1, n, m), windows)
    while length:
        if found := shared(length, windows):
            at, last = found[4], None
            for i, w, begin, end in zip(*found[:4], strict=True):
                if w != last:
                    last, least_i, least_j = w, 0, 0
                if i >= least_i and (t := bisect_left(at, least_j, begin, end)) < end:
                    blocks.append((i, at[t], length))
                    least_i, least_j = i + length, at[t] + length
            windows = _gaps(blocks, n, m)
        length = longest(0, length - 1, windows) if length > 32 else length - 1
    return sorted(blocks)


#: Texts whose edits are held as Python values at a time; the rest of a batch is held in Arrow.
_EDIT_ROWS = 64


@F.arrow_udf(_EDITS)
def edits(gold: pa.Array, estimate: pa.Array) -> pa.Array:
    """What turns one text into the other, without the equal parts: difflib's, at the length of documents."""
    kind = pa.struct([(n, pa.string()) for n in ("op", "gold", "estimate")])

    def some(golds, estimates):
        ops, ones, others, ends = [], [], [], [0]
        for a, b in zip(golds.to_pylist(), estimates.to_pylist(), strict=True):
            i = k = 0
            for j, m, length in [*matching_blocks(a, b), (len(a), len(b), 0)] if a is not None and b is not None else ():
                if i < j or k < m:
                    ops.append("replace" if i < j and k < m else "delete" if i < j else "insert")
                    ones.append(a[i:j])
                    others.append(b[k:m])
                i, k = j + length, m + length
            ends.append(len(ops))
        flat = pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in (ops, ones, others)], fields=list(kind))
        missing = pc.or_(golds.is_null(), estimates.is_null())
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, mask=missing)

    parts = [some(gold.slice(at, _EDIT_ROWS), estimate.slice(at, _EDIT_ROWS)) for at in range(0, len(gold), _EDIT_ROWS)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(kind))


def one_line(s: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(s, r"\s+", " ")), "^ | $", "")


def stem(path: Column) -> Column:
    """The file name without its last extension."""
    name = F.substring_index(path, "/", -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def safe_head(s: Column, n: int = 12) -> Column:
    """The first characters that are safe in a file name."""
    return F.substring(F.regexp_replace(s, r"[^\p{L}\p{N}_-]", ""), 1, n)


def transcript_rate(transcript: Column, seconds: Column) -> Column:
    """Units a second of a kana transcript; 0 for a blank one."""
    return F.when(F.trim(transcript) == "", 0.0).otherwise(unit_count(transcript) / seconds)


def short_number(x: Column) -> Column:
    """5.0 -> 5, 1.5 -> 1.5."""
    return F.regexp_replace(x.cast("double").cast("string"), r"\.0$", "")


def condition_name(speed: Column) -> Column:
    return F.concat(F.lit("x"), short_number(speed))


def noisy_name(split: Column, snr: Column) -> Column:
    return F.concat(split, F.lit("_snr"), short_number(snr), F.lit("db"))


def digit_run(s: Column) -> Column:
    """Whether three ASCII digits follow each other."""
    return s.rlike("[0-9]{3,}")


def parsed_seconds(s: Column) -> Column:
    """Seconds of 'm:ss', 'h:mm:ss' or plain minutes; null if it reads as none."""
    parts = F.split(F.trim(s), ":")
    number = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("int")
    one = F.trim(s).try_cast("int") * 60
    two = number(1) * 60 + number(2)
    three = number(1) * 3600 + number(2) * 60 + number(3)
    plain = F.trim(s).rlike(r"^[0-9]+(:[0-5]?[0-9]){0,2}$")
    return F.when(plain, F.when(F.size(parts) == 1, one).when(F.size(parts) == 2, two).otherwise(three))
