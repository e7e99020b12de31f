"""Language identification by bit-sliced Bloom filters of character n-grams."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.llm.shared import Staging, key_hash, named
from spanmill.llm.textbytes import mixed, sliced, utf8

GRAM = 4
#: The bounded fit: at most about this many labelled documents a language, chosen by a hash of the id.
SAMPLE_DOCS = 4000
#: Slots for an n-gram of the language with the most of them, at least, and the slots that each n-gram sets.
SLOTS_A_GRAM = 8
LEAST_SLOTS = 1 << 16
HASHES = 2
#: Languages in one word of a slot.
WORD = 64
UNKNOWN = "und"
_U = np.uint64
_PLACE = np.random.default_rng(77).integers(1 << 62, 1 << 63, GRAM, dtype=np.uint64) | _U(1)


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Every code point's lower-case letter, 0 for what is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of all n-grams of letters and single gaps, each row's offset in them, and which rows have letters.

    Runs of other characters are one gap. A row is framed by a gap before it and two behind it, so that a single letter
    has an n-gram too.
    """
    rows = at.size - 1
    lead = (data & 0xC0) != 0x80
    chars = np.concatenate(([0], np.cumsum(lead)))[at]
    codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    doc = np.repeat(np.arange(rows), np.diff(chars))
    framed = np.zeros(codes.size + 2 * rows, np.uint32)
    framed[np.arange(codes.size) + 2 * doc + 1] = _letters()[codes]
    first = chars[:-1] + 2 * np.arange(rows)
    keep = framed != 0
    lettered = np.add.reduceat(keep, first) > 0 if rows else np.empty(0, bool)
    keep[1:] |= framed[:-1] != 0
    keep[first] = True
    place = np.concatenate(([0], np.cumsum(keep)))
    begin = place[np.append(first, framed.size)]
    stream = np.append(framed[keep], np.uint32(0)).astype(np.uint64)
    n = stream.size - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.zeros(rows + 1, np.int64), lettered
    total = np.zeros(n, np.uint64)
    for j in range(GRAM):
        total += stream[j : j + n] * _PLACE[j]
    # The second gap behind a row is the one that frames the next row.
    room = np.where(lettered, np.maximum(np.diff(begin) + 1 - GRAM + 1, 0), 0)
    offset = np.concatenate(([0], np.cumsum(room)))
    index = np.arange(offset[-1]) - np.repeat(offset[:-1], room) + np.repeat(begin[:-1], room)
    return mixed(total[index]), offset, lettered


@dataclass(frozen=True)
class LanguageFilters:
    """One Bloom filter a language, bit-sliced: a slot holds a bit per language, in as many words as it takes, so that
    the AND of an n-gram's slots is the set of all languages that contain it."""

    languages: tuple[str, ...]
    #: An array of slots for each WORD languages, in the least integer type that holds them.
    words: tuple[np.ndarray, ...]
    false_rate: np.ndarray


def slots_for(most: int) -> int:
    """Slots of filters whose fullest holds `most` n-grams: a power of two."""
    return max(LEAST_SLOTS, 1 << int(np.ceil(np.log2(max(SLOTS_A_GRAM * most, 1)))))


def _places(prints: np.ndarray, slots: int) -> list[np.ndarray]:
    return [((prints >> _U(32 * i)) & _U(slots - 1)).astype(np.int64) for i in range(HASHES)]


def assembled(languages: Sequence[str], words: Sequence[np.ndarray]) -> LanguageFilters:
    """Filters from 64-bit words of slots: narrowed to the languages' number, with the rate at which an n-gram that a
    language does not contain passes its filter."""
    languages = tuple(languages)
    kind = next(k for k, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if min(len(languages), WORD) <= bits)
    words = tuple(w.astype(kind) for w in words)
    filled = [np.count_nonzero(words[i // WORD] & kind(1 << (i % WORD))) / words[0].size for i in range(len(languages))]
    return LanguageFilters(languages, words, np.array(filled) ** HASHES)


def build_filters(profiles: dict[str, np.ndarray]) -> LanguageFilters:
    """Filters of n-grams that are at hand."""
    languages = sorted(profiles)
    slots = slots_for(max((profiles[x].size for x in languages), default=0))
    words = [np.zeros(slots, np.uint64) for _ in range(-(-len(languages) // WORD))]
    for i, language in enumerate(languages):
        for place in _places(profiles[language], slots):
            words[i // WORD][place] |= _U(1 << (i % WORD))
    return assembled(languages, words)


def decide(filters: LanguageFilters, prints: np.ndarray, offset: np.ndarray, lettered: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Per row the language with the most n-grams, corrected for false positives, and its share of the n-grams.

    Of n n-grams, h of them found, t true: h = t + (n - t) * f, so t = (h - n f) / (1 - f). Ties: first by name.
    """
    rows, n = offset.size - 1, np.diff(offset)
    if not filters.languages:
        return [UNKNOWN] * rows, np.zeros(rows)
    some = n > 0
    true = np.zeros((len(filters.languages), rows))
    for w, slots in enumerate(filters.words if some.any() else ()):
        places = _places(prints, slots.size)
        masks = slots[places[0]]
        for place in places[1:]:
            masks = masks & slots[place]
        for i in range(w * WORD, min((w + 1) * WORD, len(filters.languages))):
            found = np.add.reduceat((masks >> masks.dtype.type(i % WORD)) & masks.dtype.type(1), offset[:-1][some], dtype=np.int64)
            f = filters.false_rate[i]
            true[i, some] = (found - n[some] * f) / max(1 - f, 1e-9)
    best = true.argmax(axis=0)
    score = np.where(some, np.clip(true.max(axis=0) / np.maximum(n, 1), 0, 1), 0.0)
    return [filters.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)], np.where(lettered, score, 0.0)


def _seen(batches):
    """The distinct n-grams of each language, a slice at a time."""
    for whole in batches:
        for part in sliced(whole, "text"):
            data, at = utf8(part.column(1))
            prints, offset, _ = grams(data, at)
            langs = part.column(0).to_pylist()
            for language in sorted(set(langs)):
                seen = np.unique(np.concatenate([prints[offset[i] : offset[i + 1]] for i, x in enumerate(langs) if x == language]))
                yield pa.RecordBatch.from_arrays([pa.array([language] * seen.size, pa.string()), pa.array(seen.view(np.int64))], ["lang", "gram"])


def fit_filters(spark: SparkSession, labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> LanguageFilters:
    """Fits from (id, lang, text) rows on a hash sample of about `sample_docs` a language, whatever the input's size.

    A language's filter holds every n-gram of its sample, and the filters are sized by them. Slots are set by a grouping
    in Spark; what reaches the driver is the filters' own size: a word a slot for every WORD languages.
    """
    labelled = labelled.where("lang is not null and text is not null")
    share = labelled.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(sample_docs)) / F.count(F.lit(1))).alias("share"))
    drawn = key_hash(F.lit("language"), F.col("id").cast("string")) / F.lit(float(1 << 52))
    sample = labelled.join(F.broadcast(share), "lang").where(drawn < F.col("share"))
    staging = Staging(spark, "language_filters")
    seen = staging.write(sample.select("lang", "text").mapInArrow(_seen, "lang string, gram long").distinct(), "grams")
    sizes = {r["lang"]: r["n"] for r in seen.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    slots = slots_for(max(sizes.values(), default=0))
    words = [np.zeros(slots, np.uint64) for _ in range(-(-len(languages) // WORD))]
    if languages:
        table = spark.createDataFrame([(x, i // WORD, 1 << (i % WORD) if i % WORD < 63 else -(1 << 63)) for i, x in enumerate(languages)], "lang string, word int, bit long")
        place = F.explode(F.array(*(F.shiftrightunsigned("gram", 32 * i).bitwiseAND(F.lit(slots - 1)) for i in range(HASHES)))).alias("slot")
        set_bits = seen.join(F.broadcast(table), "lang").select("word", "bit", place).groupBy("word", "slot").agg(F.bit_or("bit").alias("bits")).toArrow()
        word, slot, bits = (set_bits.column(k).to_numpy() for k in range(3))
        for w in range(len(words)):
            words[w][slot[word == w]] = bits[word == w].view(np.uint64)
    staging.release()
    return assembled(languages, words)


def _predicted(model):
    def run(batches):
        filters = model.value
        for whole in batches:
            for part in sliced(whole, "text"):
                data, at = utf8(part.column(part.schema.get_field_index("text")))
                langs, score = decide(filters, *grams(data, at))
                kept = [c for n, c in zip(part.schema.names, part.columns, strict=True) if n != "text"]
                names = [n for n in part.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    return run


def predict_languages(spark: SparkSession, rows: DataFrame, filters: LanguageFilters) -> DataFrame:
    """Adds lang_pred and score to (doc_id, held_out, text) rows and drops the text: a map without a shuffle.

    The filters are broadcast; their size is that of the bounded sample's n-grams: about 8 to 16 slots for each n-gram
    of the language with the most, of 1 byte (up to 8 languages) to 8 bytes for every 64.
    """
    model = spark.sparkContext.broadcast(filters)
    return rows.select("doc_id", "held_out", "text").mapInArrow(_predicted(model), "doc_id long, held_out boolean, lang_pred string, score double")


def held_out(ident: Column) -> Column:
    """Whether an id's rows take no part in the fit; null for a null id."""
    return F.crc32(ident.cast("string").cast("binary")) % 4 == 2


def labelled_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(id, lang, text) of the rows to learn from: an id that is not held out. A null id is not learnt from."""
    rows = docs.select(named(id_col).cast("long").alias("id"), named(lang_col).alias("lang"), named(text_col).alias("text"))
    return rows.where(~held_out(F.col("id")))


def identify(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; whole texts, upper case or not, by their letters alone.

    Rows whose crc32(id) mod 4 is 2 are held out; the filters are fitted on the others with a label. A null or
    letterless text is `und` with score 0, and so is every row if there is nothing to learn from. A null id is neither
    held out nor learnt from. Repeated rows stay; other columns are not read; an empty table gives an empty result.
    """
    rows = docs.select(
        named(id_col).cast("long").alias("doc_id"),
        F.coalesce(held_out(named(id_col)), F.lit(False)).alias("held_out"),
        named(text_col).alias("text"),
    )
    return predict_languages(spark, rows, fit_filters(spark, labelled_rows(docs, id_col, text_col, lang_col)))


#: The share of a language's n-grams, corrected for false positives, under which a text counts as no language's.
LEAST_SCORE = 0.1


def _kept(model, text_col: str, least: float):
    def run(batches):
        filters = model.value
        for whole in batches:
            for part in sliced(whole, text_col):
                data, at = utf8(part.column(part.schema.get_field_index(text_col)))
                langs, score = decide(filters, *grams(data, at))
                keep = [x != UNKNOWN and s >= least for x, s in zip(langs, score.tolist(), strict=True)]
                yield part.filter(pa.array(keep, pa.bool_()))

    return run


def keep_identified(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_score: float = LEAST_SCORE
) -> DataFrame:
    """The rows of `docs`, all columns as they are, whose text is in a language: not `und`, and of `least_score` at least.

    The filters are fitted as identify() fits them. With no labelled row to learn from, every row with a letter stays,
    since nothing speaks against any. Null, empty and letterless texts go; repeated rows are judged alike; an empty
    table gives an empty result. A map without a shuffle.
    """
    filters = fit_filters(spark, labelled_rows(docs, id_col, text_col, lang_col))
    if not filters.languages:
        return docs.where(F.coalesce(named(text_col).rlike(r"\p{L}"), F.lit(False)))
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # mapInArrow takes no names with dots
    kept = plain.mapInArrow(_kept(spark.sparkContext.broadcast(filters), f"c{docs.columns.index(text_col)}", least_score), plain.schema)
    return kept.toDF(*docs.columns)
