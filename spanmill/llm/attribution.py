"""Token counts of sections: documents are encoded once, whole, and token spans are joined to section spans."""

from __future__ import annotations

import base64
import functools
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from spanmill.llm.shared import named
from spanmill.llm.textbytes import sliced, utf8

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that splits text before the merges; it belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as that pattern sees it, in runs so long that its look-ahead is taken out of the matcher's hands.
_LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")
RULES = ("first", "most", "share")
SCHEMA = "doc_id long, section int, start long, end long, tokens double, crossing int, doc_tokens long"


def shipped(docs: DataFrame, path: str) -> str:
    """Sends the vocabulary to all executors and returns the name under which they find it."""
    docs.sparkSession.sparkContext.addFile(path)
    return os.path.basename(path)


@functools.lru_cache(maxsize=2)
def _encoder(name: str, pattern: str):
    import tiktoken

    with open(name if os.path.isabs(name) else SparkFiles.get(name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def token_ids(encoder, text: str, pattern: str) -> list[int]:
    """The tokens of a text. PATTERN's `\\s+(?!\\S)` leaves the last character of a run of white space to what follows;
    the matcher backtracks for it once a character, so long runs are cut at that place here."""
    ids, at = [], 0
    for run in _LONG_RUN.finditer(text) if pattern == PATTERN else ():
        last = run.end() - (run.end() < len(text))
        ids += encoder.encode_ordinary(text[at : run.start()])
        ids += encoder._encode_single_piece(text[run.start() : last].encode())
        at = last
    return ids + encoder.encode_ordinary(text[at:])


def token_edges(texts: list[str], at: np.ndarray, name: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of all tokens in the joined texts, and each text's offset in them. Tokens tile their text."""
    encoder, sizes = _encoder(name, pattern)
    ids = [np.array(token_ids(encoder, t, pattern), np.int64) for t in texts]
    counts = np.array([x.size for x in ids], np.int64)
    length = sizes[np.concatenate(ids)] if ids else np.empty(0, np.int64)
    offset = np.concatenate(([0], np.cumsum(counts)))
    starts = np.cumsum(length) - length  # token lengths of a text sum to its bytes
    if int(length.sum()) != int(at[-1]):
        raise ValueError("tokens do not tile the text")
    return starts, offset


def line_starts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sections that tile each text: its lines, each with the newline that ends it. An empty text has one, empty."""
    begins = np.zeros(data.size + 1, bool)
    begins[1:][data == 0x0A] = True
    begins[at[1:]] = False  # no line begins at a text's end
    empty = at[:-1] == at[1:]
    begins[at[:-1][~empty]] = True
    starts, doc = np.flatnonzero(begins), None
    doc = np.searchsorted(at, starts, side="right") - 1
    starts = np.concatenate((starts, at[:-1][empty]))
    doc = np.concatenate((doc, np.flatnonzero(empty)))
    order = np.lexsort((starts, doc))
    return starts[order], np.searchsorted(doc[order], np.arange(at.size))


def allocate(token: np.ndarray, total: int, section: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Interval join of sorted token starts with sorted section starts over [0, total), both tiling it.

    Returns each section's tokens and how many tokens begin in it and end in a later one. `first`: a token belongs
    to the section of its first byte. `most`: to that of most of its bytes, the earlier on a tie. `share`: to each by
    its part of the bytes.
    """
    end = np.append(token[1:], total)
    first = np.searchsorted(section, token, side="right") - 1
    last = np.searchsorted(section, end - 1, side="right") - 1
    crossing = np.bincount(first[last > first], minlength=section.size)
    counts = np.bincount(first[(last == first) | (rule == "first")], minlength=section.size).astype(np.float64)
    edge = np.append(section[1:], total)
    for t in np.flatnonzero(last > first) if rule != "first" else ():
        own = np.arange(first[t], last[t] + 1)
        part = np.minimum(edge[own], end[t]) - np.maximum(section[own], token[t])
        if rule == "share":
            counts[own] += part / part.sum()
        else:
            counts[own[int(np.argmax(part))]] += 1
    return counts, crossing


def _attribute(name: str, pattern: str, rule: str):
    def run(batches):
        for whole in batches:
            for part in sliced(whole, "text"):
                data, at = utf8(part.column(1))
                raw = data.tobytes()
                texts = [raw[a:b].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                tokens, token_at = token_edges(texts, at, name, pattern)
                section, section_at = line_starts(data, at)
                per = np.diff(section_at)
                # Empty sections hold no byte: they take no part in the join.
                end = np.append(section[1:], at[-1])
                solid = end > section
                counts, crossing = np.zeros(section.size), np.zeros(section.size, np.int64)
                counts[solid], crossing[solid] = allocate(tokens, int(at[-1]), section[solid], rule)
                doc = np.repeat(np.arange(part.num_rows), per)
                chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                base = chars[at[:-1]][doc]
                ids = part.column(0)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(doc)),
                        pa.array((np.arange(section.size) - section_at[:-1][doc]).astype(np.int32)),
                        pa.array(chars[section] - base),
                        pa.array(chars[end] - base),
                        pa.array(counts),
                        pa.array(crossing.astype(np.int32)),
                        pa.array(np.diff(token_at)[doc]),
                    ],
                    ["doc_id", "section", "start", "end", "tokens", "crossing", "doc_tokens"],
                )

    return run


def section_tokens(docs: DataFrame, rule: str = "first", path: str = VOCABULARY, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line of every document: its character span [start, end), its tokens under `rule`, the tokens that
    begin in it and end in a later one, and the tokens of the whole document.

    A document is encoded once, whole, never by section, so merges across section ends are kept; a document's section
    counts sum to its tokens under each rule. Lines keep their newline, so sections tile the text; a null or empty
    text has one empty section and no tokens. A token that splits a character begins where that character's byte lies.
    Repeated rows and null ids stay; other columns are not read; an empty table gives an empty result. Row-wise with no
    shuffle: a task holds one slice of about 1 MB, or one text. `path` is read on the driver and sent to the executors.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    return rows.mapInArrow(_attribute(shipped(docs, path), pattern, rule), SCHEMA)
