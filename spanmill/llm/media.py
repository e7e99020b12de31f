"""Media columns: texts as PNG pictures in binary columns, read back with checksum tests, and cosine-transform hashes."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanmill.llm.textbytes import sliced, utf8

# Fixed values of the format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
GREY, RGB = 0, 2
NONE, SUB, UP, AVERAGE, PAETH = range(5)

#: Samples of a row of the picture; payloads are padded to a multiple of it.
WIDTH = 576
PAD = 255
LEVEL = 1
SIDE = 32
LOW = 8
_freq, _place = np.arange(SIDE)[:, None], np.arange(SIDE)[None, :]
_COSINE = np.cos(np.pi * (2 * _place + 1) * _freq / (2 * SIDE))[:LOW]


class BadPicture(ValueError):
    """A stored form that fails a test: signature, chunk order, length, checksum, header or filter."""


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def write_png(samples: np.ndarray, level: int = LEVEL) -> bytes:
    """An 8-bit greyscale picture (height x width, uint8). Each row is filtered by none, sub or up: the one whose
    signed residues have the least sum of magnitudes."""
    height, width = samples.shape
    above = np.vstack([np.zeros((1, width), np.uint8), samples[:-1]])
    left = np.hstack([np.zeros((height, 1), np.uint8), samples[:, :-1]])
    options = np.stack([samples, samples - left, samples - above])
    cost = np.abs(options.view(np.int8).astype(np.int16)).sum(axis=2)
    best = cost.argmin(axis=0).astype(np.uint8)
    rows = np.empty((height, width + 1), np.uint8)
    rows[:, 0] = best
    rows[:, 1:] = options[best, np.arange(height)]
    header = struct.pack(">IIBBBBB", width, height, 8, GREY, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def _chunks(png: bytes):
    if png[:8] != SIGNATURE:
        raise BadPicture("signature")
    at = 8
    while at < len(png):
        if at + 12 > len(png):
            raise BadPicture("cut off")
        (size,) = struct.unpack(">I", png[at : at + 4])
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + size]
        if len(body) != size or struct.pack(">I", zlib.crc32(body, zlib.crc32(kind))) != png[at + 8 + size : at + 12 + size]:
            raise BadPicture(f"checksum of {kind!r}")
        yield kind, body
        at += 12 + size
        if kind == b"IEND":
            if at != len(png):
                raise BadPicture("bytes after the end")
            return
    raise BadPicture("no end")


def _unfilter(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    """Undoes the filters; runs of rows of one vertical or horizontal filter are undone together."""
    height, width = rows.shape
    out = np.empty_like(rows)
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for first, last in zip([0, *edges.tolist()], [*edges.tolist(), height], strict=True):
        kind, part = int(kinds[first]), rows[first:last]
        above = out[first - 1] if first else np.zeros(width, np.uint8)
        if kind == NONE:
            out[first:last] = part
        elif kind == SUB:
            out[first:last] = np.cumsum(part.reshape(len(part), -1, step), axis=1, dtype=np.uint8).reshape(part.shape)
        elif kind == UP:
            out[first:last] = np.cumsum(np.vstack([above[None], part]), axis=0, dtype=np.uint8)[1:]
        elif kind in (AVERAGE, PAETH):
            for y in range(first, last):
                up = (out[y - 1] if y else np.zeros(width, np.uint8)).tolist()
                raw, now = rows[y].tolist(), [0] * width
                for x in range(width):
                    a, b = (now[x - step] if x >= step else 0), up[x]
                    if kind == AVERAGE:
                        guess = (a + b) // 2
                    else:
                        c = up[x - step] if x >= step else 0
                        near = a + b - c
                        guess = min((abs(near - v), i, v) for i, v in enumerate((a, b, c)))[2]
                    now[x] = (raw[x] + guess) & 255
                out[y] = now
        else:
            raise BadPicture(f"filter {kind}")
    return out


def read_png(png: bytes) -> np.ndarray:
    """The samples of an 8-bit greyscale or RGB picture, not interlaced: height x (width * samples a pixel)."""
    header, packed = None, []
    for i, (kind, body) in enumerate(_chunks(png)):
        if (i == 0) != (kind == b"IHDR"):
            raise BadPicture("header")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body) if len(body) == 13 else ()
        elif kind == b"IDAT":
            packed.append(body)
    if not header or header[2] != 8 or header[3] not in (GREY, RGB) or header[4:] != (0, 0, 0) or 0 in header[:2]:
        raise BadPicture(f"header {header}")
    step = 3 if header[3] == RGB else 1
    width, height = header[0] * step, header[1]
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise BadPicture(str(e)) from e
    if len(raw) != height * (width + 1):
        raise BadPicture("data length")
    rows = np.frombuffer(raw, np.uint8).reshape(height, width + 1)
    return _unfilter(rows[:, 0], rows[:, 1:], step)


def _shrunk(samples: np.ndarray) -> np.ndarray:
    """Box means on a SIDE x SIDE grid; a picture with fewer rows or columns repeats them."""
    out = samples.astype(np.float64)
    for axis in (0, 1):
        n = out.shape[axis]
        edge = np.arange(SIDE) * n // SIDE
        size = np.diff(np.append(edge, n)) if n >= SIDE else np.ones(SIDE)
        out = np.add.reduceat(out, edge, axis=axis) if n >= SIDE else np.take(out, edge, axis=axis)
        out /= size[:, None] if axis == 0 else size[None, :]
    return out


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: whether each of the lowest LOW x LOW cosine coefficients is over the median of all but the constant one."""
    low = np.round(_COSINE @ _shrunk(samples) @ _COSINE.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def payload(text: bytes) -> bytes:
    return text + bytes([PAD]) * (-len(text) % WIDTH if text else WIDTH)


def _encode(batches):
    for whole in batches:
        for part in sliced(whole, "text"):
            data, at = utf8(part.column(1))
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            pictures = [write_png(np.frombuffer(payload(t), np.uint8).reshape(-1, WIDTH)) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), pa.array(pictures, pa.binary())], ["doc_id", "n_bytes", "media"])


def _decode(batches):
    for whole in batches:
        for start in range(0, whole.num_rows, 256):
            part = whole.slice(start, 256)
            got = [read_png(m) for m in part.column(2).to_pylist()]
            cols = [*part.columns, pa.array([g.tobytes() for g in got], pa.binary()), pa.array([cosine_hash(g) for g in got], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "media", "payload", "hash"])


def _digest(batches):
    for whole in batches:
        for start in range(0, whole.num_rows, 256):
            part = whole.slice(start, 256)
            media = part.column(2).to_pylist()
            back = [read_png(m) for m in media]
            load = [b.tobytes() for b in back]
            cols = {
                "doc_id": part.column(0),
                "n_bytes": part.column(1),
                "payload_bytes": pa.array([len(x) for x in load], pa.int64()),
                "payload_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in load]),
                "tail_crc32": pa.array([zlib.crc32(x[-32:]) for x in load], pa.int64()),
                "media_bytes": pa.array([len(x) for x in media], pa.int64()),
                "media_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in media]),
                "feature": pa.array([cosine_hash(x).hex() for x in back]),
            }
            yield pa.RecordBatch.from_pydict(cols)


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text (null: empty) as a PNG of 576 grey samples a row, padded by bytes 255.

    A row-wise map with no shuffle; a picture is as long as its text, whole. Equal texts give equal bytes. Repeated
    rows and null ids stay; other columns are not read; an empty table gives an empty result.
    """
    return docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text").mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


def decode_media(media: DataFrame) -> DataFrame:
    """Adds payload (the samples read back) and hash (8 bytes, low-frequency cosine signs) to doc_id, n_bytes, media.

    A picture that fails a checksum, header or filter test raises BadPicture; nothing is repaired or skipped.
    """
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_decode, "doc_id long, n_bytes long, media binary, payload binary, hash binary")


def media_digests(media: DataFrame) -> DataFrame:
    """What decode_media() reads back, as digests: the bytes themselves do not leave the worker."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_digest, schema)
