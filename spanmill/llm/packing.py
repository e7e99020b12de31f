"""Length buckets with the least padding, and token-budget batches inside each."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.llm.attribution import PATTERN, VOCABULARY, shipped, token_edges
from spanmill.llm.prefix import ROW, with_prefix
from spanmill.llm.shared import Staging, input_bytes, key_hash, named, parts_for
from spanmill.llm.textbytes import sliced, utf8

ROWS_PER_PART = 1_000_000


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` buckets that minimise sum(bound - length); exact dynamic programming.

    `lengths` are distinct and ascending. cost(i, j), the padding of lengths i..j-1 under bound lengths[j-1], comes
    from prefix sums; every layer is one vectorised minimum per j.
    """
    n = len(lengths)
    if n == 0:
        return []
    number = np.concatenate(([0.0], np.cumsum(counts, dtype=np.float64)))
    total = np.concatenate(([0.0], np.cumsum(counts * lengths.astype(np.float64))))
    least = np.full(n + 1, np.inf)
    least[0] = 0
    came: list[np.ndarray] = []
    for _ in range(min(buckets, n)):
        now, back = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        now[0] = 0
        for j in range(1, n + 1):
            options = least[:j] + lengths[j - 1] * (number[j] - number[:j]) - (total[j] - total[:j])
            back[j] = int(np.argmin(options))
            now[j] = options[back[j]]
        came.append(back)
        least = now
    bounds, j = [], n
    for back in reversed(came):
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = int(back[j])
    return bounds[::-1]


_PIECE = "doc_id long, piece int, start long, length int, first_byte long, last_byte long, deal long"


def _pieces(name: str, pattern: str, window: int, seed: int):
    """Cuts the tokens of each text and its end mark into pieces: place among the tokens, tokens, bytes of the text, and
    a hash of the piece's bytes."""

    def run(batches):
        for whole in batches:
            for part in sliced(whole, "text"):
                data, at = utf8(part.column(1))
                raw = data.tobytes()
                texts = [raw[a:b].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                tokens, token_at = token_edges(texts, at, name, pattern)
                n = np.diff(token_at) + 1
                count = -(-n // window)
                row = np.repeat(np.arange(n.size), count)
                piece = np.arange(row.size) - np.repeat(np.cumsum(count) - count, count)
                start = piece * window
                length = np.minimum(window, n[row] - start)
                # Byte edges: where a token begins, or the text's end for the end mark and what follows it.
                edges = np.append(tokens, at[-1])
                edge = lambda k: np.where(k < n[row] - 1, edges[np.minimum(token_at[row] + k, edges.size - 1)], at[row + 1])  # noqa: B023, E731
                first, last = edge(start), edge(start + length)
                deal = [int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=8, key=str(seed).encode()).digest(), "big", signed=True) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                cols = [piece.astype(np.int32), start, length.astype(np.int32), first - at[row], last - at[row]]
                names = ["doc_id", "piece", "start", "length", "first_byte", "last_byte", "deal"]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), *map(pa.array, cols), pa.array(deal, pa.int64())], names)

    return run


def length_buckets(
    spark: SparkSession,
    docs: DataFrame,
    buckets: int = 16,
    window: int = 4096,
    budget: int = 65536,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str = VOCABULARY,
    pattern: str = PATTERN,
) -> DataFrame:
    """Cuts documents into pieces of at most `window` tokens and packs the pieces into padded batches.

    Returns doc_id, piece, start (among the document's tokens), length (in tokens), first_byte and last_byte (the piece's
    bytes of the text, [first, last)), bucket (its bound, the padded length), batch (gapless over the whole result,
    ascending by bucket) and place (in the batch). Tokens are those of the vocabulary at `path`; a document is encoded
    once, whole, and has one token more, its end mark, without bytes, so a null or empty text is one piece of length 1.

    The histogram of lengths has at most `window` rows, whatever the input, and is the only thing gathered to the driver:
    the bounds are exact. A batch holds budget // bound pieces (at least one), the last of a bucket maybe fewer; nothing
    is dropped. Pieces are dealt to a bucket's batches in a seeded hash order of id, piece and bytes; null and repeated
    ids follow their texts, and wholly equal pieces are interchangeable. Other columns are not read. An empty table gives
    an empty result. A bucket with most of the rows spans many partitions: order numbers come from per-partition totals,
    not from one task per bucket.
    """
    staging = Staging(spark, "length_buckets")
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    cut = rows.mapInArrow(_pieces(shipped(docs, path), pattern, window, seed), _PIECE)
    pieces = staging.write(cut.withColumn("no", F.monotonically_increasing_id()), "pieces")
    seen = sorted((r["length"], r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect())
    bounds = best_bounds(np.array([x for x, _ in seen], np.int64), np.array([n for _, n in seen], np.int64), buckets)
    bound = F.lit(bounds[-1] if bounds else window)
    for b in reversed(bounds[:-1]):
        bound = F.when(F.col("length") <= b, F.lit(b)).otherwise(bound)
    deal = key_hash(F.lit(f"pack{seed}"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("piece").cast("string"), F.col("deal").cast("string"))
    dealt = pieces.withColumn("bucket", bound.cast("int")).withColumn("deal", deal)
    # The number only parts what is alike in all else, so that no range is hot.
    order = ["bucket", "deal", "doc_id", "piece", "start", "length", "first_byte", "last_byte", "no"]
    parts = parts_for(spark, input_bytes(pieces), 32 * ROWS_PER_PART)
    numbered = staging.write(with_prefix(staging, dealt.select(*order), order, None, parts, "ranged"), "numbered")
    staging.drop("pieces", "ranged")
    # At most `buckets` rows.
    per = numbered.groupBy("bucket").agg(F.min(ROW).alias("__first"), F.count(F.lit(1)).alias("__n"))
    room = F.greatest(F.floor(F.lit(budget) / F.col("bucket")), F.lit(1)).cast("long")
    rows = per.withColumn("__room", room).withColumn("__batches", F.ceil(F.col("__n") / F.col("__room"))).collect()
    at, offsets = 0, []
    for r in sorted(rows, key=lambda r: r["bucket"]):
        offsets.append((r["bucket"], r["__first"], r["__room"], at))
        at += int(r["__batches"])
    table = F.broadcast(spark.createDataFrame(offsets, "bucket int, __first long, __room long, __batch0 long"))
    rank = F.col(ROW) - F.col("__first")
    return numbered.join(table, "bucket").select(
        "doc_id",
        "piece",
        "start",
        "length",
        "first_byte",
        "last_byte",
        "bucket",
        (F.col("__batch0") + F.floor(rank / F.col("__room"))).cast("long").alias("batch"),
        (rank % F.col("__room")).cast("int").alias("place"),
    )
