"""Substring dedup: windows of words counted exactly, sent to buckets as super-k-mers by their minimiser."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.llm.shared import MOST_PARTS, Staging, input_bytes, named, numbered, parts_for
from spanmill.llm.textbytes import mixed, run_prints, sliced, starts_of_runs, utf8, word_prints, words

WINDOW = 35
#: Words of the grams whose least fingerprint is a window's minimiser.
GRAM = 5
#: Text whose super-k-mers a mapper gathers before it packs them, and raw bytes of super-k-mers in a bucket.
FLUSH_BYTES = 8 << 20
BUCKET_BYTES = 24 << 20
#: Raw bytes of super-k-mers for a byte of (compressed) input, for sizing only.
SWELL = 6
#: Raw bytes of a bucket that are counted in one go; the windows of a larger one are counted by a grouping of their own.
HEAVY_BYTES = 4 * BUCKET_BYTES
#: Buckets of a partition are counted one after the other, so that there may be more buckets than partitions.
MOST_BUCKETS = 1 << 22
_U = np.uint64
_RUN = np.random.default_rng(3535).integers(1 << 62, 1 << 63, 2, dtype=np.uint64) | _U(1)


def window_prints(prints: np.ndarray, which: int) -> np.ndarray:
    """Fingerprints of all WINDOW consecutive words."""
    return run_prints(prints, WINDOW, which)


def sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each `size` consecutive values, by doubling."""
    out, span = values, 1
    while span * 2 <= size:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = size - span
    return np.minimum(out[: out.size - rest], out[rest:]) if rest else out


def super_kmers(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Maximal runs of consecutive windows of one row that share a minimiser.

    row, pos (the first window's word in its row), first and last byte, minimiser, and two fingerprints of the run.
    """
    starts, ends, word_at = words(data, at)
    begin = starts_of_runs(word_at, WINDOW)
    if begin.size == 0:
        return {}
    prints = [word_prints(data, starts, ends, k) for k in (0, 1)]
    least = sliding_least(run_prints(prints[0], GRAM), WINDOW - GRAM + 1)[begin]
    new = np.ones(begin.size, bool)
    new[1:] = (least[1:] != least[:-1]) | (np.diff(begin) != 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], begin.size) - 1
    row = np.searchsorted(word_at, begin[first], side="right") - 1
    size = (last - first + 1).astype(np.uint64)
    both = [mixed(np.add.reduceat(mixed(window_prints(prints[k], k)[begin] * _RUN[k]), first) + size) for k in (0, 1)]
    return {
        "row": row,
        "pos": begin[first] - word_at[row],
        "from": starts[begin[first]],
        "to": ends[begin[last] + WINDOW - 1],
        "least": least[first],
        "r0": both[0],
        "r1": both[1],
    }


def _packed(buckets: int):
    """Packs super-k-mers by bucket; equal ones of one flush are packed once, with all their places."""

    def flush(held):
        squeeze = zstandard.ZstdCompressor(level=3)
        raw = b"".join(h["raw"] for h in held)
        col = {k: np.concatenate([h[k] for h in held]) for k in ("from", "to", "least", "r0", "r1", "no", "pos")}
        order = np.lexsort((col["r1"], col["r0"]))
        new = np.ones(order.size, bool)
        new[1:] = (np.diff(col["r0"][order]) != 0) | (np.diff(col["r1"][order]) != 0)
        group = np.empty(order.size, np.int64)
        group[order] = np.cumsum(new) - 1
        lead = order[new]
        where = (mixed(col["least"][lead]) % _U(buckets)).astype(np.int64)
        ref_where = where[group]
        by_group, by_ref = np.argsort(where, kind="stable"), np.argsort(ref_where, kind="stable")
        local = np.empty(lead.size, np.int64)
        group_edge = np.searchsorted(where[by_group], np.arange(buckets + 1))
        ref_edge = np.searchsorted(ref_where[by_ref], np.arange(buckets + 1))
        local[by_group] = np.arange(lead.size) - group_edge[where[by_group]]
        names, blobs = [], []
        for b in np.flatnonzero(np.diff(group_edge)).tolist():
            own, refs = lead[by_group[group_edge[b] : group_edge[b + 1]]], by_ref[ref_edge[b] : ref_edge[b + 1]]
            # By their order of coming, numbers ascend in small steps, which pack well.
            numbers = col["no"][refs]
            parts = [
                np.array([own.size, refs.size], np.int64),
                (col["to"][own] - col["from"][own]).astype(np.int64),
                local[group[refs]],
                col["pos"][refs],
                np.diff(numbers, prepend=0),
            ]
            text = b"".join(raw[x:y] for x, y in zip(col["from"][own].tolist(), col["to"][own].tolist(), strict=True))
            names.append(b)
            blobs.append(squeeze.compress(b"".join(p.tobytes() for p in parts) + text))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def run(batches):
        held, size = [], 0
        for whole in batches:
            no = whole.column(0).to_numpy()
            done = 0
            for part in sliced(whole, "text"):
                data, at = utf8(part.column(1))
                found = super_kmers(data, at)
                if found:
                    found |= {"no": no[found.pop("row") + done], "raw": data.tobytes()}
                    found["from"], found["to"] = found["from"] + size, found["to"] + size
                    held.append(found)
                    size += data.size
                done += part.num_rows
                if size >= FLUSH_BYTES:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


#: What counting gives: a covered word range of a row; or, of a bucket too large to count in one go, a super-k-mer: its
#: number, its windows' fingerprints and its places.
_FOUND = "no long, start long, end long, kmer long, prints array<struct<f0:long,f1:long>>, places array<struct<no:long,pos:long>>"


def _unpacked(blob: bytes):
    """Of the super-k-mers of one blob: their windows' two fingerprints, windows of each, and the places' super-k-mer,
    first word and row number."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, m = np.frombuffer(raw, np.int64, 2).tolist()
    ints = np.frombuffer(raw, np.int64, n + 3 * m, 16)
    data = np.frombuffer(raw, np.uint8, offset=16 + 8 * (n + 3 * m))
    starts, ends, word_at = words(data, np.concatenate(([0], np.cumsum(ints[:n]))))
    begin = starts_of_runs(word_at, WINDOW)
    prints = [window_prints(word_prints(data, starts, ends, k), k)[begin] for k in (0, 1)]
    group, pos, steps = ints[n:].reshape(3, m)
    return prints, np.diff(word_at) - WINDOW + 1, group, pos, np.cumsum(steps)


def _as_found(rows: int, **given) -> pa.RecordBatch:
    kinds = {"no": pa.int64(), "start": pa.int64(), "end": pa.int64(), "kmer": pa.int64()}
    pair = lambda a, b: pa.list_(pa.struct([(a, pa.int64()), (b, pa.int64())]))
    kinds |= {"prints": pair("f0", "f1"), "places": pair("no", "pos")}
    return pa.RecordBatch.from_arrays([given.get(k, pa.nulls(rows, kind)) for k, kind in kinds.items()], list(kinds))


def _ranges(parts):
    """The ranges of all windows of a bucket's blobs that begin at two places or more. The windows are sorted by their
    fingerprints (128 bits)."""
    f0, f1 = (np.concatenate([p[0][k] for p in parts]) for k in (0, 1))
    per = np.concatenate([p[1] for p in parts])
    shift = np.cumsum([0, *(p[1].size for p in parts)])
    group = np.concatenate([p[2] + shift[j] for j, p in enumerate(parts)])
    pos, no = (np.concatenate([p[i] for p in parts]) for i in (3, 4))
    order = np.lexsort((f1, f0))
    same = (np.diff(f0[order]) == 0) & (np.diff(f1[order]) == 0)
    repeated = np.zeros(f0.size, bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    owner = np.repeat(np.arange(per.size), per)
    repeated |= (np.bincount(group, minlength=per.size) > 1)[owner]
    place = np.arange(owner.size) - np.repeat(np.cumsum(per) - per, per)
    # Ranges of consecutive repeated windows of one super-k-mer.
    opens = repeated & ((place == 0) | ~np.concatenate(([False], repeated[:-1])))
    closes = repeated & (np.concatenate((place[1:] == 0, [True])) | ~np.concatenate((repeated[1:], [False])))
    first, last, whose = place[opens], place[closes], owner[opens]
    count = np.bincount(whose, minlength=per.size)
    edge = np.cumsum(count) - count
    times = count[group]
    ref = np.repeat(np.arange(group.size), times)
    which = np.arange(ref.size) - np.repeat(np.cumsum(times) - times, times) + edge[group[ref]]
    for at in range(0, ref.size, 100_000):
        r, w = ref[at : at + 100_000], which[at : at + 100_000]
        yield _as_found(r.size, no=pa.array(no[r]), start=pa.array(pos[r] + first[w]), end=pa.array(pos[r] + last[w] + WINDOW))


def _super_kmer_rows(part, number: int) -> pa.RecordBatch:
    """The super-k-mers of one blob as rows, numbered from `number` on."""
    prints, per, group, pos, no = part
    order = np.argsort(group, kind="stable")
    lists = lambda counts: pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
    windows = pa.StructArray.from_arrays([pa.array(p.view(np.int64)) for p in prints], ["f0", "f1"])
    places = pa.StructArray.from_arrays([pa.array(no[order]), pa.array(pos[order])], ["no", "pos"])
    return _as_found(
        per.size,
        kmer=pa.array(number + np.arange(per.size)),
        prints=pa.ListArray.from_arrays(lists(per), windows),
        places=pa.ListArray.from_arrays(lists(np.bincount(group, minlength=per.size)), places),
    )


def _counted(heavy: int):
    """Rows (bucket, blob) in order of bucket to _FOUND. A bucket is held until it is whole or `heavy` bytes are reached;
    a heavier one is passed on blob by blob, as super-k-mers."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        bucket, held, size, passed = None, [], 0, False
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if name != bucket:
                    if held:
                        yield from _ranges(held)
                    bucket, held, size, passed = name, [], 0, False
                part = _unpacked(blob.as_py())
                held.append(part)
                size += 16 * part[0][0].size + 24 * part[2].size
                passed |= size > heavy
                for one in held if passed else ():
                    yield _super_kmer_rows(one, number)
                    number += one[1].size
                held = [] if passed else held
        if held:
            yield from _ranges(held)

    return run


def _heavy_ranges(staging: Staging, found: DataFrame) -> DataFrame:
    """(no, start, end) of the repeated windows among the super-k-mers that counting passed on.

    Windows are grouped by fingerprint, with partial sums, and the repeated ones joined back, so that a window that very
    many super-k-mers have costs no task their number; places are only looked at once per super-k-mer.
    """
    kmers = found.where("kmer is not null")
    windows = kmers.select("kmer", (F.size("places") > 1).alias("many"), F.posexplode("prints").alias("at", "f")).select("kmer", "many", "at", "f.f0", "f.f1")
    counts = windows.groupBy("f0", "f1").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = staging.write(counts, "repeated")
    again = windows.where("not many").join(counts, ["f0", "f1"]).select("kmer", "at").unionByName(windows.where("many").select("kmer", "at"))
    runs = again.groupBy("kmer").agg(F.array_sort(F.collect_list("at")).alias("ats"))
    first = F.array_except("ats", F.transform("ats", lambda x: x + 1))
    last = F.array_except("ats", F.transform("ats", lambda x: x - 1))
    runs = runs.select("kmer", F.arrays_zip(first.alias("first"), last.alias("last")).alias("runs"))
    spans = kmers.select("kmer", "places").join(runs, "kmer").select(F.explode("places").alias("p"), "runs")
    spans = spans.select("p.*", F.explode("runs").alias("r"))
    return spans.select("no", (F.col("pos") + F.col("r.first")).alias("start"), (F.col("pos") + F.col("r.last") + WINDOW).alias("end"))


def cut_words(data: np.ndarray, at: np.ndarray, ranges: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Removes the words in each row's ranges: words, removed words, and the kept words joined by one space (bytes and
    each row's offset in them)."""
    starts, ends, word_at = words(data, at)
    rows = at.size - 1
    ranges = ranges.fill_null([]) if ranges.null_count == 0 else pa.ListArray.from_arrays(
        np.concatenate(([0], np.cumsum(ranges.value_lengths().fill_null(0).to_numpy()))).astype(np.int32), ranges.flatten()
    )
    per = ranges.value_lengths().to_numpy()
    flat = ranges.flatten()
    base = np.repeat(word_at[:-1], per)
    cover = np.zeros(starts.size + 1, np.int64)
    if base.size:
        np.add.at(cover, flat.field(0).to_numpy() + base, 1)
        np.add.at(cover, flat.field(1).to_numpy() + base, -1)
    gone = np.cumsum(cover[:-1]) > 0
    kept = np.flatnonzero(~gone)
    row = np.searchsorted(word_at, kept, side="right") - 1
    final = np.ones(kept.size, bool)
    final[:-1] = row[1:] != row[:-1]
    out = np.append(data, np.uint8(0x20))
    out[ends[kept[~final]]] = 0x20
    edge = np.zeros(out.size + 1, np.int64)
    np.add.at(edge, starts[kept], 1)
    np.add.at(edge, ends[kept] + ~final, -1)
    mask = np.cumsum(edge[:-1]) > 0
    return np.diff(word_at), np.bincount(row, minlength=rows), out[mask], np.concatenate(([0], np.cumsum(mask)))[at]


def _cut(with_text: bool):
    def run(batches):
        for whole in batches:
            for part in sliced(whole, "text"):
                data, at = utf8(part.column(1))
                n, kept, out, offset = cut_words(data, at, part.column(2))
                raw = out.tobytes()
                texts = [raw[a:b] for a, b in zip(offset[:-1].tolist(), offset[1:].tolist(), strict=True)]
                last = pa.array(texts, pa.binary()).cast(pa.string()) if with_text else pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(n - kept), last], ["doc_id", "n_words", "n_removed", "kept_text" if with_text else "kept_sha256"])

    return run


def remove_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (or kept_sha256) of every row: each word is removed that lies in a window of 35
    words whose sequence begins anywhere else too, in the same document or another.

    Windows are judged on the input, and every copy goes, the first too. Words are maximal runs other than ASCII white
    space, unchanged; kept words are joined by one space. Null, empty and short texts have no window and lose nothing.
    Repeated rows are documents like others, so rows alike lose every window. Null ids stay; other columns are not
    read; an empty table gives an empty result.

    Consecutive windows with one minimiser (the least fingerprint of 5-word grams) travel once, as one packed string,
    to the bucket of that minimiser; equal windows have equal minimisers, so a bucket sees all of a window's places.
    Equal super-k-mers of a mapper's flush travel once, so that a hot passage costs a bucket its places, not its texts.
    A bucket of more than HEAVY_BYTES streams through its task, and its windows are counted by a grouping of fingerprints.
    """
    staging = Staging(spark, "remove_repeats")
    buckets = parts_for(spark, input_bytes(docs), BUCKET_BYTES, factor=SWELL, most=MOST_BUCKETS)
    parts = min(buckets, MOST_PARTS)
    rows, _ = numbered(staging, docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text")))
    rows = rows.select(F.col("__no").alias("no"), "doc_id", "text")
    packed = rows.select("no", "text").mapInArrow(_packed(buckets), "bucket int, blob binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    found = staging.write(packed.mapInArrow(_counted(HEAVY_BYTES), _FOUND), "found")
    ranges = found.where("kmer is null").select("no", "start", "end").unionByName(_heavy_ranges(staging, found))
    ranges = ranges.groupBy("no").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    joined = rows.join(ranges, "no", "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(_cut(not digest), f"doc_id long, n_words long, n_removed long, {'kept_sha256' if digest else 'kept_text'} string")
