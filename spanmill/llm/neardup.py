"""Near-duplicate groups by min-max hashing, with every link confirmed on full shingle sets."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.llm.components import connected
from spanmill.llm.shared import Staging, input_bytes, named, numbered, only, parts_for
from spanmill.llm.textbytes import _PLACES, lower_ascii, mixed, run_prints, sliced, starts_of_runs, utf8, word_prints, words

SHINGLE = 5
#: Links: PERCENT * union <= 100 * intersection.
PERCENT = 75
#: One permutation gives two values, the minimum and the maximum; a band is two permutations' four values.
PERMUTATIONS = 64
BANDS = 32
#: Sets up to this size are found by their least shingles, exactly; the minimum and the maximum of larger sets agree
#: nearly as independent values would: a band of a pair at similarity 0.75 with a chance of 0.305 or more, so that all
#: bands differ with a chance below 9e-6.
SMALL = 16
#: The largest set that a small one can be linked with.
SMALL_PARTNER = SMALL * 100 // PERCENT
#: Candidates agree in at least this many of the 128 values' low two bits. At similarity 0.75 the mean is 104 and the
#: deviation 4.4, so a link fails this with a chance below 1e-8. Small sets, whose values are few, need not pass.
LEAST_AGREEMENT = 78
#: Members of a block of a bucket; blocks are compared in pairs. They grow with the root of the bucket's size.
LEAST_BLOCK, MOST_BLOCK = 128, 8192
PART_BYTES = 32 << 20
#: Members that share one copy of a hot centre.
SALT_ROWS = 64
_U = np.uint64
_rng = np.random.default_rng(424242)
_MUL = _rng.integers(1 << 62, 1 << 63, PERMUTATIONS, dtype=np.uint64) | _U(1)
_ADD = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_BAND = _rng.integers(1 << 62, 1 << 63, (BANDS, 4), dtype=np.uint64) | _U(1)


def shingle_sets(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle fingerprints of each row, joined, and each row's offset in them."""
    data, at = utf8(col)
    data = lower_ascii(data)
    starts, ends, word_at = words(data, at)
    prints = word_prints(data, starts, ends)
    begin = starts_of_runs(word_at, SHINGLE)
    shingles = run_prints(prints, SHINGLE)[begin] if begin.size else np.empty(0, np.uint64)
    cut = np.searchsorted(begin, word_at)
    count = np.diff(word_at)
    sets = []
    for i in range(at.size - 1):
        if count[i] >= SHINGLE:
            sets.append(np.unique(shingles[cut[i] : cut[i + 1]]))
        elif count[i]:
            own = prints[word_at[i] : word_at[i + 1]]
            sets.append(mixed(np.array([(own * _PLACES[0, : own.size]).sum(dtype=np.uint64) + _U(count[i])])))
        else:
            sets.append(np.empty(0, np.uint64))
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), np.concatenate(([0], np.cumsum([s.size for s in sets]))).astype(np.int64)


def min_max(shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
    """rows x (2 * PERMUTATIONS) 32-bit values: the minimum and the maximum of each permutation; no set is empty."""
    out = np.empty((at.size - 1, 2 * PERMUTATIONS), np.uint32)
    for p in range(PERMUTATIONS):
        values = ((shingles * _MUL[p] + _ADD[p]) >> _U(32)).astype(np.uint32)
        out[:, 2 * p] = np.minimum.reduceat(values, at[:-1])
        out[:, 2 * p + 1] = np.maximum.reduceat(values, at[:-1])
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    four = values.reshape(len(values), BANDS, 4).astype(np.uint64)
    return mixed((mixed(four + _U(1)) * _BAND).sum(axis=2, dtype=np.uint64)).view(np.int64)


def low_bits(values: np.ndarray) -> np.ndarray:
    """rows x 4 words: the lowest bit of all values, then the second lowest."""
    bits = np.concatenate([values & 1, (values >> 1) & 1], axis=1).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64)


def prefix_keys(shingles: np.ndarray) -> np.ndarray:
    """The least shingles of a sorted set of n, of which linked sets share one: n - ceil(0.75 n) + 1 of them."""
    n = shingles.size
    return mixed(shingles[: n + (-PERCENT * n) // 100 + 1] ^ _U(0x5851F42D4C957F2D)).view(np.int64)


def _signed(batches):
    """Rows (no, doc_id, text): the set's size, a key of its content, its buckets and its signature."""
    for whole in batches:
        for part in sliced(whole, "text"):
            shingles, at = shingle_sets(part.column(2))
            size = np.diff(at)
            some = np.flatnonzero(size)
            keys = [hashlib.blake2b(shingles[at[i] : at[i + 1]].tobytes(), digest_size=16).digest() if size[i] else None for i in range(size.size)]
            buckets, bits = [None] * size.size, [None] * size.size
            if some.size:
                values = min_max(shingles, np.concatenate((at[some], at[-1:])))
                for i, b, s in zip(some.tolist(), band_keys(values), low_bits(values), strict=True):
                    own = [b] if size[i] > SMALL else []
                    if size[i] <= SMALL_PARTNER:
                        own.append(prefix_keys(shingles[at[i] : at[i + 1]]))
                    buckets[i], bits[i] = np.unique(np.concatenate(own)), s
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(size), pa.array(keys, pa.binary()), pa.array(buckets, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                ["no", "doc_id", "n", "set_key", "buckets", "bits"],
            )


def _confirmed(batches):
    """Rows (centre, salt, role, cid, text) in order: the centre's own text comes first, then its members'."""
    centre, own = None, None
    for whole in batches:
        for part in sliced(whole, "text"):
            shingles, at = shingle_sets(part.column(4))
            ids, roles, cids = (part.column(k).to_numpy() for k in (0, 2, 3))
            salts = part.column(1).to_numpy()
            left, right = [], []
            for i in range(part.num_rows):
                here = shingles[at[i] : at[i + 1]]
                if roles[i] == 0:
                    centre, own = (ids[i], salts[i]), here
                    continue
                if centre != (ids[i], salts[i]):
                    raise ValueError("a member without its centre")
                both = np.intersect1d(own, here, assume_unique=True).size
                if 100 * both >= PERCENT * (own.size + here.size - both):
                    left.append(ids[i])
                    right.append(cids[i])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def agreement(x: str, y: str) -> Column:
    """In how many of the 128 values two rows' low two bits agree."""
    differ = [(F.col(f"{x}{i}").bitwiseXOR(F.col(f"{y}{i}"))).bitwiseOR(F.col(f"{x}{i + 2}").bitwiseXOR(F.col(f"{y}{i + 2}"))) for i in range(2)]
    return F.lit(128) - F.bit_count(differ[0]) - F.bit_count(differ[1])


def _plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes and signatures do not rule a link out."""
    bits = classes.select("cid", "n", *(F.get("bits", F.lit(i)).alias(f"s{i}") for i in range(4)))
    one = bits.select(F.col("cid").alias("a"), F.col("n").alias("na"), *(F.col(f"s{i}").alias(f"x{i}") for i in range(4)))
    two = bits.select(F.col("cid").alias("b"), F.col("n").alias("nb"), *(F.col(f"s{i}").alias(f"y{i}") for i in range(4)))
    near = (agreement("x", "y") >= LEAST_AGREEMENT) | (F.least("na", "nb") <= SMALL)
    near &= F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT
    return pairs.join(one, "a").join(two, "b").where(near).select("a", "b")


def _links(staging: Staging, pairs: DataFrame, texts: DataFrame, parts: int) -> DataFrame:
    """The pairs (a, b) that are links on full sets. A pair's members meet at its first, `a`; a hot `a` is copied to
    salts, and each `b` travels once a pair."""
    load = staging.write(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("salts")), "load")
    members = pairs.join(load, "a").select(F.col("a").alias("centre"), F.pmod(F.hash("b"), F.col("salts")).alias("salt"), F.lit(1).alias("role"), F.col("b").alias("cid"))
    centres = load.select(F.col("a").alias("centre"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("a").alias("cid"))
    rows = members.unionByName(centres).join(texts, "cid").select("centre", "salt", "role", "cid", "text")
    dealt = rows.repartition(parts, "centre", "salt").sortWithinPartitions("centre", "salt", "role")
    return dealt.mapInArrow(_confirmed, "a long, b long")


_CELL = ["bucket", "i", "j"]
_ROW = "bucket long, i int, j int, side int, comp long, cid long, n long, s0 long, s1 long, s2 long, s3 long"


def _cells(batches):
    """The cells (bucket, i, j) of rows that are in order of them, one after the other."""
    held: list[pa.RecordBatch] = []
    cell = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
        edges = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1).tolist(), len(keys)]
        for first, last in zip(edges, edges[1:], strict=False):
            here = tuple(keys[first].tolist())
            if here != cell and held:
                yield pa.concat_batches(held) if len(held) > 1 else held[0]
                held = []
            cell = here
            held.append(batch.slice(first, last - first))
    if held:
        yield pa.concat_batches(held) if len(held) > 1 else held[0]


def _near_pairs(rows: pa.RecordBatch, root: np.ndarray):
    """Blocks (i, j, agreement) of the pairs of a cell's two sides, or of its only one, that have different roots and are
    not ruled out by sizes and signatures. Roots are read anew for each block."""
    side, n = rows.column(3).to_numpy(), rows.column(6).to_numpy()
    bits = np.stack([rows.column(k).to_numpy() for k in range(7, 11)], axis=1).view(np.uint64)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    alone = rows.column(1)[0].as_py() == rows.column(2)[0].as_py()
    right = left if alone else right
    for first in range(0, left.size, 256):
        own = left[first : first + 256]
        x, y = bits[own][:, None], bits[right][None, :]
        differ = [np.bitwise_count((x[..., k] ^ y[..., k]) | (x[..., k + 2] ^ y[..., k + 2])) for k in range(2)]
        agree = 128 - differ[0].astype(np.int16) - differ[1]
        small, large = np.minimum(n[own][:, None], n[right][None, :]), np.maximum(n[own][:, None], n[right][None, :])
        near = ((agree >= LEAST_AGREEMENT) | (small <= SMALL)) & (small * 100 >= large * PERCENT) & (root[own][:, None] != root[right][None, :])
        if alone:
            near &= own[:, None] < right[None, :]
        i, j = np.nonzero(near)
        yield own[i], right[j], agree[i, j]


def _taking_part(batches):
    """The rows of each cell that are in a plausible pair at all."""
    for rows in _cells(batches):
        root, seen = rows.column(4).to_numpy(), np.zeros(rows.num_rows, bool)
        for i, j, _ in _near_pairs(rows, root):
            seen[i] = seen[j] = True
        yield rows.filter(pa.array(seen))


def _resolved(batches):
    """Links (a, b) between components, from the rows of _ROW and their text.

    A cell's plausible pairs are confirmed on full sets, the likeliest first. Components that a link joins count as one
    from then on, so that a cell costs few tests where most rows belong together and gives at most a link a row.
    """
    for rows in _cells(batches):
        _, root = np.unique(rows.column(4).to_numpy(), return_inverse=True)
        cid, sets = rows.column(5).to_numpy(), {}
        left, right = [], []
        for i, j, agree in _near_pairs(rows, root):
            order = np.argsort(-agree, kind="stable")
            for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
                if root[a] == root[b]:
                    continue
                for k in (a, b):
                    if k not in sets:
                        sets[k] = shingle_sets(rows.column(11).slice(k, 1))[0]
                both = np.intersect1d(sets[a], sets[b], assume_unique=True).size
                if 100 * both >= PERCENT * (sets[a].size + sets[b].size - both):
                    root[root == root[b]] = root[a]
                    left.append(int(cid[a]))
                    right.append(int(cid[b]))
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def _shared_buckets(staging: Staging, classes: DataFrame) -> DataFrame:
    """(bucket, cid, a) of all buckets with several classes. `a` is the bucket's centre: the class with the most
    company over all its buckets (ties: the least cid), which in a family of near copies is the text that most of them
    were made from, so that one star joins the family."""
    rows = classes.select("cid", F.explode("buckets").alias("bucket"))
    several = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = staging.write(rows.join(several, "bucket"), "several")
    company = shared.groupBy("cid").agg(F.sum("n").alias("company"))
    ranked = shared.join(company, "cid").select("bucket", "cid", F.struct("company", (-F.col("cid")).alias("neg")).alias("rank"))
    centre = ranked.groupBy("bucket").agg((-F.max("rank")["neg"]).alias("a"))
    out = staging.write(shared.select("bucket", "cid").join(centre, "bucket"), "shared")
    staging.drop("several")
    return out


def _across(staging: Staging, classes: DataFrame, shared: DataFrame, labels: DataFrame, texts: DataFrame, parts: int) -> DataFrame:
    """Links (a, b) of classes that share a bucket and are in different components still.

    Of a bucket that holds several components, those of its centre's component and the others are dealt to blocks each;
    each block of others meets each block of either in a cell of its own, so every pair with one of the others is seen,
    no cell is large, and no member of the centre's component is compared with another. Signatures travel first; the
    texts of the rows that are in a plausible pair follow them to the cells. Pairs never become rows: in a family whose
    members resemble each other below the threshold there are as many as its square.
    """
    comp = lambda name: labels.select(F.col("id").alias(f"__{name}"), F.col("comp").alias(f"comp_{name}"))
    joined = shared.join(comp("cid"), F.col("cid") == F.col("__cid"), "left").join(comp("a"), F.col("a") == F.col("__a"), "left")
    mine = F.coalesce("comp_cid", "cid")
    placed = staging.write(joined.select("bucket", "cid", mine.alias("comp"), (mine == F.coalesce("comp_a", "a")).alias("own")), "placed")
    load = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("own")).alias("others")).where("others > 0")
    block = F.least(F.lit(MOST_BLOCK), F.greatest(F.lit(LEAST_BLOCK), F.ceil(4 * F.sqrt("rows"))))
    blocks = lambda n: F.ceil(n / block).cast("int")
    load = staging.write(load.select("bucket", blocks(F.col("others")).alias("g"), blocks(F.col("rows") - F.col("others")).alias("h")), "cells")
    # Blocks 0..g-1 are the others', g..g+h-1 the centre's component's. Cell (i, j), i < g, i <= j: blocks i and j.
    at = F.when(F.col("own"), F.col("g") + F.pmod(F.hash("cid"), F.col("h"))).otherwise(F.pmod(F.hash("cid"), F.col("g")))
    rows = placed.join(load, "bucket").withColumn("at", at)
    span = lambda first, last, made: F.when(first <= last, F.transform(F.sequence(first, last), made)).otherwise(F.array().cast("array<struct<i:int,j:int,side:int>>"))
    cell = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    ahead = span(F.col("at"), F.col("g") + F.col("h") - 1, lambda j: cell(F.col("at"), j, 0))
    behind = span(F.lit(0), F.least(F.col("at"), F.col("g")) - 1, lambda i: cell(i, F.col("at"), 1))
    cells = F.when(F.col("own"), behind).otherwise(F.concat(ahead, behind))
    dealt = rows.select("bucket", "comp", "cid", F.explode(cells).alias("c")).select("bucket", "c.i", "c.j", "c.side", "comp", "cid")
    bits = classes.select("cid", "n", *(F.get("bits", F.lit(i)).alias(f"s{i}") for i in range(4)))
    dealt = dealt.join(bits, "cid").select("bucket", "i", "j", "side", "comp", "cid", "n", "s0", "s1", "s2", "s3")
    part = staging.write(dealt.repartition(parts, *_CELL).sortWithinPartitions(*_CELL).mapInArrow(_taking_part, _ROW), "part")
    told = part.join(texts, "cid").select(*part.columns, "text")
    return told.repartition(parts, *_CELL).sortWithinPartitions(*_CELL).mapInArrow(_resolved, "a long, b long")


def _components(spark: SparkSession, staging: Staging, rows: DataFrame, size: int | None) -> tuple[DataFrame, DataFrame]:
    """From (no, doc_id, text): the signed rows (n = 0: linked with nothing), and for each set_key its component: `component`,
    its least id, and `first`, the number of the one row that stands for it: of the least id, null last, then the first."""
    parts = parts_for(spark, size, PART_BYTES, factor=2)
    signed = staging.write(rows.mapInArrow(_signed, "no long, doc_id long, n long, set_key binary, buckets array<long>, bits array<long>"), "signed")
    classes = (
        signed.where("n > 0")
        .groupBy("set_key")
        .agg(
            F.min("no").alias("cid"),
            F.min("doc_id").alias("least"),
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "no")).alias("first"),
            F.first("n").alias("n"),
            F.first("buckets").alias("buckets"),
            F.first("bits").alias("bits"),
        )
    )
    classes = staging.write(classes, "classes")
    shared = _shared_buckets(staging, classes)
    wanted = shared.select(F.col("cid").alias("no")).distinct()
    texts = staging.write(rows.join(wanted, "no", "left_semi").select(F.col("no").alias("cid"), "text"), "texts")
    stars = shared.where("cid != a").select("a", F.col("cid").alias("b")).distinct()
    links = staging.write(_links(staging, staging.write(_plausible(stars, classes), "stars"), texts, parts), "links")
    labels = staging.write(connected(staging, links, "labels"), "labels")
    found = staging.write(_across(staging, classes, shared, labels, texts, parts), "found")
    if not found.isEmpty():
        labels = staging.write(connected(staging, links.unionByName(found), "relabels"), "relabels")
    staging.drop("texts", "shared", "placed", "part", "stars")
    comps = classes.select("set_key", "cid", "least", "first").join(labels, F.col("cid") == F.col("id"), "left").withColumn("comp", F.coalesce("comp", "cid"))
    comps = staging.write(comps.select("set_key", "comp", "least", "first"), "comps")
    heads = staging.write(comps.groupBy("comp").agg(F.min("least").alias("component"), F.min("first")["no"].alias("first")), "heads")
    return signed, staging.write(comps.select("set_key", "comp").join(heads, "comp").select("set_key", "component", "first"), "named")


def near_groups(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents linked by a Jaccard similarity of at least 0.75 of their sets of 5-word shingles.

    Words are maximal runs other than ASCII white space, A-Z lower-cased. A text of 1 to 4 words has one shingle, the
    whole sequence; a null, empty or blank text has none, is linked with nothing and is its own component.

    Returns a row per row of `docs`: doc_id, n_shingles, component_id (the least id reachable; null ids count last, and
    the component of a linkless null id is null) and kept (doc_id = component_id). Rows of a repeated id are documents
    of their own. Other columns are not read. An empty table gives an empty result.

    1. Documents with equal sets are one class (128-bit key); classes get min-max signatures and 32 bands, or, if small,
       the buckets of their least shingles, of which linked sets share one for certain.
    2. Each class is paired with its buckets' centres: one pair a row, whatever the bucket's size. Sizes and two-bit
       signatures rule pairs out; the rest are confirmed on full sets, computed anew from the texts, and confirmed
       pairs make components.
    3. Buckets that still hold several components are compared across these, in cells of bounded size, so that a link
       between two members that both differ from the centre is found; plausible pairs are confirmed inside their cell, and
       only links that join components leave it. The tests of signatures grow with the square of a bucket's classes that
       are in no component together, in even cells.
    A link of sets over 16 shingles is lost only if all 32 bands differ (below 9e-6 at 0.75, less above) or by the
    signature test (below 1e-8); one of a smaller set never is.
    """
    staging = Staging(spark, "near_groups")
    rows, _ = numbered(staging, docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text")))
    signed, components = _components(spark, staging, rows.select(F.col("__no").alias("no"), "doc_id", "text"), input_bytes(docs))
    staging.drop("rows")
    linked = signed.where("n > 0").select("doc_id", "n", "set_key").join(components, "set_key").select("doc_id", "n", "component")
    out = linked.unionByName(signed.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(False)).alias("kept"))


def keep_representatives(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of `docs` for each component, all columns as they are: that of the least id, null ids last.

    Of several rows under that id the first as read stays. Rows without words are components of their own and stay. An
    empty table gives an empty result.
    """
    staging = Staging(spark, "keep_representatives")
    rows, no = numbered(staging, docs)
    texts = rows.select(F.col(no).alias("no"), named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    signed, components = _components(spark, staging, texts, input_bytes(docs))
    kept = components.select(F.col("first").alias("no")).distinct().unionByName(signed.where("n = 0").select("no"))
    return only(rows, no, kept)
