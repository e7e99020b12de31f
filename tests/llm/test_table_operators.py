"""Sharding, mixing, packing, URL templates: operators over whole tables."""

import itertools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import ROWS, edge_docs, empty_docs
from pyspark.sql import functions as F

from spanmill.llm import attribution, mixing, packing, queries, sharding, urls


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_shards_against_brute_force(spark, shards):
    rows = sorted(((r[0] is not None, r[0] or 0), len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode()), r[0]) for r in ROWS)
    total, before, want = sum(r[1] for r in rows), 0, []
    slots = Counter()
    for _, size, crc, doc_id in rows:
        shard = (2 * before + size) * shards // (2 * total)
        want.append((str(doc_id), size, crc, shard, slots[shard]))
        slots[shard] += 1
        before += size
    got = [(str(r["doc_id"]), r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.byte_shards(spark, edge_docs(spark), shards).collect()]
    assert sorted(got) == sorted(want)
    assert sharding.byte_shards(spark, empty_docs(spark)).count() == 0


def test_shards_are_contiguous_and_even(spark):
    got = queries.op3_byte_shards(spark, f"{DATA}/sf0.01").collect()
    size, ids = defaultdict(int), defaultdict(list)
    for r in got:
        size[r["shard"]] += r["size"]
        ids[r["shard"]].append((r["doc_id"], r["slot"]))
    assert sorted(size) == list(range(16))
    assert max(size.values()) - min(size.values()) <= 2 * max(r["size"] for r in got)
    flat = [i for s in sorted(ids) for i, _ in sorted(ids[s], key=lambda x: x[1])]
    assert flat == sorted(flat)
    assert all(sorted(x for _, x in ids[s]) == list(range(len(ids[s]))) for s in ids)


def test_poisson_counts_follow_the_mean(spark):
    for mean in (0.0, 0.3, 2.5, 40.0, 1000.0):
        tabled = spark.range(4000).withColumn("t", mixing.poisson_table(F.lit(mean)))
        rows = tabled.select(mixing.poisson_count(F.col("t"), 3, F.col("id").cast("string")).alias("n")).collect()
        counts = np.array([r["n"] for r in rows])
        assert counts.mean() == pytest.approx(mean, abs=5 * math.sqrt(max(mean, 1e-9) / 4000) + 1e-9)
        if mean:
            assert counts.var() == pytest.approx(mean, rel=0.12)


def test_mixing_keeps_columns_and_whole_copies(spark):
    docs = edge_docs(spark)
    got = mixing.poisson_mix(spark, docs, F.lit(1.0))
    assert got.columns == [*docs.columns, "mix_mean", "mix_copy", "mix_key"]
    rows = got.collect()
    sources = {r["source"]: r["mix_mean"] for r in rows}
    counts = Counter(r[3] for r in ROWS)
    for s, mean in sources.items():
        assert mean == pytest.approx(len(ROWS) / len(counts) / counts[s])
    copies = defaultdict(list)
    for r in rows:
        copies[(r["doc_id"], r["text"], r["mix_key"])].append(r["mix_copy"])
    again = {(r["doc_id"], r["mix_copy"], r["mix_key"]) for r in mixing.poisson_mix(spark, docs.orderBy(F.desc("n_chars")), F.lit(1.0)).collect()}
    assert again == {(r["doc_id"], r["mix_copy"], r["mix_key"]) for r in rows}
    assert mixing.poisson_mix(spark, empty_docs(spark)).count() == 0


def exhaustive(lengths, counts, buckets):
    best = math.inf
    n = len(lengths)
    for k in range(min(buckets, n)):
        for cut in itertools.combinations(range(1, n), k):
            edges = [0, *cut, n]
            cost = sum(counts[i] * (lengths[b - 1] - lengths[i]) for a, b in itertools.pairwise(edges) for i in range(a, b))
            best = min(best, cost)
    return best


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), min_size=1, max_size=9), st.integers(1, 4))
def test_bounds_have_the_least_padding(histogram, buckets):
    lengths = np.array(sorted(histogram))
    counts = np.array([histogram[x] for x in lengths])
    bounds = packing.best_bounds(lengths, counts, buckets)
    assert len(bounds) <= buckets
    padding = sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts, strict=True))
    assert padding == exhaustive(lengths.tolist(), counts.tolist(), buckets)


def brute_pieces(rows, window):
    """(id, start, length, bytes) of all pieces, by the encoder's own tokens."""
    encoder, _ = attribution._encoder(attribution.VOCABULARY, attribution.PATTERN)
    want = Counter()
    for r in rows:
        tokens = [encoder.decode_single_token_bytes(t) for t in encoder.encode_ordinary(r[1] or "")] + [b""]
        for start in range(0, len(tokens), window):
            part = tokens[start : start + window]
            want[(r[0], start, len(part), b"".join(part))] += 1
    return want


def test_batches_hold_every_token_once_within_the_budget(spark):
    got = packing.length_buckets(spark, edge_docs(spark), buckets=3, window=1000, budget=4000).collect()
    texts = defaultdict(set)
    for r in ROWS:
        texts[r[0]].add((r[1] or "").encode())
    want = brute_pieces(ROWS, 1000)
    assert Counter((r["doc_id"], r["start"], r["length"]) for r in got) == sum((Counter({k[:3]: n}) for k, n in want.items()), Counter())
    for r in got:
        assert r["piece"] * 1000 == r["start"]
        assert any(want[(r["doc_id"], r["start"], r["length"], t[r["first_byte"] : r["last_byte"]])] for t in texts[r["doc_id"]])
    histogram = Counter(r["length"] for r in got)
    lengths = sorted(histogram)
    padding = sum(r["bucket"] - r["length"] for r in got)
    assert padding == min(
        sum(histogram[x] * (min(b for b in (*cut, lengths[-1]) if b >= x) - x) for x in lengths) for cut in itertools.combinations(lengths[:-1], min(2, len(lengths) - 1))
    )
    by = defaultdict(list)
    for r in got:
        by[r["batch"]].append(r)
    assert sorted(by) == list(range(len(by)))
    for rows in by.values():
        bucket = {r["bucket"] for r in rows}
        assert len(bucket) == 1
        assert all(r["length"] <= r["bucket"] for r in rows)
        assert len(rows) <= max(1, 4000 // bucket.pop())
        assert sorted(r["place"] for r in rows) == list(range(len(rows)))
    full = Counter(len(v) * v[0]["bucket"] <= 4000 for v in by.values())
    assert full[True] == len(by)
    assert packing.length_buckets(spark, empty_docs(spark)).count() == 0


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    path = rest[cut:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.text), default=None)


def brute_templates(pages):
    """{(host, segments): (template, good, bad)} by the rules of the operator, node by node."""
    import re

    def segments(path):
        out = [s for s in path.split("/") if s]
        out = ["*" if re.fullmatch(r"[0-9a-fA-F-]{8,}", s) and re.search("[0-9]", s) else re.sub("[0-9]+", "*", s) for s in out]
        return tuple(out)

    stats = defaultdict(lambda: [0, 0, 0])
    for host, path, good in pages:
        s = stats[(host, segments(path))]
        s[0] += 1
        s[1] += good == 1
        s[2] += good == 0
    leaf = {k: k[1] for k in stats}
    depth = max((len(t) for t in leaf.values()), default=0)
    for d in range(depth):
        kids = defaultdict(Counter)
        for k, t in leaf.items():
            if len(t) > d:
                kids[(k[0], t[:d])][t[d]] += stats[k][0]
        for k, t in list(leaf.items()):
            if len(t) > d:
                own = kids[(k[0], t[:d])]
                if not (len(own) <= urls.FEW_BRANCHES or own[t[d]] >= urls.LEAST_SHARE * sum(own.values())):
                    leaf[k] = (*t[:d], "*", *t[d + 1 :])
    merged = dict(leaf)
    for d in range(depth - 1, -1, -1):
        sums = defaultdict(lambda: [0, 0])
        for k, t in merged.items():
            sums[(k[0], t)][0] += stats[k][1]
            sums[(k[0], t)][1] += stats[k][2]
        nodes = defaultdict(list)
        for (host, t), (g, b) in sums.items():
            if len(t) > d:
                nodes[(host, t[:d], t[d + 1 :])].append(((g + 1) / (g + b + 2), t[d], g + b + 2, t))
        to = {}
        for (host, _, _), members in nodes.items():
            members.sort()
            run = [members[0]]
            for m in members[1:]:
                p0, k0, p1, k1 = run[-1][0], run[-1][2], m[0], m[2]
                pool = (p0 * k0 + p1 * k1) / (k0 + k1)
                if p1 - p0 > urls.MERGE_Z * math.sqrt(pool * (1 - pool) * (1 / k0 + 1 / k1)):
                    for x in run:
                        to[(host, x[3])] = "|".join(sorted(y[1] for y in run))
                    run = []
                run.append(m)
            for x in run:
                to[(host, x[3])] = "|".join(sorted(y[1] for y in run))
        merged = {k: (*t[:d], to[(k[0], t)], *t[d + 1 :]) if len(t) > d else t for k, t in merged.items()}
    total = defaultdict(lambda: [0, 0])
    for k, t in merged.items():
        total[(k[0], t)][0] += stats[k][1]
        total[(k[0], t)][1] += stats[k][2]
    return segments, {k: (t, *total[(k[0], t)]) for k, t in merged.items()}


def brute_judged(pages, labels=None):
    rows = [(i, *brute_url(u)) for i, u in pages]
    if labels is None:
        assert len({i for i, _ in pages}) == len(pages)
        labels = {i: int(rule.verdict == "allow") for i, _, _, rule in rows if rule}
    segments, found = brute_templates([(h, p, labels.get(i)) for i, h, p, _ in rows])
    once = {(k[0], t): (g, b) for k, (t, g, b) in found.items()}
    good, bad = sum(g for g, _ in once.values()), sum(b for _, b in once.values())
    overall = good / (good + bad) if good + bad else 0.5
    host = defaultdict(lambda: [0, 0])
    for (h, _), (g, b) in once.items():
        host[h][0] += g
        host[h][1] += b
    out = []
    for i, h, p, rule in rows:
        t, g, b = found[(h, segments(p))]
        prior = (host[h][0] + urls.SMOOTHING * overall) / (sum(host[h]) + urls.SMOOTHING)
        purity = (g + urls.SMOOTHING * prior) / (g + b + urls.SMOOTHING)
        verdict = rule.verdict if rule else "allow" if purity >= urls.LEAST_PURITY else "block"
        out.append((str(i), h, p, rule.text if rule else None, verdict, "/" + "/".join(t), round(purity, 6)))
    return Counter(out)


def judged(spark, pages, labels=None):
    got = urls.judge_urls(spark, pages, labels).collect()
    return Counter((str(r["page_id"]), r["host"], r["path"], r["rule"], r["verdict"], r["template"], r["purity"]) for r in got)


def test_urls_against_brute_force(spark):
    pages = spark.read.parquet(f"{DATA}/sf0.01/pages.parquet")
    labels = spark.read.parquet(f"{DATA}/sf0.01/labels.parquet").selectExpr("doc_id page_id", "cast(quality = 1 and toxic = 0 as int) good")
    want = brute_judged([(r["page_id"], r["url"]) for r in pages.collect()], {r["page_id"]: r["good"] for r in labels.collect()})
    assert judged(spark, pages, labels) == want
    assert judged(spark, pages) == brute_judged([(r["page_id"], r["url"]) for r in pages.collect()])


def test_urls_of_awkward_pages(spark):
    made = [(i, f"https://big.example.org/{'spam' if i % 3 else 'news'}/{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{i % 7}x/item-{i}") for i in range(400)]
    odd = [
        (1000, None),
        (1001, "no scheme"),
        (1002, "http://"),
        (1003, "HTTP://WWW.Example.COM/en/x?a=/b#c"),
        (1004, "https://example.com/en/1"),
        (1005, "https://example.com"),
        (1006, "https://notexample.com/en/"),
        (1007, "https://a.net/es/#x"),
        (1008, "https://net/fr/"),
        (1009, "https://h.org/a/b/c/d/e/f/g/0123456789abcdef"),
        (1009, "https://h.org/a/b/c/d/e/f/g/0123456789abcdef"),
        (None, "https://h.org//x//"),
        (1010, "https://h.org/" + "y" * 20_000),
        (1011, "a://b://c/d"),
    ]
    labels = [(i, int(i % 3 == 0)) for i in range(0, 400, 2)] + [(1009, 0), (0, 1)]
    pages = spark.createDataFrame([(*p, "v", "h", 1.0) for p in made + odd], "page_id long, url string, verdict string, host string, purity double")
    marks = spark.createDataFrame(labels, "page_id long, good int")
    assert judged(spark, pages, marks) == brute_judged(made + odd, dict(labels))
    block = [k for k in judged(spark, pages, marks) if k[1] == "big.example.org"]
    assert {k[4] for k in block if k[2].startswith("/spam")} == {"block"}
    assert {k[4] for k in block if k[2].startswith("/news")} == {"allow"}
    assert urls.judge_urls(spark, pages.where("false"), marks).count() == 0
    assert judged(spark, pages, marks.where("false")) == brute_judged(made + odd, {})
