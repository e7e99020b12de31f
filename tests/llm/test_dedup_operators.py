"""Exact groups, near groups, repeated passages, components, and the pipeline, against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import DATA
from llm_cases import PROSE, ROWS, components, edge_docs, empty_docs, lower, shingle_set, words
from test_table_operators import brute_pieces

from spanmill.llm import exact, neardup, repeats
from spanmill.llm.components import connected
from spanmill.llm.shared import Staging


def test_exact_groups_of_awkward_rows(spark):
    got = exact.exact_groups(spark, edge_docs(spark)).collect()
    groups = defaultdict(list)
    for r in ROWS:
        groups[lower(r[1])].append(r[0])
    want = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert kept == Counter({hashlib.sha256(t.encode()).hexdigest(): 1 for t in groups})
    assert exact.exact_groups(spark, empty_docs(spark)).count() == 0


def test_long_texts_differ_by_one_byte_in_any_block(spark):
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh ") for _ in range(exact.BLOCK_BYTES * 5 + 17))
    texts = [base, base, base.upper()]
    for at in (0, exact.BLOCK_BYTES, exact.BLOCK_BYTES * 3 + 1, len(base) - 1):
        texts.append(base[:at] + "Z" + base[at + 1 :])
    texts += [base[:-1], base[: exact.BLOCK_BYTES], base[: exact.BLOCK_BYTES * 2], base[exact.BLOCK_BYTES : exact.BLOCK_BYTES * 2] * 2, base[: exact.BLOCK_BYTES] * 2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["keep_id"] for r in exact.exact_groups(spark, docs).collect()}
    assert got == {i: max(j for j, u in enumerate(texts) if lower(u) == lower(t)) for i, t in enumerate(texts)}


def check_near(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_groups(spark, docs).collect()}
    sets = {i: shingle_set(t) for i, t in texts.items()}
    want = components(sets)
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in texts}


def changed(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
    return " ".join(w)


def test_near_groups_of_families_without_their_original(spark):
    """Copies of a text that is not there, near the threshold to each other: chains of links, not stars."""
    rng = random.Random(8)
    texts, i = {}, 0
    for _ in range(6):
        base = " ".join(f"v{rng.randrange(10**6)}" for _ in range(150))
        for _ in range(25):
            texts[i] = changed(rng, base, rng.randrange(2, 6))
            i += 1
    check_near(spark, texts)


def test_buckets_beyond_a_block_are_split_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LEAST_BLOCK", 4)
    monkeypatch.setattr(neardup, "MOST_BLOCK", 4)
    rng = random.Random(9)
    base = " ".join(f"v{rng.randrange(10**6)}" for _ in range(120))
    texts = {i: changed(rng, base, rng.randrange(1, 6)) for i in range(60)}
    texts |= {100 + i: " ".join(base.split()[:60]) + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(60)) for i in range(20)}
    check_near(spark, texts)


def test_near_groups_of_small_table(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()
    check_near(spark, {r["doc_id"]: r["text"] for r in docs})


def test_near_groups_of_awkward_rows(spark):
    got = neardup.near_groups(spark, edge_docs(spark)).collect()
    assert len(got) == len(ROWS)
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["n_shingles"], r["component_id"], r["kept"]))
    assert {c for _, c, _ in by[1] | by[2] | by[3]} == {1}
    assert by[4] == {(0, 4, True)} and by[5] == {(0, 5, True)} and by[6] == {(0, 6, True)}
    assert by[7] == {(1, 7, True)} and by[8] == {(1, 7, False)}
    assert {c for _, c, _ in by[9] | by[10]} == {9}
    assert {(c, k) for _, c, k in by[None]} == {(None, False)}
    assert neardup.near_groups(spark, empty_docs(spark)).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 63, 2000).astype(np.uint64))
    other = np.unique(np.concatenate([base[: 3 * base.size // 4], rng.integers(0, 1 << 63, base.size // 4).astype(np.uint64)]))
    j = np.intersect1d(base, other).size / np.union1d(base, other).size
    values = neardup.min_max(np.concatenate([base, other]), np.array([0, base.size, base.size + other.size]))
    assert (values[0] == values[1]).mean() == pytest.approx(j, abs=0.15)


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(300, 200)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r["id"]: r["comp"] for r in connected(Staging(spark, "t"), df, "c").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 300: 200}


def brute_repeats(texts):
    all_words = [words(t) for t in texts]
    counts = Counter(tuple(w[i : i + 35]) for w in all_words for i in range(len(w) - 34))
    out = []
    for w in all_words:
        gone = set()
        for i in range(len(w) - 34):
            if counts[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def check_repeats(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in repeats.remove_repeats(spark, docs, digest=True).collect())
    assert got == Counter((i, *b) for (i, _), b in zip(rows, brute_repeats([t for _, t in rows]), strict=True))


def test_repeats_against_brute_force(spark):
    rng = random.Random(11)
    fresh = lambda n: " ".join(f"t{rng.randrange(10**6)}" for _ in range(n))
    passage, line = fresh(60), fresh(35)
    rows = [(i, f"{fresh(rng.randrange(0, 90))} {passage}\n {fresh(rng.randrange(0, 50))}") for i in range(30)]
    rows += [(40, line), (41, f"x {line}"), (42, f"{line}  y"), (43, " ".join(line.split()[:34])), (44, line.upper())]
    rows += [(50, "a " * 100), (51, "a " * 35), (52, "b " * 34), (53, "c d " * 40), (54, fresh(200)), (55, None), (56, ""), (57, " \n ")]
    same = fresh(80)
    rows += [(60, same + " " + same), (61, fresh(36)), (61, fresh(36)), (62, same), (62, same), (None, line)]
    check_repeats(spark, rows)


def test_repeats_of_awkward_rows(spark):
    got = repeats.remove_repeats(spark, edge_docs(spark)).collect()
    assert len(got) == len(ROWS)
    assert {(r["doc_id"], r["n_removed"]) for r in got if r["doc_id"] in (9, 10)} == {(9, 40_000), (10, 40_000)}
    assert [r["kept_text"] for r in got if r["doc_id"] == 10] == ["end"]
    assert {r["kept_text"] for r in got if r["doc_id"] == 1} == {PROSE}
    assert repeats.remove_repeats(spark, empty_docs(spark)).count() == 0


def test_sliding_least():
    x = np.random.default_rng(1).integers(0, 1000, 200)
    for size in (1, 2, 5, 16, 31):
        assert repeats.sliding_least(x, size).tolist() == [min(x[i : i + size]) for i in range(201 - size)]


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()
    rows = [r.asDict() for r in docs if r["text"] and any(c.isalpha() for c in r["text"])]  # all of these are prose
    best = {}
    for r in rows:
        best[lower(r["text"])] = max(best.get(lower(r["text"]), -1), r["doc_id"])
    rows = [r for r in rows if best[lower(r["text"])] == r["doc_id"]]
    comp = components({r["doc_id"]: shingle_set(r["text"]) for r in rows})
    rows = [r for r in rows if comp[r["doc_id"]] == r["doc_id"]]
    size = Counter(r["source"] for r in rows)
    weight = sum(n**0.5 for n in size.values())
    pieces = Counter()
    for r in rows:
        mean = size[r["source"]] ** 0.5 / weight * len(rows) / size[r["source"]]
        u = int(hashlib.md5(f"draw7:0:{r['doc_id']}:{hashlib.md5(r['text'].encode()).hexdigest()}".encode()).hexdigest()[:13], 16) / 2**52
        p = c = np.exp(-mean)
        n = 0
        while c <= u:
            n += 1
            p *= mean / n
            c += p
        for (i, start, length, _), k in brute_pieces([(r["doc_id"], r["text"])], 4096).items():
            pieces[(i, start, length)] += n * k
    got = corpus_pipeline.run(spark, f"{DATA}/sf0.001").collect()
    assert Counter((r["doc_id"], r["start"], r["length"]) for r in got) == +pieces
    assert sorted({r["batch"] for r in got}) == list(range(max(r["batch"] for r in got) + 1))


def test_pipeline_stages_keep_the_columns(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "mixing", "packing"]
    docs = edge_docs(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns
    assert not exact.keep_distinct(spark, empty_docs(spark)).count()
    assert not neardup.keep_representatives(spark, empty_docs(spark)).count()
    kept = [(r["doc_id"], r["text"]) for r in exact.keep_distinct(spark, docs).collect()]
    assert Counter(lower(t) for _, t in kept).most_common(1)[0][1] == 1
    assert len(kept) == len({lower(r[1]) for r in ROWS})


def test_heavy_buckets_are_counted_by_fingerprint(spark, monkeypatch):
    """Every bucket is too heavy to be held, and mappers flush often, so that copies come in different blobs."""
    monkeypatch.setattr(repeats, "HEAVY_BYTES", 0)
    monkeypatch.setattr(repeats, "FLUSH_BYTES", 1 << 12)
    rng = random.Random(12)
    fresh = lambda n: " ".join(f"t{rng.randrange(10**6)}" for _ in range(n))
    passage = fresh(60)
    rows = [(i, f"{fresh(rng.randrange(0, 90))} {passage} {fresh(rng.randrange(0, 50))}") for i in range(40)]
    rows += [(50, "a " * 400), (51, "c d " * 90), (52, fresh(300)), (53, None), (None, passage), (None, passage), (54, passage + " " + passage)]
    check_repeats(spark, rows)


def test_components_need_few_rounds_on_a_shuffled_path(spark):
    ids = list(range(6_400))
    random.Random(1).shuffle(ids)
    links = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "a long, b long")
    rounds = []
    got = connected(Staging(spark, "t"), links, "p", rounds)
    assert got.count() == got.where("comp = 0").count() == 6_400
    assert rounds[0] <= 30


def test_links_of_small_sets_are_never_lost(spark):
    """All pairs of sizes up to 21 that just reach the threshold: no band need agree on so few shingles."""
    rng = random.Random(13)
    texts, i = {}, 0
    for n in range(3, 17):
        for _ in range(20):
            own = [f"s{rng.randrange(10**9)}" for _ in range(n + 4)]
            gone = n - (3 * n + 3) // 4
            texts[i], texts[i + 1] = " ".join(own), " ".join(own[: len(own) - gone])
            i += 2
    check_near(spark, texts)
