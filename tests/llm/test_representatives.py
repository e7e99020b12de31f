"""One document of each near-duplicate group, whatever the ids: repeated, null, or both."""

import random

from llm_cases import components, shingle_set

from spanmill.llm import neardup

SCHEMA = "doc_id long, text string, lang string"


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], SCHEMA)
    return sorted(((r["doc_id"], r["text"]) for r in neardup.keep_representatives(spark, docs).collect()), key=str)


def made(rng, n=60):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def near(text):
    return text + " tail"


def test_unrelated_texts_of_one_id_stay(spark):
    rng = random.Random(1)
    a, b, c = made(rng), made(rng), made(rng)
    assert kept(spark, [(5, a), (5, b), (6, c)]) == sorted([(5, a), (5, b), (6, c)], key=str)


def test_a_repeated_id_takes_no_group_away(spark):
    rng = random.Random(2)
    for _ in range(3):
        a, b = made(rng), made(rng)
        got = kept(spark, [(5, a), (7, near(a)), (5, b)])
        assert got == sorted([(5, a), (5, b)], key=str)


def test_near_copies_without_ids_leave_one(spark):
    rng = random.Random(3)
    a, b, c = made(rng), made(rng), made(rng)
    got = kept(spark, [(None, a), (None, near(a)), (None, b), (9, near(c)), (None, c), (None, ""), (4, " ")])
    assert len(got) == 5
    assert {(9, near(c)), (None, b), (None, ""), (4, " ")} < set(got)
    assert len({(None, a), (None, near(a))} & set(got)) == 1


def test_one_of_each_component_against_brute_force(spark):
    rng = random.Random(4)
    bases = [made(rng) for _ in range(12)]
    rows = [(rng.choice([None, *range(8)]), base + " x" * 1 + f" y{k}") for base in bases for k in range(rng.randrange(1, 4))]
    groups = components({k: shingle_set(t) for k, (_, t) in enumerate(rows)})
    got = kept(spark, rows)
    assert len(got) == len(set(groups.values()))
    where = {t: groups[k] for k, (_, t) in enumerate(rows)}
    least = {}
    for k, (i, _) in enumerate(rows):
        least[groups[k]] = min(least.get(groups[k], (True, 0)), (i is None, i or 0))
    assert {where[t]: (i is None, i or 0) for i, t in got} == least
