"""Awkward documents for all operators, and small helpers."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size long, shard int, score double, component_id long, batch long, bucket int, name string, k1 long, k2 long, n long"
PROSE = "The quick brown fox jumps over the lazy dog and runs far away from the old stone house by the river"
LONG = " ".join(f"w{i % 977}x{i // 977}" for i in range(40_000))


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, len(text or ""), True, 1, 2, 0.5, 3, 4, 5, "x", 6, 7, 8)


ROWS = [
    row(1, PROSE),
    row(2, PROSE),
    row(2, PROSE),
    row(3, PROSE.upper(), source=None),
    row(4, None, lang=None, source=None),
    row(5, ""),
    row(6, " \t\n "),
    row(7, "one two three"),
    row(8, "ONE two three"),
    row(9, LONG, source="b"),
    row(10, LONG + " end", source="b"),
    row(None, "a text without an id that is long enough for shingles", source="b"),
    row(None, None),
    row(11, "é ü 漢字 😀 words\u00a0joined"),
    row(12, "12345 !!! 678"),
    row(13, PROSE + " again"),
    row(13, "another text under an id that another row has too", lang="fr"),
    row(14, "x"),
]


def edge_docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text):
    return (text or "").translate(LOWER)


def shingle_set(text):
    w = words(lower(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(sets):
    """Brute force: {key: least key reachable} over links of similarity 0.75 or more."""
    keys = sorted(sets)
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)) and 100 * len(x & y) >= 75 * len(x | y):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {k: find(k) for k in keys}
