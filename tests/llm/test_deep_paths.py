"""op4 tells all segments of a path apart, against the brute force of the operator."""

from collections import Counter

import pytest
from test_table_operators import brute_judged, judged

from spanmill.llm import urls


def test_branches_below_the_fourth_segment_are_judged_apart(spark):
    pages = [(i, f"https://h.org/a/b/c/d/{'spam' if i % 2 else 'news'}/{'pqrstuvwxyzklmno'[i // 2 % 16]}/item-{i}") for i in range(320)]
    pages += [(1000 + i, f"https://k.org/{'/'.join('abcdefgh'[: i % 9])}") for i in range(40)]
    pages += [(2000, "https://t.org/" + "a/" * 3_000), (2001, "https://u.org/x/" + "b/" * 900), (2002, "https://u.org/y/" + "b/" * 900)]
    labels = [(i, int(i % 2 == 0)) for i in range(0, 320, 3)] + [(1000 + i, int(i % 9 < 6)) for i in range(0, 40, 2)]
    frame = spark.createDataFrame(pages, "page_id long, url string")
    got = judged(spark, frame, spark.createDataFrame(labels, "page_id long, good int"))
    assert {k[4] for k in got if "/spam/" in k[2]} == {"block"}
    assert {k[4] for k in got if "/news/" in k[2]} == {"allow"}
    # The long lone paths are as the brute force has them without its thousands of passes over the others.
    long = {k for k in got if k[0] >= "2000" and len(k[0]) == 4}
    assert got - Counter(long) == brute_judged(pages[:-3], dict(labels)) and len(long) == 3


@pytest.mark.parametrize("rows", [[], [(1, None), (2, "http://a.org")]])
def test_tables_without_a_path(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(1, 1)], "page_id long, good int")
    assert urls.judge_urls(spark, pages, labels).count() == len(rows)
