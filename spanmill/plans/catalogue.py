"""Catalogue, selection, set operations, splits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.functions.numeric import BAND_KEYS, band
from spanmill.operators import catalog as ca
from spanmill.operators import splitting as sp
from spanmill.plans.inputs import BAND_SQL, JUDGED_SQL, judged, r6, rounded, table

LOW, HIGH = 0.1, 2.0


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with labels as votes and durations: quality for, toxic against; a label row carries the duration."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("up_votes"), F.col("toxic").cast("string").alias("down_votes"), F.lit(1).alias("labelled"))
    out = docs.join(labels, "doc_id", "left")
    units = F.length(F.regexp_replace("text", "[^aeiou]", ""))
    return out.select("doc_id", "source", "lang", "up_votes", "down_votes", F.trim("text").alias("sentence"), units.alias("units"), F.when(F.col("labelled").isNotNull(), F.col("n_chars") / 4.0).alias("duration"))


def _rules():
    rate = F.col("units") / F.col("duration")
    return [
        (ca.VOTES, F.col("up_votes").isNotNull() & ca.down_voted(F.col("up_votes"), F.col("down_votes"))),
        (ca.EMPTY, F.col("sentence") == ""),
        (ca.DIGITS, F.col("sentence").rlike("[0-9]{3,}")),
        (ca.NO_DURATION, F.coalesce(F.col("duration") <= 0, F.lit(True))),
        (ca.OUTLIER, (rate < LOW) | (rate > 1.0)),
    ]


def catalog_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.with_reason(_documents(spark, sf_dir), _rules()).select("doc_id", "units", "duration", "reason")


def built_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue from transcripts, durations and readings, all made of parts: names are sentences, their vowels the
    readings, sizes the seconds. Some have blank sentences, odd votes, long numbers, unread letters or no duration."""
    k, every = F.col("p_partkey"), lambda n: F.col("p_partkey") % n == 0
    parts = table(spark, sf_dir, "part").withColumn("path", F.concat(F.lit("clips/part."), k, F.lit(".mp3")))
    said = F.when(every(17), F.lit("  ")).when(every(11), F.concat("p_name", F.lit(" "), 2000 + k % 7)).otherwise(F.concat(F.lit(" "), "p_name"))
    votes = F.when(every(23), F.lit("x")).otherwise((k % 4).cast("string"))
    transcripts = parts.select("path", said.alias("sentence"), (F.col("p_size") % 4 + 1).cast("string").alias("up_votes"), votes.alias("down_votes"))
    durations = parts.where(k % 13 != 0).select("path", F.when(every(19), F.lit(0.0)).otherwise(F.col("p_size") / 10.0).alias("duration"))
    read = F.translate(F.regexp_replace("sentence", "[^aiueobAIUEO]", ""), "aiueo", "アイウエオ")
    readings = transcripts.select(F.trim("sentence").alias("sentence")).distinct().withColumn("kana", read)
    out = ca.build_catalog(transcripts, durations, readings)
    return out.select("item_id", "sentence", "reason", F.col("units").cast("long").alias("units"), r6(F.col("duration")).alias("duration"), r6(F.col("rate")).alias("rate"))


def reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.reason_counts(_documents(spark, sf_dir), _rules())


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reasons at once, for labelled documents; others are pending."""
    rows = _documents(spark, sf_dir)
    rules = [
        (ca.ALIGN_FAILED, F.col("up_votes") == "0"),
        (ca.COUNT_MISMATCH, F.col("units") % 7 == 0),
        (ca.HEAD, F.col("sentence").startswith("Th")),
        (ca.TAIL, F.col("sentence").endswith(".")),
        (ca.NO_SPEECH, F.col("down_votes") == "1"),
    ]
    out = rows.withColumn("pending", F.col("up_votes").isNull()).withColumn("reasons", F.when(F.col("pending"), F.array().cast("array<string>")).otherwise(ca.all_reasons(rules)))
    return out.withColumn("rate", F.length("sentence") / 500.0)


def selection_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir).select("doc_id", "pending", F.array_join("reasons", "+").alias("reasons"), ca.primary(F.col("reasons")).alias("primary_reason"))


def selection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.selection_report(_selected(spark, sf_dir))


def overlapping_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.overlapping_reasons(_selected(spark, sf_dir))


def reason_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.reason_combinations(_selected(spark, sf_dir))


def reason_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.reason_pivot(_selected(spark, sf_dir).withColumn("band", band(F.col("rate"))), BAND_KEYS)


def three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with labels and benchmark rows by id; pending where either is missing."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "source")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), "quality")
    bench = table(spark, sf_dir, "benchmark").select("item_id", F.length("text").alias("length"))
    return ca.three_way(docs, labels, bench).groupBy("source", "pending").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("n_quality"))


def group_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.group_summary(table(spark, sf_dir, "documents"), "source", "n_chars")


def rate_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumn("rate", F.col("n_chars") / 400.0)
    return rounded(ca.distribution(rows, "rate", ["lang"]))


def rate_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumn("rate", F.col("n_chars") / 400.0)
    return ca.histogram(rows, "rate", 1.0, 12.0, 0.5)


def select_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of some sources, of a labelled id, within length bounds, the first 100 by source and id."""
    docs = table(spark, sf_dir, "documents")
    groups = docs.groupBy("source").agg(F.sum("n_chars").alias("c")).where("c % 2 = 0").select("source")
    ids = table(spark, sf_dir, "labels").select("doc_id")
    return ca.select_items(docs, groups, "source", ["source", "doc_id"], 100, 8000, "n_chars", ids, "doc_id", 100).select("doc_id", "source", "n_chars")


def missing_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return ca.missing_both_ways(pages, labels, "id")


def union_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    both = pages.intersect(labels).select("id", F.lit("both").alias("kind"))
    return both.unionByName(pages.union(labels).distinct().select("id", F.lit("any").alias("kind"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("total"))


def top_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 largest errors: a top-k report."""
    rows = judged(spark, sf_dir).groupBy("l_orderkey").agg(F.sum("truth").alias("units"), F.sum("pred").alias("pred"), F.count(F.lit(1)).cast("double").alias("duration"))
    cases = ca.error_cases(rows.select("l_orderkey", "pred"), rows.select("l_orderkey", "units", "duration"), "l_orderkey")
    top = ca.top_errors(cases.withColumn("abs_error", F.round("abs_error", 9)), 50, "l_orderkey")
    return rounded(top.select("rank", "l_orderkey", "abs_error", "error", "abs_count_error"))


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.floor("l_quantity").cast("int").alias("gold"), F.floor(F.col("l_quantity") * (1 - F.col("l_discount"))).cast("int").alias("estimate"))


def label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ca.label_quality(_counted(spark, sf_dir)))


def difference_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.difference_buckets(_counted(spark, sf_dir))


def split_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.stratified_split(table(spark, sf_dir, "part"), "p_brand", "p_partkey", 0.1).select("p_partkey", "p_brand", "part")


def sample_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: exactly 200 orders."""
    return sp.sample_exactly(table(spark, sf_dir, "orders"), 200, "o_orderkey").select("o_orderkey", "o_totalprice")


def _allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("w"))
    return sp.apportioned(sizes, "p_brand", "w", 150)


def apportion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _allocation(spark, sf_dir).select("p_brand", "w", "allocated")


def sample_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.sample_by_stratum(table(spark, sf_dir, "part"), _allocation(spark, sf_dir).select("p_brand", "allocated"), "p_brand", "p_partkey").select("p_partkey", "p_brand")


def comparison_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return sp.comparison_group(orders, "o_totalprice", "o_orderkey", 100, orders.where("o_orderkey % 5 = 0")).select("o_orderkey")


def _greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return sp.greedy_split(groups, "o_custkey", "n", {"train": 8, "dev": 1, "test": 1})


def split_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _greedy(spark, sf_dir)


def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a hash split of customers, by their orders."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    cut = F.conv(F.substring(sp.hash_order(42, "o_custkey"), 1, 4), 16, 10).cast("int")
    split = customers.withColumn("split", F.when(cut < 52429, "train").when(cut < 58982, "dev").otherwise("test"))
    out = sp.split_summary(table(spark, sf_dir, "orders"), split, "o_custkey", "o_totalprice")
    return out.withColumn("total", F.round("total", 2))


def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that occur under several return flags."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_returnflag").alias("split"))
    return sp.overlaps(rows, "l_suppkey")


def fixed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.fixed_groups(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", 4).select("o_custkey", "o_orderkey", "part", "place")


def concat_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.concat_groups(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


def epoch_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many groups as an epoch asks for: a sampling operator."""
    return sp.epoch_concat_groups(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", count=500, epoch=1)


def length_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.length_batches(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 32, 8)


def drawn_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "customer").select("c_custkey")
    return sp.drawn_from(wanted, table(spark, sf_dir, "part").select("p_retailprice").distinct(), "c_custkey", "p_retailprice")


def evenly_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.evenly_spaced(table(spark, sf_dir, "customer"), 60, ["c_custkey"]).select("c_custkey")


def rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounds = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("round"))
    return sp.rotated_order(["a", "b", "c", "d"], rounds)


QUERIES = {
    "q_catalog_reasons": catalog_reasons,
    "q_reason_counts": reason_counts,
    "q_built_catalog": built_catalog,
    "q_selection_reasons": selection_reasons,
    "q_selection_report": selection_report,
    "q_overlapping_reasons": overlapping_reasons,
    "q_reason_combinations": reason_combinations,
    "q_reason_pivot": reason_pivot,
    "q_three_way": three_way,
    "q_group_agg": group_agg,
    "q_rate_distribution": rate_distribution,
    "q_rate_hist": rate_hist,
    "q_select_items": select_items,
    "q_missing_both": missing_both,
    "q_union_intersect": union_intersect,
    "q_top_errors": top_errors,
    "q_label_quality": label_quality,
    "q_difference_buckets": difference_buckets,
    "q_split_stratified": split_stratified,
    "q_sample_k": sample_k,
    "q_apportion": apportion,
    "q_sample_strata": sample_strata,
    "q_comparison_group": comparison_group,
    "q_split_greedy": split_greedy,
    "q_split_summary": split_summary,
    "q_overlaps": overlaps,
    "q_fixed_groups": fixed_groups,
    "q_concat_groups": concat_groups,
    "q_epoch_groups": epoch_groups,
    "q_length_batches": length_batches,
    "q_drawn_from": drawn_from,
    "q_evenly_spaced": evenly_spaced,
    "q_rotation": rotation,
}

_DOCS = """docs AS (SELECT d.doc_id, d.source, d.lang, l.quality AS up, l.toxic AS down, trim(d.text) AS sentence, length(regexp_replace(d.text, '[^aeiou]', '', 'g'))::INT AS units,
  CASE WHEN l.doc_id IS NOT NULL THEN d.n_chars / 4.0::DOUBLE END AS duration FROM documents d LEFT JOIN labels l USING (doc_id))"""
_REASON = f"""CASE WHEN up IS NOT NULL AND down >= up THEN 'down_votes' WHEN sentence = '' THEN 'empty_sentence' WHEN regexp_matches(sentence, '[0-9][0-9][0-9]') THEN 'long_digit_run'
  WHEN duration IS NULL OR duration <= 0 THEN 'missing_duration' WHEN units / duration < {LOW} OR units / duration > 1.0 THEN 'outlier' END"""
_SELECTED = f"""{_DOCS}, sel AS (SELECT doc_id, up IS NULL AS pending, length(sentence) / 500.0::DOUBLE AS rate, CASE WHEN up IS NULL THEN []::VARCHAR[] ELSE list_filter([
  CASE WHEN up = 0 THEN 'align_failed' END, CASE WHEN units % 7 = 0 THEN 'mora_mismatch' END, CASE WHEN starts_with(sentence, 'Th') THEN 'head_isolated' END,
  CASE WHEN ends_with(sentence, '.') THEN 'tail_isolated' END, CASE WHEN down = 1 THEN 'no_speech' END], lambda x: x IS NOT NULL) END AS reasons FROM docs)"""
_H = lambda *k: "sha256('42:' || " + " || ':' || ".join(f"{x}::VARCHAR" for x in k) + ")"
_ALLOC = """sizes AS (SELECT p_brand, count(*) AS w FROM part GROUP BY 1), ex AS (SELECT *, 150 * w / sum(w) OVER () AS x FROM sizes),
alloc AS (SELECT p_brand, w, (floor(x) + (row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, p_brand) <= 150 - sum(floor(x)) OVER ())::INT)::BIGINT AS allocated FROM ex)"""

_DRAW = "('0x' || substr(sha256('42.0:{0}:' || o_custkey || ':' || o_orderkey), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"

ORACLES = {
    "q_concat_groups": f"""WITH RECURSIVE k AS (SELECT o_custkey, o_orderkey, sha256('42.0:' || o_custkey || ':' || o_orderkey) AS h, {_DRAW.format("size")} AS u, {_DRAW.format("gap")} AS v FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY h, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM k),
r AS (SELECT o_custkey, n, 0::BIGINT AS part, 0::BIGINT AS first, least(3 + floor(u * 3)::BIGINT, n) AS take FROM n WHERE i = 0 AND n >= 3 UNION ALL
  SELECT o_custkey, r.n, part + 1, first + take, least(3 + floor(u * 3)::BIGINT, r.n - first - take) FROM r JOIN n USING (o_custkey) WHERE i = first + take AND r.n - first - take >= 3)
SELECT o_custkey, o_orderkey, part::INT AS part, (i - first)::INT AS place, (CASE WHEN i = first + take - 1 THEN 0 ELSE (1 + floor(v * 10)) * 1600 END)::BIGINT AS gap FROM n JOIN r USING (o_custkey) WHERE i >= first AND i < first + take""",
    "q_catalog_reasons": f"WITH {_DOCS} SELECT doc_id, units, duration, {_REASON} AS reason FROM docs",
    "q_reason_counts": f"WITH {_DOCS} SELECT coalesce({_REASON}, 'kept') AS reason, count(*) AS n FROM docs GROUP BY 1",
    "q_built_catalog": """WITH t AS (SELECT p_partkey AS k, p_size, trim(CASE WHEN p_partkey % 17 = 0 THEN '  ' WHEN p_partkey % 11 = 0 THEN p_name || ' ' || (2000 + p_partkey % 7) ELSE ' ' || p_name END) AS sentence,
  p_size % 4 + 1 AS up, CASE WHEN p_partkey % 23 <> 0 THEN p_partkey % 4 END AS down, CASE WHEN p_partkey % 13 <> 0 THEN CASE WHEN p_partkey % 19 = 0 THEN 0.0::DOUBLE ELSE p_size / 10.0::DOUBLE END END AS duration FROM part),
u AS (SELECT *, length(regexp_replace(sentence, '[^aiueo]', '', 'g')) AS units, CASE WHEN duration <> 0 THEN length(regexp_replace(sentence, '[^aiueo]', '', 'g')) / duration END AS rate FROM t)
SELECT 'part.' || k AS item_id, sentence, CASE WHEN down IS NULL OR down >= up THEN 'down_votes' WHEN sentence = '' THEN 'empty_sentence' WHEN regexp_matches(sentence, '[bAIUEO]') THEN 'unconverted'
  WHEN regexp_matches(sentence, '[0-9]{3}') THEN 'long_digit_run' WHEN duration IS NULL OR duration <= 0 THEN 'missing_duration' WHEN rate < 1 OR rate > 12 THEN 'outlier' END AS reason,
  units, round(duration, 6) AS duration, round(rate, 6) AS rate FROM u""",
    "q_selection_reasons": f"WITH {_SELECTED} SELECT doc_id, pending, array_to_string(reasons, '+') AS reasons, reasons[1] AS primary_reason FROM sel",
    "q_selection_report": f"""WITH {_SELECTED} SELECT CASE WHEN pending THEN 'pending' WHEN len(reasons) > 0 THEN 'excluded' ELSE 'usable' END AS status, CASE WHEN NOT pending THEN reasons[1] END AS reason,
  {BAND_SQL.format("rate")} AS band, count(*) AS n FROM sel GROUP BY ALL""",
    "q_overlapping_reasons": f"WITH {_SELECTED} SELECT reason, count(*) AS n, count(*) FILTER (len(reasons) = 1) AS alone FROM (SELECT reasons, unnest(reasons) AS reason FROM sel) GROUP BY 1",
    "q_reason_combinations": f"WITH {_SELECTED} SELECT array_to_string(reasons, '+') AS combination, count(*) AS n FROM sel WHERE len(reasons) > 0 GROUP BY 1",
    "q_reason_pivot": f"""WITH {_SELECTED}, b AS (SELECT reasons[1] AS reason, {BAND_SQL.format("rate")} AS band FROM sel WHERE len(reasons) > 0)
SELECT reason, {", ".join(f"count(*) FILTER (band = '{k}') AS n_{k}" for k in BAND_KEYS)}, count(*) AS total FROM b GROUP BY 1""",
    "q_three_way": """SELECT d.source, l.doc_id IS NULL OR b.item_id IS NULL AS pending, count(*) AS n, count(l.quality) AS n_quality
FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN benchmark b ON b.item_id = d.doc_id GROUP BY 1, 2""",
    "q_group_agg": "SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS total FROM documents GROUP BY 1",
    "q_rate_distribution": """SELECT lang, count(*) AS n, round(min(r), 6) AS min, round(quantile_cont(r, 0.25), 6) AS q1, round(median(r), 6) AS median, round(quantile_cont(r, 0.75), 6) AS q3,
  round(max(r), 6) AS max, round(avg(r), 6) AS mean, round(sum(r), 6) AS total FROM (SELECT lang, n_chars / 400.0::DOUBLE AS r FROM documents) GROUP BY 1""",
    "q_rate_hist": """WITH c AS (SELECT least(greatest(floor((n_chars / 400.0::DOUBLE - 1) / 0.5), 0), 21)::INT AS bin, count(*) AS n FROM documents WHERE n_chars IS NOT NULL GROUP BY 1)
SELECT b::INT AS bin, 1.0::DOUBLE + b * 0.5::DOUBLE AS low, 1.0::DOUBLE + (b + 1) * 0.5::DOUBLE AS high, coalesce(n, 0) AS n FROM range(22) t(b) LEFT JOIN c ON c.bin = b""",
    "q_select_items": """SELECT doc_id, source, n_chars FROM documents WHERE source IN (SELECT source FROM documents GROUP BY 1 HAVING sum(n_chars) % 2 = 0) AND n_chars BETWEEN 100 AND 8000
  AND doc_id IN (SELECT doc_id FROM labels) ORDER BY source, doc_id LIMIT 100""",
    "q_missing_both": """SELECT 'only_left' AS side, id FROM (SELECT page_id AS id FROM pages EXCEPT ALL SELECT doc_id FROM labels)
UNION ALL SELECT 'only_right', id FROM (SELECT doc_id AS id FROM labels EXCEPT ALL SELECT page_id FROM pages)""",
    "q_union_intersect": """WITH b AS (SELECT page_id AS id FROM pages INTERSECT SELECT doc_id FROM labels), a AS (SELECT page_id AS id FROM pages UNION SELECT doc_id FROM labels)
SELECT 'both' AS kind, count(*) AS n, sum(id)::BIGINT AS total FROM b HAVING count(*) > 0 UNION ALL SELECT 'any', count(*), sum(id)::BIGINT FROM a""",
    "q_top_errors": f"""WITH {JUDGED_SQL}, o AS (SELECT l_orderkey, sum(truth) AS t, sum(pred) AS p, count(*) AS d FROM judged GROUP BY 1),
e AS (SELECT l_orderkey, round(abs(p / d - t / d), 9) AS abs_error, p / d - t / d AS error, abs(p - t) AS abs_count_error FROM o)
SELECT row_number() OVER (ORDER BY abs_error DESC, l_orderkey)::INT AS rank, l_orderkey, round(abs_error, 6) AS abs_error, round(error, 6) AS error, round(abs_count_error, 6) AS abs_count_error
FROM e ORDER BY e.abs_error DESC, l_orderkey LIMIT 50""",
    "q_label_quality": """WITH c AS (SELECT floor(l_quantity) AS g, floor(l_quantity * (1 - l_discount)) AS e FROM lineitem)
SELECT count(*) AS n, round(avg((g = e)::INT), 6) AS exact, round(avg(abs(e - g)), 6) AS mean_abs, round(avg(abs(e - g) / g), 6) AS mean_relative FROM c""",
    "q_difference_buckets": """SELECT CASE WHEN abs(floor(l_quantity * (1 - l_discount)) - floor(l_quantity)) <= 3 THEN abs(floor(l_quantity * (1 - l_discount)) - floor(l_quantity))::INT::VARCHAR ELSE '4+' END AS bucket,
  count(*) AS n FROM lineitem GROUP BY 1""",
    "q_split_stratified": f"""SELECT p_partkey, p_brand, CASE WHEN row_number() OVER (PARTITION BY p_brand ORDER BY {_H("p_brand", "p_partkey")}, p_partkey) <= round_even(count(*) OVER (PARTITION BY p_brand) * 0.1::DOUBLE, 0)
  THEN 'eval' ELSE 'train' END AS part FROM part""",
    "q_sample_k": f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {_H('o_orderkey')}, o_orderkey LIMIT 200",
    "q_apportion": f"WITH {_ALLOC} SELECT p_brand, w, allocated FROM alloc",
    "q_sample_strata": f"""WITH {_ALLOC} SELECT p_partkey, p_brand FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY {_H("p_partkey")}, p_partkey) AS k FROM part) JOIN alloc USING (p_brand) WHERE k <= allocated""",
    "q_comparison_group": f"SELECT o_orderkey FROM orders WHERE o_totalprice <= (SELECT median(o_totalprice) FROM orders) AND o_orderkey % 5 != 0 ORDER BY {_H('o_orderkey')}, o_orderkey LIMIT 100",
    "q_split_greedy": f"""WITH RECURSIVE g AS (SELECT o_custkey, n, row_number() OVER (ORDER BY n DESC, {_H("o_custkey")}) AS k, sum(n) OVER () AS t FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)),
f AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS o_custkey, NULL::VARCHAR AS split, any_value(t) * 0.8::DOUBLE AS a, any_value(t) * 0.1::DOUBLE AS b, any_value(t) * 0.1::DOUBLE AS c FROM g
  UNION ALL SELECT g.k, g.o_custkey, CASE WHEN f.a >= f.b AND f.a >= f.c THEN 'train' WHEN f.b >= f.c THEN 'dev' ELSE 'test' END,
    f.a - CASE WHEN f.a >= f.b AND f.a >= f.c THEN n ELSE 0 END, f.b - CASE WHEN NOT (f.a >= f.b AND f.a >= f.c) AND f.b >= f.c THEN n ELSE 0 END, f.c - CASE WHEN NOT (f.a >= f.b AND f.a >= f.c) AND NOT f.b >= f.c THEN n ELSE 0 END
  FROM f JOIN g ON g.k = f.k + 1)
SELECT o_custkey, split FROM f WHERE k > 0""",
    "q_split_summary": f"""WITH s AS (SELECT c_custkey AS o_custkey, ('0x' || substr({_H("c_custkey")}, 1, 4))::INT AS x FROM customer)
SELECT CASE WHEN x < 52429 THEN 'train' WHEN x < 58982 THEN 'dev' ELSE 'test' END AS split, count(DISTINCT o_custkey) AS groups, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders JOIN s USING (o_custkey) GROUP BY 1""",
    "q_overlaps": """WITH p AS (SELECT DISTINCT l_suppkey, l_returnflag AS s FROM lineitem) SELECT a.l_suppkey, a.s AS one, b.s AS two FROM p a JOIN p b ON a.l_suppkey = b.l_suppkey AND a.s < b.s""",
    "q_fixed_groups": f"""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY {_H("o_orderkey")}, o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, o_orderkey, (k // 4)::INT AS part, (k % 4)::INT AS place FROM r WHERE k < n // 4 * 4""",
    "q_length_batches": """WITH p AS (SELECT doc_id, n_chars, ((row_number() OVER (ORDER BY sha256('42:0:' || doc_id), doc_id) - 1) // 256)::INT AS pool FROM documents),
i AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY n_chars, doc_id) - 1 AS k FROM p), c AS (SELECT *, (k // 32)::INT AS cut FROM i),
b AS (SELECT pool, cut, (row_number() OVER (ORDER BY sha256('43:0:' || pool || ':' || cut)) - 1)::INT AS batch FROM (SELECT DISTINCT pool, cut FROM c))
SELECT doc_id, n_chars, (k % 32)::INT AS place, batch FROM c JOIN b USING (pool, cut)""",
    "q_drawn_from": """WITH v AS (SELECT p_retailprice, row_number() OVER (ORDER BY p_retailprice) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT p_retailprice FROM part)),
w AS (SELECT c_custkey, ('0x' || substr(sha256('42:' || c_custkey), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM customer)
SELECT c_custkey, p_retailprice FROM w JOIN v ON v.k = floor(u * v.n)::BIGINT + 1""",
    "q_evenly_spaced": """WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS k, greatest(count(*) OVER () // 60, 1) AS s FROM customer) SELECT c_custkey FROM c WHERE k % s = 0 AND k < s * 60""",
    "q_rotation": "SELECT n_nationkey AS round, p::INT AS place, ['a', 'b', 'c', 'd'][(p + n_nationkey) % 4 + 1] AS name FROM nation, range(4) t(p)",
}
