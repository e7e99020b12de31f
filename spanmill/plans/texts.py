"""Text, label sequences and scalar functions. documents have no kana, so readings are built from their letters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.functions import numeric as nu
from spanmill.functions import text as tx
from spanmill.operators import sequences as se
from spanmill.plans.inputs import EVENTS_SQL, r6, rounded, table, timed_events

#: Letters that stand for kana: five full ones, two small ones, the long mark, the nasal, the geminate.
LETTERS, READING = "aeioutsnhrd", "アエイオウャョーンッー"
SPELLING = dict(zip(LETTERS, READING, strict=True))


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "text", F.translate(F.regexp_replace("text", f"[^{LETTERS}]", ""), LETTERS, READING).alias("kana"))


def unit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("kana")
    return _readings(spark, sf_dir).select("doc_id", tx.unit_count(k).alias("units"), F.size(tx.units(k)).alias("split"), tx.has_other(F.concat(k, F.lit("x"))).alias("other"), tx.to_hiragana(k).alias("hiragana"))


def unit_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _readings(spark, sf_dir).select(F.explode(tx.units(F.col("kana"))).alias("unit")).groupBy("unit").agg(F.count(F.lit(1)).alias("n"))


def unit_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.special_counts(F.col("text"), SPELLING).alias("c")).select("doc_id", "c.*")


def special_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of special units, its tenth, and their number; without a text no share, and the lowest tenth."""
    rows = table(spark, sf_dir, "documents").select("doc_id", tx.special_counts(F.col("text"), SPELLING).alias("c"))
    special, units = F.col("c.special"), F.col("c.units")
    share = F.when(units.isNotNull(), nu.part_of(special, units))
    return rows.select("doc_id", r6(share).alias("share"), nu.tenth_bin(F.round(share, 9)).alias("tenth"), special.cast("int").alias("flagged"))


def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(tx.one_line(F.col("text"))).alias("line"), F.md5(tx.reading_only(F.col("text"))).alias("reading"), tx.digit_run(F.col("text")).alias("digits"))


def nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL has no function for: compatibility composition, annotations, byte chunks, edits."""
    docs = table(spark, sf_dir, "documents")
    t = F.col("text")
    return docs.select("doc_id", F.md5(tx.nfkc(t)).alias("nfkc"), tx.annotation(F.col("source")).alias("annotation"), F.size(tx.byte_chunks(t, 512)).alias("chunks"), F.size(tx.edits(t, F.translate(t, "aei", "xyz"))).alias("edits"))


def cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark text against the next one by id."""
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    pairs = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("hyp")), "item_id")
    return pairs.select("item_id", F.levenshtein("text", "hyp").alias("distance"), r6(tx.error_rate(F.col("text"), F.col("hyp"))).alias("cer"))


def token_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", F.split("text", " ").alias("a"))
    pairs = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b")), "item_id")
    return pairs.select("item_id", tx.token_distance(F.col("a"), F.col("b")).alias("distance"))


def word_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of the readings of a text's words: words with any, units, the longest word."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("words"))
    kana = F.transform("words", lambda w: F.translate(F.regexp_replace(w, f"[^{LETTERS}]", ""), LETTERS, READING))
    n = words.select("doc_id", tx.word_lengths(kana).alias("n"))
    return n.select("doc_id", F.size("n").alias("words"), F.aggregate("n", F.lit(0).cast("long"), lambda a, v: a + v).alias("units"), F.coalesce(F.array_max("n"), F.lit(0)).cast("long").alias("longest"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    url = F.regexp_replace("url", "[?#].*$", "")
    return pages.select("page_id", tx.stem(url).alias("stem"), tx.safe_head(F.col("url"), 10).alias("head"), tx.condition_name((F.col("page_id") % 5) / 2).alias("condition"), tx.noisy_name(F.lit("dev"), F.col("page_id") % 3 * 5.0).alias("noisy"))


def scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates, bands, bins, rounding and formats of orders. Bytes are in MiB at most, however many."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 31415.926535).alias("x"))
    x = F.col("x")
    return o.select(
        "o_orderkey",
        nu.band(x).alias("band"),
        nu.bin_key(x).alias("bin"),
        nu.bin_code(x).cast("int").alias("code"),
        nu.digitized(x, (2.0, 4.5, 9.0)).alias("digit"),
        nu.stretched_length(F.col("o_orderkey"), F.lit(2.0)).alias("stretched"),
        r6(nu.decibels(x)).alias("db"),
        nu.frame_count(F.col("o_orderkey")).alias("frames"),
        r6(nu.outward(x, 0.25, ">=")).alias("down"),
        r6(nu.stretch_cdf(x, 1.0, 9.0, "log")).alias("cdf"),
        r6(nu.rate_or_zero(x, F.col("o_orderkey") % 3)).alias("rate"),
        nu.clock(F.col("o_orderkey")).alias("clock"),
        nu.human_bytes(F.col("o_orderkey") * 1000 + 7, "MiB").alias("bytes"),
    )


def hash_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed draws: a 64-bit key, a uniform, and a log-uniform stretch."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    u = nu.hash_uniform(F.lit("7"), F.col("c_name"))
    return c.select("c_custkey", nu.key_number(F.col("c_name")).cast("string").alias("key"), F.round(u, 9).alias("u"), F.round(nu.drawn_between(u, 0.5, 2.0, "log"), 9).alias("stretch"))


def ctc_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.collapse(timed_events(spark, sf_dir), ["source_id"], ["at", "event_id"], "event_type", "view").select("source_id", "event_id", "event_type")


def ctc_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on one array a user."""
    rows = timed_events(spark, sf_dir).groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("at", "event_id", "event_type"))).alias("e"))
    kept = rows.withColumn("labels", F.col("e.event_type")).withColumn("kept", tx.collapsed(F.col("labels"), "view"))
    return kept.select("source_id", F.size("kept").alias("n"), F.md5(F.array_join("kept", ",")).alias("text"))


def token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.label_spans(timed_events(spark, sf_dir), ["source_id"], ["at", "event_id"], "event_type", "view").select("source_id", "event_type", "start", "end")


def frames_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.frames_needed(timed_events(spark, sf_dir), ["source_id"], ["at", "event_id"], "event_type")


def end_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(se.end_intervals(timed_events(spark, sf_dir), ["source_id"], ["at", "event_id"], "at"))


def best_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals of a customer as a metric by time: improvements and patience."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    out = se.best_so_far(rows, ["o_custkey"], ["o_orderkey"], "o_totalprice", "min", 100.0, 3)
    return out.select("o_custkey", "o_orderkey", "best_before", "improved", "stale", "stop")


QUERIES = {
    "q_unit_counts": unit_counts,
    "q_unit_split": unit_split,
    "q_unit_classes": unit_classes,
    "q_special_shares": special_shares,
    "q_text_normalise": normalised,
    "q_nfkc": nfkc,
    "q_cer": cer,
    "q_token_distance": token_distance,
    "q_word_lengths": word_lengths,
    "q_names": names,
    "q_scalars": scalars,
    "q_hash_draws": hash_draws,
    "q_ctc_collapse": ctc_collapse,
    "q_ctc_arrays": ctc_arrays,
    "q_token_spans": token_spans,
    "q_frames_needed": frames_needed,
    "q_end_intervals": end_intervals,
    "q_best_so_far": best_so_far,
}

_KANA = f"rd AS (SELECT doc_id, translate(regexp_replace(text, '[^{LETTERS}]', '', 'g'), '{LETTERS}', '{READING}') AS kana FROM documents)"
_UNITS = f"{_KANA}, un AS (SELECT doc_id, kana, regexp_extract_all(kana, '[アエイオウーンッ][ャョ]?|[ャョ]') AS u FROM rd)"
_SPECIAL = "len(list_filter(u, lambda x: x IN ('ー', 'ン', 'ッ')))"
_W = 'WINDOW w AS (PARTITION BY source_id ORDER BY "at", event_id)'

ORACLES = {
    "q_unit_counts": f"WITH {_UNITS} SELECT doc_id, len(u)::INT AS units, len(u)::INT AS split, true AS other, translate(kana, 'アエイオウャョンッ', 'あえいおうゃょんっ') AS hiragana FROM un",
    "q_unit_split": f"WITH {_UNITS} SELECT unit, count(*) AS n FROM (SELECT unnest(u) AS unit FROM un) GROUP BY 1",
    "q_unit_classes": f"""WITH {_UNITS} SELECT doc_id, len(list_filter(u, lambda x: x = 'ー')) AS long, len(list_filter(u, lambda x: x = 'ン')) AS nasal, len(list_filter(u, lambda x: x = 'ッ')) AS geminate,
  {_SPECIAL} AS special, len(list_filter(u, lambda x: length(x) = 2)) AS contracted, len(u) AS units FROM un""",
    "q_special_shares": f"""WITH {_UNITS}, s AS (SELECT doc_id, CASE WHEN len(u) < 1 THEN 0 ELSE {_SPECIAL}::DOUBLE / len(u) END AS share, {_SPECIAL}::INT AS flagged FROM un)
SELECT doc_id, round(share, 6) AS share, least(greatest(floor(round(share, 9) * 10), 0), 9)::INT AS tenth, flagged FROM s""",
    "q_text_normalise": r"""SELECT doc_id, md5(trim(regexp_replace(text, '[\s\x0B]+', ' ', 'g'))) AS line, md5(regexp_replace(text, '[\p{P}\p{Z}\p{C}]', '', 'g')) AS reading, regexp_matches(text, '[0-9][0-9][0-9]') AS digits FROM documents""",
    # DuckDB measures bytes: the table's characters beyond ASCII get control characters of their own, which keeps distances.
    "q_cer": """WITH c AS (SELECT c, row_number() OVER (ORDER BY c) AS k FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[^\\x00-\\x7F]')) AS c FROM benchmark)),
m AS (SELECT coalesce(string_agg(c, '' ORDER BY k), '') AS a, coalesce(string_agg(chr((CASE WHEN k < 9 THEN k ELSE k + 5 END)::INT), '' ORDER BY k), '') AS b FROM c),
t AS (SELECT item_id, translate(text, a, b) AS text FROM benchmark, m) SELECT a.item_id, levenshtein(a.text, b.text)::INT AS distance, round(CASE WHEN a.text = '' THEN (b.text != '')::INT ELSE levenshtein(a.text, b.text) / length(a.text) END, 6) AS cer
FROM t a JOIN t b ON b.item_id = a.item_id + 1""",
    "q_token_distance": """WITH RECURSIVE t AS (SELECT item_id, string_split(text, ' ') AS x FROM benchmark), p AS (SELECT a.item_id, a.x AS a, b.x AS b FROM t a JOIN t b ON b.item_id = a.item_id + 1),
r AS (SELECT item_id, a, b, 0::BIGINT AS i, range(0, len(b) + 1) AS d FROM p UNION ALL
  SELECT item_id, a, b, i + 1, list_transform(range(1, len(b) + 2), lambda j: list_min(list_transform(range(1, j + 1), lambda k: e[k] + j - k)))
  FROM (SELECT *, list_concat([i + 1], list_transform(range(1, len(b) + 1), lambda j: least(d[j + 1] + 1, d[j] + (a[i + 1] != b[j])::BIGINT))) AS e FROM r WHERE i < len(a)))
SELECT item_id, d[len(b) + 1]::INT AS distance FROM r WHERE i = len(a)""",
    "q_word_lengths": f"""WITH w AS (SELECT doc_id, list_filter(list_transform(string_split(text, ' '), lambda v: len(regexp_extract_all(translate(regexp_replace(v, '[^{LETTERS}]', '', 'g'), '{LETTERS}', '{READING}'), '[アエイオウーンッ][ャョ]?|[ャョ]'))), lambda n: n > 0) AS n FROM documents)
SELECT doc_id, len(n)::INT AS words, coalesce(list_sum(n), 0)::BIGINT AS units, coalesce(list_max(n), 0)::BIGINT AS longest FROM w""",
    "q_names": r"""SELECT page_id, regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/]*$'), '(.)\.[^.]*$', '\1') AS stem, left(regexp_replace(url, '[^\p{L}\p{N}_-]', '', 'g'), 10) AS head,
  'x' || regexp_replace(((page_id % 5) / 2)::VARCHAR, '\.0$', '') AS condition, 'dev_snr' || (page_id % 3 * 5)::VARCHAR || 'db' AS noisy FROM pages""",
    "q_scalars": """WITH o AS (SELECT o_orderkey, o_totalprice / 31415.926535::DOUBLE AS x FROM orders)
SELECT o_orderkey, CASE WHEN x < 4 THEN 'under4' WHEN x < 6 THEN '4to6' WHEN x < 8 THEN '6to8' ELSE 'over8' END AS band,
  CASE WHEN x < 6 THEN 'lt6' WHEN x >= 14 THEN 'ge14' ELSE floor(x)::INT || 'to' || (floor(x)::INT + 1) END AS bin, CASE WHEN x < 6 THEN 0 WHEN x >= 14 THEN 9 ELSE floor(x)::INT - 5 END AS code,
  (x >= 2)::INT + (x >= 4.5)::INT + (x >= 9)::INT AS digit, round_even(o_orderkey / 2.0::DOUBLE, 0)::BIGINT AS stretched, round(10 * log10(x + 1e-10), 6) AS db, 1 + o_orderkey // 160 AS frames,
  round(floor(x / 0.25::DOUBLE + 1e-9) * 0.25, 6) AS down, round(CASE WHEN x <= 1 THEN 0 WHEN x >= 9 THEN 1 ELSE ln(x) / ln(9.0) END, 6) AS cdf, round(CASE WHEN o_orderkey % 3 <= 0 THEN 0 ELSE x / (o_orderkey % 3) END, 6) AS rate,
  printf('%d:%02d:%02d', o_orderkey // 3600, o_orderkey % 3600 // 60, o_orderkey % 60) AS clock,
  CASE WHEN (o_orderkey * 1000 + 7) < 1024 THEN printf('%d B', (o_orderkey * 1000 + 7)) WHEN (o_orderkey * 1000 + 7) < 1048576 THEN printf('%.1f KiB', (o_orderkey * 1000 + 7) / 1024.0::DOUBLE) ELSE printf('%.1f MiB', (o_orderkey * 1000 + 7) / 1048576.0::DOUBLE) END AS bytes FROM o""",
    "q_hash_draws": """WITH c AS (SELECT c_custkey, c_name, ('0x' || substr(sha256('7:' || c_name), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM customer)
SELECT c_custkey, ('0x' || substr(sha256(c_name), 1, 16))::UBIGINT::VARCHAR AS key, round(u, 9) AS u, round(exp(ln(0.5) + u * ln(4.0)), 9) AS stretch FROM c""",
    "q_ctc_collapse": f"""WITH {EVENTS_SQL}, b AS (SELECT *, lag(event_type) OVER w AS p FROM ev {_W}) SELECT source_id, event_id, event_type FROM b WHERE event_type != 'view' AND (p IS NULL OR p != event_type)""",
    "q_ctc_arrays": f"""WITH {EVENTS_SQL}, b AS (SELECT *, lag(event_type) OVER w AS p FROM ev {_W}), k AS (SELECT source_id, event_type, "at", event_id, event_type != 'view' AND (p IS NULL OR p != event_type) AS kept FROM b)
SELECT source_id, (count(*) FILTER (kept))::INT AS n, md5(coalesce(string_agg(event_type, ',' ORDER BY "at", event_id) FILTER (kept), '')) AS text FROM k GROUP BY 1""",
    "q_token_spans": f"""WITH {EVENTS_SQL}, b AS (SELECT *, row_number() OVER w - 1 AS k, coalesce((event_type != lag(event_type) OVER w)::INT, 1) AS new FROM ev {_W}),
g AS (SELECT *, sum(new) OVER (PARTITION BY source_id ORDER BY k) AS i FROM b) SELECT source_id, event_type, min(k)::INT AS start, (max(k) + 1)::INT AS "end" FROM g WHERE event_type != 'view' GROUP BY source_id, i, event_type""",
    "q_frames_needed": f"WITH {EVENTS_SQL}, b AS (SELECT source_id, (event_type = lag(event_type) OVER w)::INT AS s FROM ev {_W}) SELECT source_id, (count(*) + coalesce(sum(s), 0))::BIGINT AS frames FROM b GROUP BY 1",
    "q_end_intervals": f"""WITH {EVENTS_SQL}, b AS (SELECT source_id, "at", event_id, lead("at") OVER w - "at" AS g FROM ev {_W})
SELECT source_id, round(arg_min(g, "at"), 6) AS first, round(arg_max(g, "at"), 6) AS "last", round(max(g), 6) AS longest, count(*) AS n FROM b WHERE g IS NOT NULL GROUP BY 1""",
    "q_best_so_far": """WITH b AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, min(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM orders),
i AS (SELECT *, coalesce(o_totalprice < best_before - 100, true) AS improved FROM b), s AS (SELECT *, (k - max(k) FILTER (improved) OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::INT AS stale FROM i)
SELECT o_custkey, o_orderkey, best_before, improved, stale, stale >= 3 AS stop FROM s""",
}
