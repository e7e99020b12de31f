"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.llm import attribution, exact, language, media, mixing, neardup, packing, repeats, sharding, urls
from spanmill.workers import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.section_tokens(_table(spark, sf_dir, "documents"), rule="first")


def op2_bloom_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(spark, _table(spark, sf_dir, "documents"))


def op3_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.byte_shards(spark, _table(spark, sf_dir, "documents"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table labels pages (labels rates documents), so the pages that a rule fits are the labelled ones."""
    return urls.judge_urls(spark, _table(spark, sf_dir, "pages"))


def op5_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.poisson_mix(spark, _table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "mix_copy", "mix_key", F.round("mix_mean", 9).alias("mix_mean"))


def op6_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.length_buckets(spark, _table(spark, sf_dir, "documents"))


def op7_minmax_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(spark, _table(spark, sf_dir, "documents"))


def op8_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(spark, _table(spark, sf_dir, "documents"), digest=True)


def op9_exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(spark, _table(spark, sf_dir, "documents"))


def op10_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(media.encode_media(_table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_section_tokens": op1_section_tokens,
    "op2_bloom_language": op2_bloom_language,
    "op3_byte_shards": op3_byte_shards,
    "op4_path_templates": op4_path_templates,
    "op5_poisson_mix": op5_poisson_mix,
    "op6_length_buckets": op6_length_buckets,
    "op7_minmax_groups": op7_minmax_groups,
    "op8_super_kmers": op8_super_kmers,
    "op9_exact_groups": op9_exact_groups,
    "op10_png_media": op10_png_media,
}

#: A CRC-32 of UTF-8 bytes in SQL: the table from its rule (polynomial 0xEDB88320), then one step a byte.
_CRC = """
crc_table AS (
  SELECT list(v ORDER BY b) AS t FROM (
    SELECT b, list_reduce([b] || range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
    FROM (SELECT unnest(range(256)) AS b))
)"""

#: Words of a text as a list; the classes are the contract's.
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


#: Levels of the tree in SQL, which has no loop over them: as many as the paths of the small tables have, and more.
_SQL_DEPTH = 6


def _templates_sql() -> str:
    """The path-template tree level by level: generalising downwards, merging siblings upwards."""
    out, depth = [], _SQL_DEPTH
    for d in range(1, depth + 1):
        out.append(f"""
kid{d} AS (SELECT host, leaf[1 : {d - 1}] AS pre, leaf[{d}] AS at_, sum(n) AS n FROM base{d - 1} WHERE len(leaf) >= {d} GROUP BY ALL),
to{d} AS (SELECT host, pre, at_, CASE WHEN count(*) OVER w <= {urls.FEW_BRANCHES} OR n >= {urls.LEAST_SHARE}::DOUBLE * sum(n) OVER w THEN at_ ELSE '*' END AS to_ FROM kid{d} WINDOW w AS (PARTITION BY host, pre)),
base{d} AS (SELECT b.* EXCLUDE (leaf), CASE WHEN t.to_ IS NULL THEN leaf ELSE leaf[1 : {d - 1}] || [t.to_] || leaf[{d + 1} :] END AS leaf
  FROM base{d - 1} b LEFT JOIN to{d} t ON t.host = b.host AND len(leaf) >= {d} AND t.pre = leaf[1 : {d - 1}] AND t.at_ = leaf[{d}])""")
    out.append(f"merge{depth} AS (SELECT host, leaf, leaf AS template, sum(good) AS good, sum(bad) AS bad FROM base{depth} GROUP BY 1, 2)")
    for d in range(depth, 0, -1):
        out.append(f"""
own{d} AS (SELECT host, template, template[{d}] AS at_, template[1 : {d - 1}] AS pre, template[{d + 1} :] AS post, sum(good) + sum(bad) + 2 AS k, (sum(good) + 1)::DOUBLE / (sum(good) + sum(bad) + 2) AS p
  FROM merge{d} WHERE len(template) >= {d} GROUP BY host, template),
lag{d} AS (SELECT *, lag(p) OVER w AS p0, lag(k) OVER w AS k0 FROM own{d} WINDOW w AS (PARTITION BY host, pre, post ORDER BY p, at_)),
run{d} AS (SELECT *, sum(CASE WHEN p - p0 > {urls.MERGE_Z}::DOUBLE * sqrt((p0 * k0 + p * k) / (k0 + k) * (1 - (p0 * k0 + p * k) / (k0 + k)) * (1 / k0::DOUBLE + 1 / k::DOUBLE)) THEN 1 ELSE 0 END)
  OVER (PARTITION BY host, pre, post ORDER BY p, at_ ROWS UNBOUNDED PRECEDING) AS run FROM lag{d}),
move{d} AS (SELECT host, template, string_agg(at_, '|') OVER (PARTITION BY host, pre, post, run ORDER BY at_ ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS to_ FROM run{d}),
merge{d - 1} AS (SELECT m.* EXCLUDE (template), CASE WHEN v.to_ IS NULL THEN m.template ELSE m.template[1 : {d - 1}] || [v.to_] || m.template[{d + 1} :] END AS template
  FROM merge{d} m LEFT JOIN move{d} v USING (host, template))""")
    return ",".join(out)


def _rules_sql() -> str:
    fits = "WHEN (host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}') THEN '{2}'"
    return "CASE " + " ".join(fits.format(r.host, r.path, r.text) for r in sorted(urls.RULES, key=lambda r: -len(r.text))) + " END"


_ALLOWING = ", ".join(f"'{r.text}'" for r in urls.RULES if r.verdict == "allow")

ORACLES = {
    "op4_path_templates": f"""
WITH seen AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
coded AS (SELECT *, list_transform(list_filter(string_split(path, '/'), lambda s: s != ''), lambda s:
    CASE WHEN regexp_full_match(s, '[0-9a-fA-F-]{{8,}}') AND regexp_matches(s, '[0-9]') THEN '*' ELSE regexp_replace(s, '[0-9]+', '*', 'g') END) AS c FROM seen),
parsed AS (SELECT page_id, host, path, c AS segs, {_rules_sql()} AS rule FROM coded),
base0 AS (SELECT host, segs, segs AS leaf, count(*) AS n, count(*) FILTER (rule IN ({_ALLOWING})) AS good, count(*) FILTER (rule NOT IN ({_ALLOWING})) AS bad FROM parsed GROUP BY 1, 2),
{_templates_sql()},
sums AS (SELECT host, template, sum(good) AS good, sum(bad) AS bad FROM merge0 GROUP BY 1, 2),
hosts AS (SELECT host, sum(good) AS g, sum(bad) AS b FROM sums GROUP BY 1),
overall AS (SELECT coalesce(sum(g)::DOUBLE / nullif(sum(g) + sum(b), 0), 0.5) AS rate FROM hosts),
prior AS (SELECT host, (g + {urls.SMOOTHING} * rate) / (g + b + {urls.SMOOTHING}) AS prior FROM hosts, overall),
judged AS (SELECT m.host, m.leaf, '/' || array_to_string(m.template, '/') AS template, (s.good + {urls.SMOOTHING} * prior) / (s.good + s.bad + {urls.SMOOTHING}) AS purity
  FROM merge0 m JOIN sums s USING (host, template) JOIN prior USING (host)),
final AS (SELECT page_id, host, path, rule, template, purity FROM parsed JOIN (SELECT host, segs, leaf FROM base{_SQL_DEPTH}) USING (host, segs) JOIN judged USING (host, leaf))
SELECT page_id, host, path, rule, CASE WHEN rule IN ({_ALLOWING}) THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN purity >= {urls.LEAST_PURITY} THEN 'allow' ELSE 'block' END AS verdict, template, round(purity, 6) AS purity FROM final""",
    "op3_byte_shards": f"""
WITH {_CRC},
sized AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
summed AS (
  SELECT doc_id, size, xor(4294967295, list_reduce([4294967295] || list_transform(range(0, size - 1), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
           lambda c, b: xor(c // 256, t[(xor(c, b) & 255) + 1]))) AS text_crc32
  FROM sized, crc_table),
placed AS (
  SELECT doc_id, size, text_crc32,
    ((2 * (sum(size) OVER w - size) + size) * 16 // (2 * sum(size) OVER ()))::INT AS shard
  FROM summed WINDOW w AS (ORDER BY doc_id, size, text_crc32 ROWS UNBOUNDED PRECEDING))
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1 AS slot, NULL::INT AS grown_shard
FROM placed""",
    "op5_poisson_mix": """
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
means AS (SELECT source, sqrt(n) / sum(sqrt(n)) OVER () * sum(n) OVER () / n AS mean FROM counts),
parts AS (SELECT source, mean, greatest(ceil(mean / 16), 1)::INT AS split FROM means),
terms AS (SELECT source, mean, split, exp(-(mean / split)) AS p0, unnest(range(1, 97)) AS k FROM parts),
pmf AS (SELECT source, k, p0 * exp(sum(ln(mean / split / k)) OVER (PARTITION BY source ORDER BY k)) AS p, p0 FROM terms),
cdf AS (SELECT source, list(p0 + s ORDER BY k) AS c, any_value(p0) AS p0
        FROM (SELECT source, k, p0, sum(p) OVER (PARTITION BY source ORDER BY k) AS s FROM pmf) GROUP BY 1),
draws AS (
  SELECT d.doc_id, md5(coalesce(d.text, '')) AS h, d.source, m.mean, unnest(range(m.split)) AS j FROM documents d JOIN parts m ON d.source IS NOT DISTINCT FROM m.source),
drawn AS (
  SELECT doc_id, h, source, mean, j, ('0x' || substr(md5('draw7:' || j || ':' || coalesce(doc_id::VARCHAR, '') || ':' || h), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM draws),
parted AS (
  SELECT r.doc_id, r.h, r.source, r.mean, r.j, (r.u >= c.p0)::INT + len(list_filter(c.c[1:95], lambda x: x <= r.u)) AS n
  FROM drawn r JOIN cdf c ON r.source IS NOT DISTINCT FROM c.source),
counted AS (SELECT doc_id, h, source, mean, sum(n) AS n FROM parted GROUP BY ALL),
copies AS (SELECT doc_id, h, source, mean, unnest(range(n::BIGINT))::INT AS mix_copy FROM counted)
SELECT doc_id, source, mix_copy,
  ('0x' || substr(md5('order7:' || coalesce(doc_id::VARCHAR, '') || ':' || h || ':' || mix_copy), 1, 13))::BIGINT AS mix_key, round(mean, 9) AS mix_mean
FROM copies""",
    "op9_exact_groups": """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n""",
    "op7_minmax_groups": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ') || '  '] ELSE [] END AS s FROM w),
-- Documents of equal sets are one class; only shingles of two classes or more make pairs.
k AS (SELECT doc_id, len(s) AS n, CASE WHEN len(s) > 0 THEN md5(array_to_string(list_sort(s), chr(10))) ELSE 'none ' || doc_id END AS c, s FROM s),
c AS (SELECT c, min(doc_id) AS id, any_value(n) AS n, any_value(s) AS s FROM k GROUP BY 1),
x AS (SELECT id, n, md5_number_lower(unnest(s)) AS h FROM c),
r AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY h) AS f FROM x) WHERE f > 1),
p AS (SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.h = b.h AND a.id < b.id AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach AS (SELECT id AS v, id AS root FROM c UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.v),
least AS (SELECT v, min(root) AS root FROM reach GROUP BY 1)
SELECT k.doc_id, k.n AS n_shingles, least.root AS component_id, k.doc_id = least.root AS kept FROM k JOIN c USING (c) JOIN least ON least.v = c.id""",
    "op8_super_kmers": f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM w WHERE len(w) >= 35),
h AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS h FROM x),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS f FROM h) WHERE f > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM r),
l AS (SELECT doc_id, list(p) AS gone FROM g GROUP BY 1),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w),
k AS (SELECT t.doc_id, string_agg(t.word, ' ' ORDER BY t.p) AS kept FROM t LEFT JOIN g USING (doc_id, p) WHERE g.doc_id IS NULL GROUP BY 1)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(len(l.gone), 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM w LEFT JOIN l USING (doc_id) LEFT JOIN k USING (doc_id)""",
}
