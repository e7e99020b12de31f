"""URL filters: host rules first, then a path-template tree per host with smoothed labelled purity."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanmill.llm.shared import Staging, named

#: A branch stays literal if its parent has few branches or if it has this share of its parent's pages.
FEW_BRANCHES = 12
LEAST_SHARE = 0.02
#: Sibling branches whose good rates differ by fewer standard errors are merged.
MERGE_Z = 1.96
#: Pseudo-pages of a host's prior, and the purity under which a template is rejected.
SMOOTHING = 4.0
LEAST_PURITY = 0.5
WILD = "*"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The production rules, fixed values of the contract.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def url_host(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def path_segments(path: Column) -> Column:
    """The path's non-empty segments, digits and long hexadecimal runs made wildcards."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(
        parts, lambda s: F.when(s.rlike("^[0-9a-fA-F-]{8,}$") & s.rlike("[0-9]"), F.lit(WILD)).otherwise(F.regexp_replace(s, "[0-9]+", WILD))
    )


def _at(arr: str, d: int) -> Column:
    return F.get(F.col(arr), F.lit(d - 1))


def _before(arr: str, d: int) -> Column:
    return F.slice(F.col(arr), 1, d - 1) if d > 1 else F.array().cast("array<string>")


def _with_at(arr: str, d: int, value: Column) -> Column:
    """The array with its d-th element replaced, where it has one."""
    return F.when(
        (F.size(arr) >= d) & value.isNotNull(), F.transform(F.col(arr), lambda x, i: F.when(i == d - 1, value).otherwise(x))
    ).otherwise(F.col(arr))


def path_templates(staging: Staging, pages: DataFrame) -> DataFrame:
    """From (host, segs, good, bad) rows one row per host and segments: `leaf`, the generalised segments, `template`,
    those with similar branches merged, and the template's summed good and bad.

    Generalising goes down the tree: a segment becomes a wildcard unless its node has at most FEW_BRANCHES branches or
    the branch has LEAST_SHARE of its node's pages. Merging goes up: siblings, alike in all other segments, are put in
    order of their smoothed good rate, and neighbours whose rates differ by less than MERGE_Z standard errors join.
    There is a pass a level each way, down to the deepest node that two paths share: below a node of one path nothing
    branches, so that path is left as it is, however long.
    Every step works on counts per distinct path or template; sorting happens among the literal branches of one node
    only, of which there are at most max(FEW_BRANCHES, 1 / LEAST_SHARE) + 1.
    """
    base = pages.groupBy("host", "segs").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    base = staging.write(base.withColumn("leaf", F.col("segs")).withColumn("shared", F.lit(True)), "level0")
    depth = 0
    while not base.where(F.col("shared") & (F.size("leaf") > depth)).limit(1).isEmpty():
        depth += 1
        inside = F.col("shared") & (F.size("leaf") >= depth)
        keyed = base.where(inside).withColumn("__before", _before("leaf", depth)).withColumn("__at", _at("leaf", depth))
        kids = keyed.groupBy("host", "__before", "__at").agg(F.sum("n").alias("__n"), F.count(F.lit(1)).alias("__paths"))
        node = kids.groupBy("host", "__before").agg(F.sum("__n").alias("__all"), F.count(F.lit(1)).alias("__kids"), F.sum("__paths").alias("__paths"))
        stays = (F.col("__kids") <= FEW_BRANCHES) | (F.col("__n") >= LEAST_SHARE * F.col("__all"))
        to = F.when(stays, F.col("__at")).otherwise(F.lit(WILD)).alias("__to")
        kids = kids.drop("__paths").join(node, ["host", "__before"]).select("host", "__before", "__at", to, (F.col("__paths") > 1).alias("__shared"))
        moved = keyed.join(kids, ["host", "__before", "__at"]).withColumn("leaf", _with_at("leaf", depth, F.col("__to"))).withColumn("shared", F.col("__shared"))
        # Written: each level uses the one before twice, and a plan would double with every level.
        base = staging.write(base.where(~inside).unionByName(moved.select(*base.columns)), f"level{depth}")
        staging.drop(f"level{depth - 1}")
    base = base.drop("shared")
    leaves = base.groupBy("host", "leaf").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).withColumn("template", F.col("leaf"))
    for d in range(depth, 0, -1):
        after = F.when(F.size("template") > d, F.slice("template", d + 1, F.size("template"))).otherwise(F.array().cast("array<string>"))
        own = leaves.groupBy("host", "template").agg(F.sum("good").alias("__good"), F.sum("bad").alias("__bad")).where(F.size("template") >= d)
        own = own.withColumn("__at", _at("template", d)).withColumn("__before", _before("template", d)).withColumn("__after", after)
        own = own.withColumn("__k", F.col("__good") + F.col("__bad") + 2).withColumn("__p", (F.col("__good") + 1) / F.col("__k"))
        siblings = Window.partitionBy("host", "__before", "__after").orderBy("__p", "__at")
        p0, k0 = F.lag("__p").over(siblings), F.lag("__k").over(siblings)
        pool = (p0 * k0 + F.col("__p") * F.col("__k")) / (k0 + F.col("__k"))
        apart = (F.col("__p") - p0) > MERGE_Z * F.sqrt(pool * (1 - pool) * (1 / k0 + 1 / F.col("__k")))
        own = own.withColumn("__new", F.coalesce(apart.cast("int"), F.lit(0))).withColumn("__run", F.sum("__new").over(siblings))
        runs = own.groupBy("host", "__before", "__after", "__run").agg(F.array_join(F.array_sort(F.collect_set("__at")), "|").alias("__to"))
        moved = own.join(runs, ["host", "__before", "__after", "__run"]).select("host", "template", "__to")
        leaves = leaves.join(moved, ["host", "template"], "left").withColumn("template", _with_at("template", d, F.col("__to"))).drop("__to")
        leaves = staging.write(leaves, f"merged{d}")
        staging.drop(f"merged{d + 1}")
    leaves = leaves.drop("good", "bad").join(base, ["host", "leaf"])
    sums = leaves.groupBy("host", "template").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    return leaves.select("host", "segs", "leaf", "template").join(sums, ["host", "template"])


def judge_urls(
    spark: SparkSession,
    pages: DataFrame,
    labels: DataFrame | None = None,
    rules: Sequence[Rule] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every row of `pages`.

    `labels` has (page_id, good 0 or 1) rows; of several for a page the worst counts. Without labels the pages that a
    rule fits are the labelled ones, good if it allows them. A rule's verdict wins, the longest first; else a page is
    allowed iff its template's purity is at least LEAST_PURITY: (good + SMOOTHING * host's rate) / (labelled +
    SMOOTHING), the host's rate being smoothed alike towards that of all pages (0.5 if nothing is labelled). A null url
    or one without `://` has an empty host and path and is judged as such. Repeated rows and null ids stay; other
    columns are not read; an empty table gives an empty result.

    Hosts and paths are pre-aggregated, so that a hot host costs a task its distinct paths, not its pages.
    """
    staging = Staging(spark, "judge_urls")
    plain = pages.select(named(id_col).alias("page_id"), named(url_col).alias("__url"))
    parsed = plain.select("page_id", url_host(F.col("__url")).alias("host"), url_path(F.col("__url")).alias("path"))
    parsed = parsed.withColumn("segs", path_segments(F.col("path")))
    if labels is None:
        marked = parsed.withColumn("__good", (matching_rule(F.col("host"), F.col("path"), rules)["verdict"] == "allow").cast("int"))
    else:
        worst = labels.select(F.col("page_id").alias("__id"), F.col("good").alias("__good")).groupBy("__id").agg(F.min("__good").alias("__good"))
        marked = parsed.join(worst, F.col("page_id") == F.col("__id"), "left").drop("__id")
    marked = marked.withColumn("good", F.coalesce((F.col("__good") == 1).cast("long"), F.lit(0).cast("long")))
    marked = marked.withColumn("bad", F.coalesce((F.col("__good") == 0).cast("long"), F.lit(0).cast("long"))).drop("__good")
    templates = staging.write(path_templates(staging, marked), "templates")
    once = templates.select("host", "template", "good", "bad").distinct()
    hosts = once.groupBy("host").agg(F.sum("good").alias("__hg"), F.sum("bad").alias("__hb"))
    everywhere = hosts.agg(F.sum("__hg").alias("good"), F.sum("__hb").alias("bad")).first()
    labelled = (everywhere["good"] or 0) + (everywhere["bad"] or 0)
    overall = everywhere["good"] / labelled if labelled else 0.5
    rate = (F.col("__hg") + SMOOTHING * F.lit(overall)) / (F.col("__hg") + F.col("__hb") + SMOOTHING)
    hosts = hosts.select("host", rate.alias("__prior"))
    judged = templates.join(hosts, "host").select(
        F.col("host").alias("__host"),
        F.col("segs").alias("__segs"),
        F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"),
        ((F.col("good") + SMOOTHING * F.col("__prior")) / (F.col("good") + F.col("bad") + SMOOTHING)).alias("purity"),
    )
    out = parsed.join(judged, (F.col("host") == F.col("__host")) & (F.col("segs") == F.col("__segs")))
    out = out.withColumn("__rule", matching_rule(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("purity") >= LEAST_PURITY, F.lit("allow")).otherwise(F.lit("block"))
    return out.select("page_id", "host", "path", F.col("__rule.rule").alias("rule"), F.coalesce(F.col("__rule.verdict"), own).alias("verdict"), "template", F.round("purity", 6).alias("purity"))
