"""URL filters: rules of host and path, and for other urls a tree of path templates for each host, in built-in expressions only.

Segments that vary become wildcards: digits by their form, and values that are rare at their depth by their share.  Templates whose
labels don't differ from those of their siblings are merged into the branch above.  A branch is rejected if the smoothed share of
its labelled urls that are to be blocked is high.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules are a short curated list that goes into the plan as constants.
MOST_RULES = 1000

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rule(host: Column, path: Column, rules: list[tuple[str, str]], value: int) -> Column:
    """Of the longest rule that fits, its text (``value`` 1) or verdict (0); null if none does.  Equal lengths: the first in order."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    fits = []
    for rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        h, slash, p = rule[1].partition("/")
        fits.append(F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(slash + p)), F.lit(rule[value])))
    return F.coalesce(*fits) if fits else F.lit(None).cast("string")


def _generalised(path: str) -> str:
    """SQL for the segments of a path with digits as {n} and long hexadecimal values as {h}."""
    one = r"regexp_replace(regexp_replace(s, '(?i)^(?=[^0-9]*[0-9])[0-9a-f-]{12,}(?=$|[.])', '{h}'), '[0-9]+', '{n}')"
    return f"transform(filter(split({path}, '/'), s -> s <> ''), s -> {one})"


def template_tree(urls: DataFrame, min_share: float = 0.02, merge_rounds: int = 2, z: float = 1.96, strength: float = 10.0) -> DataFrame:
    """``urls`` (id, host, path, label; label 1 to block, 0 to allow, null unknown) with ``template``, ``purity``, ``n_labelled``, ``n_blocked``.

    A segment stays as it is if at least ``min_share`` of the host's urls of that depth have it there, else it is '*'; so a host
    has at most 1 / min_share values a depth.  ``merge_rounds`` times, a template whose block rate is within ``z`` standard errors of that of its
    siblings (templates with the same branch above: the last kept segment as '*') takes the name of that branch; without labels on
    either side there is no likeness to tell and it stays.  Purity: (blocked + strength * prior) / (labelled + strength), prior: the block rate of all labels, 0.5
    if there are none.  An empty path is the template ''.  Repeated rows count each.  Nothing is dropped, and no group is collected but
    the kept segments of a host.
    """
    urls = urls.select("id", "host", "path", "label").withColumn("segments", F.expr(_generalised("path")))
    at = urls.select("host", F.posexplode("segments").alias("depth", "segment")).groupBy("host", "depth", "segment").count()
    total = at.groupBy("host", "depth").agg(F.sum("count").alias("total"))
    kept = at.join(total, ["host", "depth"]).where(F.col("count") >= F.greatest(F.lit(2.0), F.lit(min_share) * F.col("total")))
    kept = kept.groupBy("host").agg(F.collect_set(F.concat_ws(":", "depth", "segment")).alias("kept"))
    urls = urls.join(kept, "host", "left").withColumn("template", F.expr("concat_ws('/', transform(segments, (s, i) -> if(array_contains(coalesce(kept, array()), concat_ws(':', i, s)), s, '*')))"))
    urls = urls.select("id", "host", "path", "label", "template")

    # one row for each template of a host, which every round below and the prior read
    leaves = stored(urls.groupBy("host", "template").agg(F.count("label").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("blocked")), "templates")
    nodes = leaves.withColumn("node", F.col("template"))
    for _ in range(merge_rounds):
        own = nodes.groupBy("host", "node").agg(F.sum("n").alias("n1"), F.sum("blocked").alias("b1"))
        own = own.withColumn("up", F.regexp_replace("node", r"(^|/)[^*/][^/]*((?:/\*)*)$", "$1*$2"))
        above = own.groupBy("host", "up").agg(F.sum("n1").alias("na"), F.sum("b1").alias("ba"))
        both = own.join(above, ["host", "up"]).withColumn("n0", F.col("na") - F.col("n1")).withColumn("b0", F.col("ba") - F.col("b1"))
        p = (F.col("ba") + 1) / (F.col("na") + 2)
        gap = F.abs((F.col("b1") + 1) / (F.col("n1") + 2) - (F.col("b0") + 1) / (F.col("n0") + 2))
        error = F.sqrt(p * (1 - p) * (1 / (F.col("n1") + 2) + 1 / (F.col("n0") + 2)))
        same = (F.col("n1") > 0) & (F.col("n0") > 0) & (gap <= z * error)
        renamed = both.select("host", "node", F.when(same, F.col("up")).otherwise(F.col("node")).alias("new"))
        nodes = nodes.join(renamed, ["host", "node"]).select("host", "template", "n", "blocked", F.col("new").alias("node"))
    prior = leaves.agg(F.coalesce(F.sum("blocked") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.5)).alias("prior"))
    sums = nodes.groupBy("host", "node").agg(F.sum("n").alias("n_labelled"), F.sum("blocked").alias("b")).crossJoin(F.broadcast(prior))
    purity = (F.col("b") + F.lit(strength) * F.col("prior")) / (F.col("n_labelled") + F.lit(strength))
    judged = nodes.select("host", "template", "node").join(sums.select("host", "node", "n_labelled", F.col("b").alias("n_blocked"), purity.alias("purity")), ["host", "node"])
    judged = judged.select("host", "template", "node", "n_labelled", "n_blocked", "purity")
    return urls.join(judged, ["host", "template"]).select("id", "host", "path", "label", F.col("node").alias("template"), "n_labelled", "n_blocked", "purity")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] | None = None, id_col: str = "page_id", url: str = "url", max_purity: float = 0.8, **tree) -> DataFrame:
    """(id, host, path, rule, verdict, template, purity) of each row of ``pages``.

    Host: after the first '://' up to '/', '?', '#' or the end, A-Z lowered; path: from there to '?', '#' or the end; both empty without
    '://' or for null.  A rule fits its host and subdomains where the path starts with the rule's; the longest decides.  Urls with a rule
    are the labelled examples for the tree, which decides on the rest: 'block' where ``purity`` is ``max_purity`` or more, and so is the block rate of the
    branch's own labels.  The prior alone never blocks: a branch without labels is allowed.
    """
    rules = RULES if rules is None else rules
    seen = pages.select(pages[id_col].alias("id"), url_host(pages[url]).alias("host"), url_path(pages[url]).alias("path"))
    verdict = match_rule(F.col("host"), F.col("path"), rules, 0)
    tree_rows = template_tree(seen.withColumn("label", F.when(verdict == "block", 1).when(verdict == "allow", 0)), **tree)
    own = (F.col("n_labelled") > 0) & (F.col("n_blocked") >= max_purity * F.col("n_labelled"))
    other = F.when(own & (F.col("purity") >= max_purity), "block").otherwise("allow")
    return tree_rows.select("id", "host", "path", match_rule(F.col("host"), F.col("path"), rules, 1).alias("rule"), F.coalesce(verdict, other).alias("verdict"), "template", "purity")


def op5_url_filter(spark, sf_dir):
    out = filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "template", F.round("purity", 6).alias("purity"))
