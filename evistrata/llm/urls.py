"""URL filter: hand-written rules first, then a tree of path templates per host.

Templates. Digits in a path segment become "{n}". Then, level by level below each host, a node whose children are many
and mostly seen once becomes a wildcard: at least VARIABLE distinct segments, over half as many as visits. A path is done
once fewer than VARIABLE paths share its template so far, as no node below it can be variable then.

Verdicts. URLs that a rule decides are the labelled ones. A labelled branch (first segment of a host) whose share of
blocked labels differs from that of its host by less than Z standard errors is merged with the host's other branches.
A template's share of blocked labels is smoothed towards its (merged) branch's, which is smoothed towards PRIOR, each
with weight SMOOTH; a template is rejected when that purity reaches REJECT. Unlabelled branches thus stay allowed.

Defined cases: null url or one without "://": empty host and path, one template of its own; a host without labelled
URLs is allowed; repeated rows each get a verdict; an empty table gives an
empty result; other columns (html) are never read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep

#: verdict, host, path; the longest fitting rule wins.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
VARIABLE = 8
SMOOTH = 2.0
Z = 1.96
PRIOR = 0.5
REJECT = 0.8


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1, F.char_length(rest) + 1), r"^([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the last one set is the longest
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def path_templates(shapes: DataFrame) -> DataFrame:
    """shapes(host, shape, n) -> (host, shape, template): segments below variable nodes become "*"."""
    seg = F.split(F.expr("substring(shape, 2)"), "/")
    left = keep(shapes.groupBy("host", "shape").agg(F.sum("n").alias("n")).withColumn("segs", seg).withColumn("template", F.lit("")))
    done, d = [], 0
    rest = lambda d: F.when(F.size("segs") > d, F.concat(F.lit("/"), F.array_join(F.slice("segs", d + 1, 1 << 30), "/"))).otherwise("")
    finished = lambda df, d: df.select("host", "shape", F.concat("template", rest(d)).alias("template"))
    while not left.isEmpty():
        for _ in range(3):
            here = F.get("segs", F.lit(d))
            children = left.where(here.isNotNull()).groupBy("host", "template", here.alias("seg")).agg(F.sum("n").alias("n"))
            nodes = children.groupBy("host", "template").agg(F.count("*").alias("kinds"), F.sum("n").alias("visits"))
            variable = nodes.where((F.col("kinds") >= VARIABLE) & (F.col("kinds") * 2 > F.col("visits"))).select("host", "template", F.lit(True).alias("variable"))
            step = F.when(here.isNull(), F.lit("")).otherwise(F.concat(F.lit("/"), F.when(F.col("variable"), "*").otherwise(here)))
            left = left.join(variable, ["host", "template"], "left").select("host", "shape", "n", "segs", F.concat("template", step).alias("template"))
            d += 1
        crowded = left.where(F.size("segs") > d).groupBy("host", "template").agg(F.count("*").alias("paths")).where(F.col("paths") >= VARIABLE).select("host", "template", F.lit(True).alias("crowded"))
        split = keep(left.join(crowded, ["host", "template"], "left").withColumn("on", F.coalesce("crowded", F.lit(False)) & (F.size("segs") > d)).drop("crowded"))
        done.append(finished(split.where(~F.col("on")), d))
        left = split.where("on").drop("on")
    out = done[0] if done else finished(left, 0)
    for part in done[1:]:
        out = out.union(part)
    return out


def template_verdicts(templates: DataFrame) -> DataFrame:
    """templates(host, template, blocked, labelled) -> host, template, purity, verdict."""
    branch = F.regexp_extract("template", "^(/[^/]*)", 1)
    leaf = keep(templates.groupBy("host", "template").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l")).withColumn("branch", branch))
    counted = lambda *k: leaf.groupBy(*k).agg(F.sum("b").alias("b"), F.sum("l").alias("l"))
    smooth = lambda b, n, above: (b + SMOOTH * above) / (n + SMOOTH)
    branches = counted("host", "branch").join(counted("host").withColumnsRenamed({"b": "host_b", "l": "host_l"}), "host")
    share, pool = F.try_divide("b", "l"), F.try_divide("host_b", "host_l")
    alike = (F.col("l") > 0) & (F.abs(share - pool) <= Z * F.sqrt(F.try_divide(pool * (1 - pool), F.col("l"))))
    merged = lambda own, host: F.when(alike, F.col(host)).otherwise(F.col(own))
    branches = branches.select("host", "branch", merged("b", "host_b").alias("pool_b"), merged("l", "host_l").alias("pool_l"))
    purity = smooth(F.col("b"), F.col("l"), smooth(F.col("pool_b"), F.col("pool_l"), F.lit(PRIOR)))
    near = leaf.join(branches, ["host", "branch"])
    return near.select("host", "template", purity.alias("purity"), F.when(purity >= REJECT, "block").otherwise("allow").alias("verdict"))


def judge(pages: DataFrame) -> DataFrame:
    """pages(page_id, url) -> page_id, host, path, rule, verdict, template, purity."""
    host, path = host_path(F.col("url"))
    base = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, by_rule = rule_of(F.col("host"), F.col("path"))
    shape = F.regexp_replace("path", "[0-9]+", "{n}")
    base = keep(base.select("page_id", "host", "path", rule.alias("rule"), by_rule.alias("by_rule"), shape.alias("shape")))
    labels = [F.count(F.when(F.col("by_rule") == "block", 1)).alias("blocked"), F.count("by_rule").alias("labelled"), F.count("*").alias("n")]
    shapes = keep(base.groupBy("host", "shape").agg(*labels))
    named = keep(shapes.join(path_templates(shapes.select("host", "shape", "n")), ["host", "shape"]))
    verdicts = template_verdicts(named.select("host", "template", "blocked", "labelled"))
    by_shape = named.select("host", "shape", "template").join(verdicts, ["host", "template"])
    out = base.join(by_shape, ["host", "shape"])
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", "verdict").alias("verdict"), "template", "purity")


def op5_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
