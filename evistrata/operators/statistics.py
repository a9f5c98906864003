"""Exact enrichment tests, false-discovery control and rank statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranking


def log_factorial(n: Column) -> Column:
    """ln n!, exact to about 1e-12: a table below 8, Stirling's series above. Its size doesn't depend on the data."""
    x = F.greatest(n, F.lit(8)).cast("double") + 1
    series = (x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5)) - 1 / (1680 * F.pow(x, 7))
    return F.when(n < 8, F.get(F.array(*[F.lit(math.lgamma(i + 1)) for i in range(8)]), n.cast("int"))).otherwise(series)


def fisher_greater(a: str, in_set: str, in_term: str, total: str) -> Column:
    """P(overlap >= a) under the hypergeometric law.

    The largest term of the tail comes from log-factorials, its neighbours from it by their ratios.
    """
    x, k, n, m = (F.col(c).cast("long") for c in (a, in_term, in_set, total))
    choose = lambda u, v: log_factorial(u) - log_factorial(v) - log_factorial(u - v)
    low, high = F.greatest(x, n + k - m, F.lit(0).cast("long")), F.least(n, k)
    peak = F.least(F.greatest(low, F.floor((n + 1) * (k + 1) / (m + 2)).cast("long")), high)
    top = F.exp(choose(k, peak) + choose(m - k, n - peak) - choose(m, n))
    start = F.struct(top.alias("term"), F.lit(0.0).alias("sum"))
    grown = lambda s, ratio: F.struct((s["term"] * ratio).alias("term"), (s["sum"] + s["term"] * ratio).alias("sum"))
    up = lambda s, i: grown(s, (k - i + 1) * (n - i + 1) / (i * (m - k - n + i)).cast("double"))
    down = lambda s, i: grown(s, (i + 1) * (m - k - n + i + 1) / ((k - i) * (n - i)).cast("double"))
    steps = lambda on, f, t, by: F.when(on, F.sequence(f, t, F.lit(by).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    above = F.aggregate(steps(peak < high, peak + 1, high, 1), start, up)["sum"]
    below = F.aggregate(steps(peak > low, peak - 1, low, -1), start, down)["sum"]
    return F.when(low > high, 0.0).otherwise(F.least(F.lit(1.0), top + above + below))


def normal_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal law, by a Chebyshev fit with relative error below 1.2e-7."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    # Coefficients of the fit, highest power first.
    fit = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)
    poly = F.lit(fit[0])
    for c in fit[1:]:
        poly = poly * t + c
    half = t * F.exp(-x * x + poly) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.when((b == 0) | (c == 0), F.lit(float("inf"))).otherwise(F.try_divide(a * d, b * c)).cast("double")


def benjamini_hochberg(df: DataFrame, p: str, scope: list[str] | None = None, name: str = "padj") -> DataFrame:
    """Adjusted p within each scope; null p stay null and don't count."""
    part = [F.col(c) for c in scope or []] or [F.lit(1)]
    some = F.col(p).isNotNull()
    r = F.row_number().over(Window.partitionBy(*part).orderBy(F.col(p).asc_nulls_last()))
    m = F.count(p).over(Window.partitionBy(*part))
    out = df.withColumn("q__", F.when(some, F.col(p) * m / r))
    right = Window.partitionBy(*part).orderBy(F.col(p).asc_nulls_last()).rangeBetween(Window.currentRow, Window.unboundedFollowing)
    return out.withColumn(name, F.when(some, F.least(F.lit(1.0), F.min("q__").over(right)))).drop("q__")


def set_term_fisher(sets: DataFrame, terms: DataFrame, universe: int) -> DataFrame:
    """sets(set_id, gene), terms(term, gene) -> contingency, odds ratio and p of every overlapping pair."""
    sizes = sets.groupBy("set_id").agg(F.countDistinct("gene").alias("n_set"))
    widths = terms.groupBy("term").agg(F.countDistinct("gene").alias("n_term"))
    shared = sets.join(terms, "gene").groupBy("set_id", "term").agg(F.countDistinct("gene").alias("a"))
    t = shared.join(sizes, "set_id").join(widths, "term").withColumn("total", F.lit(universe).cast("long"))
    b, c = F.col("n_set") - F.col("a"), F.col("n_term") - F.col("a")
    d = F.col("total") - F.col("a") - b - c
    return t.select("set_id", "term", "a", "n_set", "n_term", odds_ratio(F.col("a"), b, c, d).alias("odds_ratio"), fisher_greater("a", "n_set", "n_term", "total").alias("p"))


def cliffs_delta(df: DataFrame, value: str, label: str) -> DataFrame:
    """One row: sizes, Mann-Whitney U of label 1 over label 0, delta = 2U / (n1 n0) - 1. Ties are counted by value."""
    ties = df.groupBy(value).agg(F.count_if(F.col(label) == 1).alias("a"), F.count_if(F.col(label) == 0).alias("b"))
    ties = ranking.running_before(ties, value, "b", "below")
    u = ties.select("a", "b", (F.col("a") * (F.col("below") + F.col("b") / 2)).alias("u")).agg(F.sum("a").alias("n1"), F.sum("b").alias("n0"), F.sum("u").alias("u"))
    return u.withColumn("delta", F.try_divide(2 * F.col("u"), F.col("n1") * F.col("n0")) - 1)


def enrichment(scored: DataFrame, members: DataFrame) -> DataFrame:
    """scored(gene, score), members(module, gene) -> weighted running-sum enrichment score of each module.

    A hit adds |score| / sum of the module's, a miss subtracts 1 / misses; the score is the extreme deviation. Only
    hits are visited: before each hit the running sum is at its lowest since the hit before.
    """
    total = scored.agg(F.count("*").alias("n")).first()["n"]
    ranked = ranking.distributed_row_number(scored.select("gene", "score"), [F.desc("score"), F.asc("gene")], "pos")
    hits = ranked.join(members, "gene")
    w = Window.partitionBy("module")
    to = w.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    size, weight = F.count("*").over(w), F.sum(F.abs("score")).over(w)
    hits = hits.select("module", size.alias("size"), (F.sum(F.abs("score")).over(to) / weight).alias("up"), (F.abs("score") / weight).alias("step"), ((F.col("pos") - F.row_number().over(w.orderBy("pos"))) / (F.lit(total) - size)).alias("down"))
    ends = hits.select("module", "size", (F.col("up") - F.col("down")).alias("top"), (F.col("up") - F.col("step") - F.col("down")).alias("dip"))
    best = ends.groupBy("module").agg(F.first("size").alias("size"), F.max("top").alias("hi"), F.least(F.min("dip"), F.lit(0.0)).alias("lo"))
    return best.select("module", "size", F.when(F.col("hi") >= -F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("es"))


def leading_edges(scored: DataFrame, members: DataFrame, most: int = 50) -> DataFrame:
    """scored(gene, score), members(module, gene) -> module, edge: the hits up to the highest point of the running sum (or
    from the lowest on, where that is further from 0), in rank order, `most` at the most."""
    total = scored.agg(F.count("*").alias("n")).first()["n"]
    ranked = ranking.distributed_row_number(scored.select("gene", "score"), [F.desc("score"), F.asc("gene")], "pos")
    w = Window.partitionBy("module")
    to = w.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    size, weight = F.count("*").over(w), F.sum(F.abs("score")).over(w)
    up, nth = F.sum(F.abs("score")).over(to) / weight, F.row_number().over(w.orderBy("pos"))
    h = ranked.join(members, "gene").select("module", "gene", nth.alias("nth"), up.alias("up"), (F.abs("score") / weight).alias("step"), ((F.col("pos") - nth) / (F.lit(total) - size)).alias("down"))
    best = h.groupBy("module").agg(F.max(F.struct((F.col("up") - F.col("down")).alias("v"), (-F.col("nth")).alias("at"))).alias("hi"), F.min(F.struct((F.col("up") - F.col("step") - F.col("down")).alias("v"), F.col("nth").alias("at"))).alias("lo"))
    rising = F.col("hi.v") >= -F.least(F.col("lo.v"), F.lit(0.0))
    on = h.join(best, "module").where(F.when(rising, F.col("nth") <= -F.col("hi.at")).otherwise(F.col("nth") >= F.col("lo.at")))
    first = F.slice(F.array_sort(F.collect_list(F.struct("nth", "gene"))), 1, most)
    return on.groupBy("module").agg(F.transform(first, lambda x: x["gene"]).alias("edge"))


def rank_sum_tests(scored: DataFrame, members: DataFrame) -> DataFrame:
    """scored(gene, score), members(module, gene) -> module, n1, z, p: Mann-Whitney of each module against the rest, normal
    approximation without tie correction, one-sided. Modules with fewer than 2 genes in or out are left out."""
    ranks = ranking.distributed_average_rank(scored, "score", "rank")
    n = F.lit(scored.count()).cast("double")
    sums = ranks.join(members.distinct(), "gene").groupBy("module").agg(F.count("*").alias("n1"), F.sum("rank").alias("r")).where((F.col("n1") >= 2) & (n - F.col("n1") >= 2))
    n1, n2 = F.col("n1").cast("double"), n - F.col("n1")
    z = (F.col("r") - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / F.sqrt(n1 * n2 * (n + 1) / 12)
    return sums.select("module", "n1", z.alias("z")).withColumn("p", normal_tail(F.col("z")))


def two_sided_rank_sum(df: DataFrame, value: str, label: str) -> DataFrame:
    """cliffs_delta with p: two-sided Mann-Whitney, normal approximation with tie and continuity corrections."""
    ties = df.groupBy(value).agg(F.count("*").cast("double").alias("t")).agg(F.sum(F.pow("t", 3) - F.col("t")).alias("ties"))
    u = cliffs_delta(df, value, label).join(F.broadcast(ties))
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n = n1 + n0
    sd = F.sqrt(n1 * n0 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = (F.greatest(F.col("u"), n1 * n0 - F.col("u")) - n1 * n0 / 2 - 0.5) / sd
    return u.select("n1", "n0", "u", "delta", F.least(F.lit(1.0), 2 * normal_tail(z)).alias("p"))


def flag_enrichment(rows: DataFrame, group: str, flag: str) -> DataFrame:
    """Fisher test (greater) of a 0/1 flag in each group against the other rows, adjusted over the groups."""
    g = rows.groupBy(group).agg(F.sum(flag).alias("a"), F.count("*").alias("n_set"))
    all_ = g.agg(F.sum("a").alias("n_term"), F.sum("n_set").alias("total"))
    t = g.join(F.broadcast(all_))
    b, c = F.col("n_set") - F.col("a"), F.col("n_term") - F.col("a")
    d = F.col("total") - F.col("n_set") - c
    out = t.select(group, "a", b.alias("b"), c.alias("c"), d.alias("d"), odds_ratio(F.col("a"), b, c, d).alias("odds_ratio"), fisher_greater("a", "n_set", "n_term", "total").alias("p"))
    return benjamini_hochberg(out, "p")


def shuffled(key: Column, seed: Column) -> Column:
    """A random order that a seed and a key decide: equal on every machine and in every partitioning."""
    return F.md5(F.concat_ws(":", seed.cast("string"), key.cast("string")))


def distance_permutation(points: DataFrame, key: str, flag: str, draws: int) -> DataFrame:
    """One row: the mean distance between flagged points (x, y), the mean over random sets of as many, the share of sets
    that are as close, with one added to both counts, and z. A set's pairs meet in one task per draw."""
    n = points.where(flag).count()
    sets = points.select(key, "x", "y", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    sets = sets.withColumn("r", F.row_number().over(Window.partitionBy("draw").orderBy(shuffled(F.col(key), F.col("draw")), key))).where(F.col("r") <= n).drop("r")
    both = sets.union(points.where(flag).select(key, "x", "y", F.lit(-1).alias("draw")))
    a, b = both.select("draw", F.col(key).alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay")), both.select("draw", F.col(key).alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    pairs = a.join(b, "draw").where("a < b").withColumn("d", F.sqrt(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2)))
    means = pairs.groupBy("draw").agg(F.avg("d").alias("d"))
    observed = means.where("draw = -1").select(F.col("d").alias("observed"))
    drawn = means.where("draw >= 0").join(F.broadcast(observed))
    out = drawn.groupBy("observed").agg(F.avg("d").alias("random_mean"), ((F.count_if(F.col("d") <= F.col("observed")) + 1) / (F.count("*") + 1)).alias("p"), F.stddev_samp("d").alias("sd"))
    return out.select("observed", "random_mean", "p", F.try_divide(F.col("observed") - F.col("random_mean"), F.col("sd")).alias("z"))
