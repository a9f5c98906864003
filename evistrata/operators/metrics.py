"""Ranking and agreement metrics by group. A metric without both classes is null."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def auc_by(df: DataFrame, group: str, score: str, label: str) -> DataFrame:
    """group -> n, positives, roc_auc (average ranks), average_precision (ties processed together)."""
    ties = df.groupBy(group, score).agg(F.count("*").alias("n"), F.sum(label).alias("p"))
    up = Window.partitionBy(group).orderBy(F.asc(score))
    down = Window.partitionBy(group).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    below = F.coalesce(F.sum("n").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = ties.select(group, "n", "p", (below + (F.col("n") + 1) / 2).alias("rank"), (F.sum("p").over(down) / F.sum("n").over(down)).alias("precision"))
    sums = parts.groupBy(group).agg(F.sum("n").alias("n"), F.sum("p").alias("positives"), F.sum(F.col("p") * F.col("rank")).alias("r"), F.sum(F.col("p") * F.col("precision")).alias("a"))
    p, q = F.col("positives"), F.col("n") - F.col("positives")
    both = (p > 0) & (q > 0)
    return sums.select(
        group, F.col("n").cast("long").alias("n"), p.cast("long").alias("positives"),
        F.when(both, F.try_divide(F.col("r") - p * (p + 1) / 2, p * q)).alias("roc_auc"), F.when(both, F.try_divide(F.col("a"), p)).alias("average_precision"),
    )


def recall_and_mrr(ranked: DataFrame, group: str, rank: str, label: str, ks: tuple[int, ...] = (1, 3)) -> DataFrame:
    """One row over groups with a positive: share whose best positive is within k, and the mean reciprocal rank."""
    best = ranked.where(F.col(label) == 1).groupBy(group).agg(F.min(rank).alias("best"))
    return best.agg(F.count("*").alias("groups"), *[F.avg((F.col("best") <= k).cast("double")).alias(f"recall_at_{k}") for k in ks], F.avg(1 / F.col("best")).alias("mrr"))


def top_overlap(a: DataFrame, b: DataFrame, key: str, n: int) -> DataFrame:
    """a, b (key, score): size of the intersection of their n best, and its Jaccard share."""
    best = lambda d: d.orderBy(F.desc("score"), key).limit(n).select(key)
    both = best(a).withColumn("in_a", F.lit(1)).join(best(b).withColumn("in_b", F.lit(1)), key, "outer")
    return both.agg(F.count(F.col("in_a") + F.col("in_b")).alias("shared"), (F.count(F.col("in_a") + F.col("in_b")) / F.count("*")).alias("jaccard"))


def separability(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Per feature max(AUC, 1 - AUC) and the ranges of both classes."""
    long = df.select(label, *[F.col(f).cast("double").alias(f) for f in features]).unpivot([label], features, "feature", "value")
    ranges = long.groupBy("feature").agg(*[f(F.when(F.col(label) == v, F.col("value"))).alias(f"{n}_{v}") for v in (0, 1) for n, f in (("min", F.min), ("max", F.max))])
    auc = auc_by(long, "feature", "value", label).select("feature", F.greatest("roc_auc", 1 - F.col("roc_auc")).alias("separability"))
    return ranges.join(auc, "feature")


def global_metrics(ranked: DataFrame, rank: str, gold: str, total: int | None = None, ks: tuple[int, ...] = (10, 50, 100)) -> DataFrame:
    """One row over a global ranking: recall at each k, reciprocal ranks and mean and median rank of gold rows.

    With `total`, all gold genes are the denominator, found or not; without, those that are found. Without gold: null.
    """
    r = F.when(F.col(gold) == 1, F.col(rank))
    n = F.lit(total).cast("double") if total is not None else F.count(r).cast("double")
    share = lambda x: F.try_divide(x, n)
    return ranked.agg(
        F.count(r).alias("found"), *[share(F.count_if(r <= k)).alias(f"recall_at_{k}") for k in ks], share(F.sum(1 / r)).alias("mrr"),
        share(F.sum(F.when(r <= 20, 1 / r).otherwise(0.0))).alias("mrr_20"), F.avg(r).alias("mean_rank"), F.percentile(r, 0.5).alias("median_rank"),
    )


def per_source_auc(df: DataFrame, sources: list[str], predictors: list[str], threshold: float, least: int) -> DataFrame:
    """(source, predictor) -> auc_by of the labels source >= threshold; sources with fewer than `least` positives skipped."""
    long = df.unpivot(predictors, sources, "source", "evidence").withColumn("y", (F.coalesce("evidence", F.lit(0.0)) >= threshold).cast("int"))
    enough = long.groupBy("source").agg(F.sum("y").alias("n")).where(F.col("n") >= least).select("source")
    rows = long.join(F.broadcast(enough), "source").unpivot(["source", "y"], predictors, "predictor", "score")
    keyed = rows.select(F.struct("source", "predictor").alias("g"), F.coalesce("score", F.lit(0.0)).alias("score"), "y")
    return auc_by(keyed, "g", "score", "y").select("g.source", "g.predictor", "n", "positives", "roc_auc", "average_precision")


def overlap_counts(train: DataFrame, test: DataFrame, ids: list[str]) -> DataFrame:
    """id -> distinct values in train, in test, and in both."""
    side = lambda d, name: d.select(F.explode(F.array(*[F.struct(F.lit(c).alias("id"), F.col(c).cast("string").alias("v")) for c in ids])).alias("x")).select("x.*").where("v is not null").distinct().withColumn(name, F.lit(1))
    both = side(train, "a").join(side(test, "b"), ["id", "v"], "outer")
    return both.groupBy("id").agg(F.count("a").alias("in_train"), F.count("b").alias("in_test"), F.count(F.col("a") + F.col("b")).alias("in_both"))


def sign_consistency(coefficients: DataFrame, feature: str, models: list[str]) -> DataFrame:
    """Signs of each feature's coefficients in several models; stable: all non-zero and equal; flip: two differ."""
    from ..functions.scalars import sign_of

    signs = F.array(*[sign_of(F.coalesce(F.col(m), F.lit(0.0))) for m in models])
    set_ = F.array_distinct(F.filter(signs, lambda s: s != "0"))
    full = F.size(F.filter(signs, lambda s: s != "0")) == len(models)
    return coefficients.select(
        feature, *[sign_of(F.coalesce(F.col(m), F.lit(0.0))).alias(f"sign_{m}") for m in models], (full & (F.size(set_) <= 1)).cast("int").alias("sign_stable"), (F.size(set_) > 1).cast("int").alias("sign_flip"),
    )


def random_rankings(df: DataFrame, group: str, key: str, label: str, seeds: int) -> DataFrame:
    """(seed, groups, recall_at_1, recall_at_3, mrr) of rankings drawn at random within each group."""
    from .statistics import shuffled

    drawn = df.select(group, key, label, F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed")).withColumn("u", shuffled(F.col(key), F.col("seed")))
    w = Window.partitionBy("seed", group).orderBy("u", key)
    best = drawn.withColumn("r", F.row_number().over(w)).where(F.col(label) == 1).groupBy("seed", group).agg(F.min("r").alias("best"))
    return best.groupBy("seed").agg(F.count("*").alias("groups"), *[F.avg((F.col("best") <= k).cast("double")).alias(f"recall_at_{k}") for k in (1, 3)], F.avg(1 / F.col("best")).alias("mrr"))


def permuted_labels(df: DataFrame, key: str, label: str, seeds: int) -> DataFrame:
    """df with `seed` and `permuted`: per seed the labels dealt anew, by giving the row at each place of one random order
    the label at the same place of another."""
    from .statistics import shuffled

    n = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed"))
    place = lambda salt: F.row_number().over(Window.partitionBy("seed").orderBy(shuffled(F.concat(F.lit(salt), F.col(key).cast("string")), F.col("seed")), key))
    rows = n.withColumn("at", place("row"))
    dealt = n.select("seed", F.col(label).alias("permuted"), place("label").alias("at"))
    return rows.join(dealt, ["seed", "at"]).drop("at")
