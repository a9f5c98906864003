"""Selections, extremes and report rows. Every order has an explicit tie-break."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranking
from .statistics import shuffled


def convergent(df: DataFrame, methods: tuple[str, str], fdr: float, least: int, positive_es: bool = True) -> DataFrame:
    """Modules of at least `least` genes that both methods find enriched (padj_, NES_, ES_ of each), with the smaller and
    the mean NES."""
    ok = F.col("module_size") >= least
    for m in methods:
        ok = ok & (F.col(f"padj_{m}") <= fdr) & (F.col(f"NES_{m}") > 0)
        if positive_es:
            ok = ok & (F.col(f"ES_{m}") > 0)
    a, b = (F.col(f"NES_{m}") for m in methods)
    return df.where(ok).withColumns({"convergence_min_nes": F.least(a, b), "convergence_mean_nes": (a + b) / 2})


def existing(df: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """The candidates that df has, in their order."""
    return df.select(*[c for c in candidates if c in df.columns])


def split_valid(df: DataFrame, key: str, valid: DataFrame, valid_key: str) -> DataFrame:
    """df with `valid`: whether its key is among the valid ones."""
    v = valid.select(F.col(valid_key).alias("v__")).distinct().withColumn("hit__", F.lit(True))
    return df.join(v, df[key] == F.col("v__"), "left").withColumn("valid", F.coalesce("hit__", F.lit(False))).drop("v__", "hit__")


def sampled(df: DataFrame, group: list[str], key: str, most: int, seed: int = 42) -> DataFrame:
    """At most `most` rows of each group, drawn without replacement by a seeded order of the key."""
    w = Window.partitionBy(*group).orderBy(shuffled(F.col(key), F.lit(seed)), key)
    return df.withColumn("r__", F.row_number().over(w)).where(F.col("r__") <= most).drop("r__")


def specific_only(df: DataFrame, key: str, specific: str, general: str, count: str, least: int = 5, top: float = 0.05, floor: float = 0.5) -> DataFrame:
    """Rows with enough contexts that rank in the top share by `specific` and outside the `floor` share by `general`
    (average ranks, highest first, over all rows)."""
    n = df.agg(F.count("*").alias("n__"))
    out = df
    for c in (specific, general):
        out = ranking.distributed_average_rank(out, c, f"up__{c}")
    out = out.join(F.broadcast(n))
    pct = lambda c: (F.col("n__") + 1 - F.col(f"up__{c}")) / F.col("n__")
    out = out.withColumns({f"pct_{specific}": pct(specific), f"pct_{general}": pct(general)})
    return out.where((F.col(count) >= least) & (F.col(f"pct_{specific}") <= top) & (F.col(f"pct_{general}") >= floor)).select(*df.columns, f"pct_{specific}", f"pct_{general}")


def worth_labelling(x: Column, y: Column) -> Column:
    """Clearly higher in the specific model, or very high in both."""
    return ((x - y > 0.1) & (x > 0.5)) | ((x > 0.8) & (y > 0.8))


# Names of run modes and what they stand for.
MODES = {"all": ("none", "full", "pca"), "all_plus_residual": ("none", "full", "pca", "residual_pca"), "score_modifier_pca": ("baseline_then_pca",)}


def resolve_modes(mode: str) -> tuple[str, ...]:
    return MODES.get(mode, (mode,))


def both_ends(df: DataFrame, score: str, key: str, most: int, least: int) -> DataFrame:
    """`most` highest, then `least` lowest rows not among them, with `place` in that order (an ordered union)."""
    hi = df.withColumn("side__", F.lit(0)).orderBy(F.desc(score), key).limit(most)
    lo = df.withColumn("side__", F.lit(1)).orderBy(F.asc(score), key).limit(least)
    rank = lambda d, order: d.withColumn("r__", F.row_number().over(Window.partitionBy("side__").orderBy(order, key)))
    rows = rank(hi, F.desc(score)).union(rank(lo, F.asc(score)))
    first = rows.withColumn("n__", F.row_number().over(Window.partitionBy(key).orderBy("side__", "r__"))).where("n__ = 1")
    return first.withColumn("place", F.row_number().over(Window.orderBy("side__", "r__"))).drop("side__", "r__", "n__")


def significant_or_head(df: DataFrame, group: list[str], p: str, ties: list[str], alpha: float, n: int) -> DataFrame:
    """Up to n rows of each group with p <= alpha, lowest first; where a group has none, its n lowest."""
    some = F.max(F.when(F.col(p) <= alpha, 1).otherwise(0)).over(Window.partitionBy(*group))
    rows = df.withColumn("some__", some).where((F.col("some__") == 0) | (F.col(p) <= alpha))
    w = Window.partitionBy(*group).orderBy(F.col(p).asc_nulls_last(), *ties)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).drop("some__")


def group_term_matrix(df: DataFrame, group: str, term: str, fdr: str, best: int, floor: float = 1e-300) -> DataFrame:
    """(group, term, weight) over all groups and the union of each group's `best` terms; -log10 of the FDR, 1 if missing."""
    w = Window.partitionBy(group).orderBy(fdr, term)
    terms = df.withColumn("r__", F.row_number().over(w)).where(F.col("r__") <= best).select(term).distinct()
    cells = df.select(group).distinct().crossJoin(terms)
    low = df.groupBy(group, term).agg(F.min(fdr).alias("fdr__"))
    weight = -F.log10(F.least(F.greatest(F.coalesce("fdr__", F.lit(1.0)), F.lit(floor)), F.lit(1.0)))
    return cells.join(low, [group, term], "left").select(group, term, weight.alias("weight"))


def node_cap(edges: int, caps: Sequence[int] = (55, 45, 35), limits: Sequence[int] = (850, 1200)) -> int:
    """How many nodes a drawing takes: fewer the more edges they induce."""
    return caps[sum(edges > m for m in limits)]


def distribution(df: DataFrame, value: str, name: str = "") -> list[Column]:
    """Mean, sample deviation (null for fewer than two), extremes and median of the finite values, as aggregates."""
    x = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.col(value))
    return [F.avg(x).alias(f"{name}mean"), F.when(F.count(x) > 1, F.stddev_samp(x)).alias(f"{name}std"), F.min(x).alias(f"{name}min"), F.percentile(x, 0.5).alias(f"{name}median"), F.max(x).alias(f"{name}max")]


def histogram_json(df: DataFrame, value: str) -> Column:
    """Aggregate over (value, n) rows: a JSON object of counts, by value."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(value).alias("v"), F.col("n").alias("n"))))
    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: F.concat(F.lit('"'), p["v"].cast("string"), F.lit('": '), p["n"].cast("string"))), ", "), F.lit("}"))


def fold_audit(pred: DataFrame) -> DataFrame:
    """pred(fold, locus, gene, label, score, rank) -> one row per (fold, locus): candidates, positives of the fold and the
    locus, best two scores and their gap."""
    order = Window.partitionBy("fold", "locus").orderBy(F.desc("score"), "gene")
    rows = pred.withColumn("r__", F.row_number().over(order))
    at = lambda i, c: F.max(F.when(F.col("r__") == i, F.col(c)))
    item = F.concat(F.col("gene").cast("string"), F.lit("(locus="), F.col("locus").cast("string"), F.lit(", rank="), F.col("rank").cast("string"), F.lit(")"))
    listing = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("label") == 1, F.struct("locus", "rank", "gene", item.alias("s"))))), lambda x: x["s"]), "; ")
    per = rows.groupBy("fold", "locus").agg(F.count("*").alias("n_candidates"), listing.alias("positives"), at(1, "gene").alias("top1_gene"), at(1, "score").alias("top1_score"), at(1, "label").alias("top1_is_positive"), at(2, "score").alias("top2_score"))
    folds = pred.groupBy("fold").agg(F.countDistinct("locus").alias("n_loci"), F.sum("label").alias("n_positive_rows"), F.countDistinct(F.when(F.col("label") == 1, F.col("gene"))).alias("n_positive_genes"))
    return per.join(folds, "fold").withColumn("gap", F.col("top1_score") - F.col("top2_score"))


def lead_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """before, after (locus, gene, rank) -> per locus the leading gene of both, the old rank of the new leader, the new
    rank of the old one, and whether the lead changed."""
    lead = lambda d, n: d.where("rank = 1").select("locus", F.col("gene").alias(n))
    both = lead(before, "lead").join(lead(after, "promoted"), "locus")
    old = before.select("locus", F.col("gene").alias("promoted"), F.col("rank").alias("promoted_was"))
    new = after.select("locus", F.col("gene").alias("lead"), F.col("rank").alias("lead_is"))
    out = both.join(old, ["locus", "promoted"], "left").join(new, ["locus", "lead"], "left")
    return out.select("locus", "lead", "promoted", "promoted_was", "lead_is", (F.col("lead") != F.col("promoted")).cast("int").alias("replaced"))
