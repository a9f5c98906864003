"""Ranks, top-k, gaps and label collapsing. Every order has an explicit tie-break."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut

BLOCK = 2048


def rank_first(df: DataFrame, group: list[str], score: str, ties: list[str], name: str = "rank") -> DataFrame:
    """1..n by falling score within the group, nulls last, ties by the given columns."""
    w = Window.partitionBy(*group).orderBy(F.col(score).desc_nulls_last(), *ties)
    return df.withColumn(name, F.row_number().over(w))


def top_k(df: DataFrame, group: list[str], score: str, ties: list[str], k: int, name: str = "rank") -> DataFrame:
    return rank_first(df, group, score, ties, name).where(F.col(name) <= k)


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64)


def _block_cosines(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The k best rows of one block for each query of another, by falling cosine, rounded to 9 places, and vec_id."""
    out: list[tuple] = []
    if len(queries) and len(rows):
        q, e = _vectors(queries["embedding"]), _vectors(rows["embedding"])
        lengths = np.maximum(np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(e, axis=1)), 1e-12)
        scores, ids = np.round(q @ e.T / lengths, 9), rows["vec_id"].to_numpy()
        for query, s in zip(queries["vec_id"].to_pylist(), scores, strict=True):
            s = np.where(ids == query, -np.inf, s)
            least = np.partition(s, -k)[-k] if len(s) > k else -np.inf
            at = np.flatnonzero((s >= least) & (ids != query))
            out += [(query, int(ids[i]), float(s[i])) for i in at[np.lexsort((ids[at], -s[at]))][:k]]
    names = ("query", "vec_id", "s")
    return pa.table({n: pa.array([x[i] for x in out], pa.float64() if n == "s" else pa.int64()) for i, n in enumerate(names)})


def nearest_by_cosine(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """queries, rows (vec_id, embedding) -> (query, vec_id, s, rank): each query's k best other rows by cosine.

    Every block of queries meets every block of rows in a task of its own, which hands on k rows a query.
    """
    nq, nr = (max(1, -(-d.count() // BLOCK)) for d in (queries, rows))
    side = lambda d, own, n, other, m: d.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias(other))
    q, r = side(queries, "qb", nq, "rb", nr), side(rows, "rb", nr, "qb", nq)
    found = q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInArrow(lambda a, b: _block_cosines(a, b, k), "query long, vec_id long, s double")
    return top_k(found, ["query"], "s", ["vec_id"], k)


def average_rank(value: str, group: list[str] | None = None, descending: bool = False) -> Column:
    """Mean rank of ties, as pandas' rank(method="average")."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    part = [F.col(g) for g in group or []] or [F.lit(1)]
    return F.rank().over(Window.partitionBy(*part).orderBy(order)) + (F.count(F.lit(1)).over(Window.partitionBy(*part, F.col(value))) - 1) / 2


def running_before(df: DataFrame, order: str, column: str, name: str) -> DataFrame:
    """df with the sum of `column` over all rows before, by `order`: a range shuffle, kept so that its cuts hold for both
    steps, sums within each part, and each part's start, of which the driver only sees one total a part."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = cut(df.repartitionByRange(n, order).withColumn("part__", F.spark_partition_id()))
    starts, at = [], 0
    for r in local.groupBy("part__").agg(F.sum(column).alias("n")).orderBy("part__").collect():
        starts.append((r["part__"], at))
        at += r["n"] or 0
    begin = df.sparkSession.createDataFrame(starts or [(0, 0)], "part__ int, begin__ long")
    before = F.sum(column).over(Window.partitionBy("part__").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return local.withColumn("own__", F.coalesce(before, F.lit(0))).join(F.broadcast(begin), "part__").withColumn(name, F.col("begin__") + F.col("own__")).drop("part__", "begin__", "own__")


def distributed_average_rank(df: DataFrame, value: str, name: str = "avg_rank") -> DataFrame:
    """Average ranks over the whole table, from the counts of its distinct values."""
    counts = running_before(df.groupBy(value).agg(F.count("*").alias("ties__")), value, "ties__", "before__")
    return df.join(counts.withColumn(name, F.col("before__") + (F.col("ties__") + 1) / 2).drop("ties__", "before__"), value)


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("r__", F.row_number().over(w)).where("r__ = 1").drop("r__")


def collapse_labels(df: DataFrame, label: str, k: int, other: str = "OTHER") -> DataFrame:
    """Labels beyond the k most frequent (ties by name) become `other`."""
    top = df.groupBy(label).agg(F.count("*").alias("n__")).orderBy(F.desc("n__"), label).limit(k).select(F.col(label).alias("top__"))
    return df.join(F.broadcast(top), df[label] == F.col("top__"), "left").withColumn(label, F.coalesce("top__", F.lit(other))).drop("top__")


def largest_gap(scores: DataFrame, score: str, top: int = 50, low: float = 0.60, high: float = 0.95, default: float = 0.90) -> DataFrame:
    """One row: the middle of the widest gap among the `top` highest scores, clipped, rounded to 2 digits."""
    best = scores.where(F.col(score).isNotNull()).orderBy(F.desc(score)).limit(top)
    w = Window.orderBy(F.desc(score))
    gaps = best.select(F.col(score).alias("s"), F.lead(score).over(w).alias("next")).withColumn("gap", F.col("s") - F.col("next"))
    widest = F.max_by((F.col("s") + F.col("next")) / 2, F.struct("gap", "s"))
    return gaps.where("gap is not null").agg(F.coalesce(F.round(F.least(F.greatest(widest, F.lit(low)), F.lit(high)), 2), F.lit(default)).alias("threshold"))


def distributed_row_number(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with 1..n over the whole table: a range shuffle, kept so that its cuts hold for both steps, numbers within each
    partition, and each partition's start, of which the driver only sees one count a partition."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("id__", F.monotonically_increasing_id())
    local = cut(local.withColumns({"part__": F.shiftright("id__", 33), "row__": F.col("id__").bitwiseAND(F.lit((1 << 33) - 1))}))
    starts, at = [], 0
    for r in local.groupBy("part__").agg(F.count("*").alias("n")).orderBy("part__").collect():
        starts.append((r["part__"], at))
        at += r["n"]
    begin = df.sparkSession.createDataFrame(starts or [(0, 0)], "part__ long, begin__ long")
    return local.join(F.broadcast(begin), "part__").withColumn(name, F.col("begin__") + F.col("row__") + 1).drop("id__", "part__", "row__", "begin__")
