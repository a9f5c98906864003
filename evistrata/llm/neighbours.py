"""Approximate nearest neighbours from low-dimensional stable projections.

Vectors are projected to PROJECTED dimensions by a fixed Gaussian (2-stable) matrix. Equal vectors are one point that
carries its smallest ids. A kd-tree's upper levels, cut on a bounded sample (at most SAMPLE points), deal all points
into cells; each cell builds the lower levels over its own projections. A query first searches its home cell, then only
those cells whose projected box the stopping test can't rule out. A search visits leaves in the order of projected
distance and verifies their points on the original vectors. For a point at distance d, its squared projected distance
over d * d follows a chi-square law, so the search stops once an unseen point as near as the current k-th would have
shown up with probability STOP. Cells asked by more than CHUNK queries are searched in several tasks.

Defined cases: null or zero vectors and those with null or non-finite components take no part, as query or candidate;
vectors meet only those of their own length; repeated rows of one vec_id and vector count once; ties go to the smaller
vec_id; fewer candidates than k: all of them; null vec_id takes no part; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep

PROJECTED = 8  # even, for the closed chi-square form
LEAF = 32
BLOCK = 16_384  # points of a cell, about; more beyond SAMPLE / PER_CELL cells
SAMPLE = 1 << 17
PER_CELL = 16  # sampled points of a cell, at least
CHUNK = 2048
STOP = 0.98
SEED = 42


def chi_square(x: np.ndarray | float, m: int) -> np.ndarray:
    """Distribution function for an even number m of degrees of freedom."""
    h = np.asarray(x, dtype=float) / 2
    term, total = np.ones_like(h), np.ones_like(h)
    for i in range(1, m // 2):
        term = term * h / i
        total = total + term
    return 1 - np.exp(-h) * total


def leaves(points: np.ndarray) -> list[np.ndarray]:
    """Index sets of a kd-tree's leaves: median cuts along the widest side."""
    todo, out = [np.arange(len(points))], []
    while todo:
        i = todo.pop()
        if len(i) <= LEAF:
            out.append(i)
            continue
        p = points[i]
        order = np.argsort(p[:, np.argmax(np.ptp(p, axis=0))], kind="stable")
        todo += [i[order[: len(i) // 2]], i[order[len(i) // 2 :]]]
    return out


def projection(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, PROJECTED))


def cell_cuts(sample: np.ndarray, cells: int) -> list[tuple[int, float]]:
    """Median cuts (axis, value) of a complete binary tree with at least `cells` leaves, in heap order."""
    depth = max(0, math.ceil(math.log2(cells)))
    cuts, level = [], [np.arange(len(sample))]
    for _ in range(depth):
        below = []
        for i in level:
            p = sample[i]
            axis = int(np.argmax(np.ptp(p, axis=0))) if len(p) else 0
            value = float(np.median(p[:, axis])) if len(p) else 0.0
            cuts.append((axis, value))
            below += [i[p[:, axis] <= value], i[p[:, axis] > value]]
        level = below
    return cuts


def cell_of(projected: np.ndarray, cuts: list[tuple[int, float]]) -> np.ndarray:
    at = np.zeros(len(projected), dtype=np.int64)
    axis, value = np.array([c[0] for c in cuts], dtype=np.int64), np.array([c[1] for c in cuts])
    for _ in range((len(cuts) + 1).bit_length() - 1):
        at = 2 * at + 1 + (projected[np.arange(len(at)), axis[at]] > value[at])
    return at - len(cuts)


class Index:
    """kd-tree over the projections of points; `ids` order points at equal distance."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.vectors, self.ids = vectors, ids
        self.matrix = projection(vectors.shape[1])
        projected = vectors @ self.matrix
        self.leaves = leaves(projected)
        self.low = np.array([projected[i].min(0) for i in self.leaves])
        self.high = np.array([projected[i].max(0) for i in self.leaves])

    def search(self, query: np.ndarray, k: int, stop: float = STOP, worst: float = math.inf) -> tuple[np.ndarray, np.ndarray]:
        """Indices and squared distances of the k nearest found, by (distance, id); `worst`: a k-th distance, squared,
        that is known already, beyond which nothing is looked for."""
        at = query @ self.matrix
        bound = box_distance(at, self.low, self.high)
        order = np.argsort(bound, kind="stable")
        found, dist = np.zeros(0, dtype=np.int64), np.zeros(0)
        step, seen = 4, 0
        while seen < len(order):
            if ruled_out(bound[order[seen]], worst, stop):
                break
            new = np.concatenate([self.leaves[j] for j in order[seen : seen + step]])
            diff = self.vectors[new] - query
            found, dist = np.r_[found, new], np.r_[dist, (diff * diff).sum(axis=1)]
            best = np.lexsort((self.ids[found], dist))[:k]
            found, dist = found[best], dist[best]
            if len(found) >= k:
                worst = min(worst, float(dist[k - 1]))
            seen += step
        return found, dist


def box_distance(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances from a projected point to boxes."""
    gap = np.maximum(np.maximum(low - at, at - high), 0)
    return (gap * gap).sum(axis=1)


def ruled_out(bound: np.ndarray | float, worst: float, stop: float) -> np.ndarray | bool:
    """Whether points whose squared projected distance is at least `bound` can be passed over."""
    if worst == math.inf:
        return np.zeros_like(bound, dtype=bool)
    return np.asarray(bound) > 0 if worst == 0 else chi_square(np.asarray(bound) / worst, PROJECTED) >= stop


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = pa.concat_arrays([c.flatten() for c in chunks]) if chunks else pa.array([], pa.float64())
    return np.asarray(flat, dtype=float).reshape(-1, dim)


def _projected(batches: Iterator[pa.RecordBatch], cuts: dict[int, list]) -> Iterator[pa.RecordBatch]:
    """Rows (ids, v, dim) with their projection and cell; the rows of a batch may differ in length."""
    for b in batches:
        dims = np.asarray(b["dim"])
        for dim in np.unique(dims).tolist():
            part = b.filter(pa.array(dims == dim))
            p = _matrix(part["v"], dim) @ projection(dim)
            cell = cell_of(p, cuts.get(dim, []))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(p), pa.list_(pa.float64())), pa.array(cell)], names=[*part.schema.names, "p", "cell"])


FOUND = "rep long, vec_id long, score double"


def _answers(points: pa.Table, asked: pa.Table, k: int, stop: float) -> pa.Table:
    """The k + 1 nearest ids of one cell for each query (rep, qv, worst)."""
    reps, got, scores = [], [], []
    if points.num_rows and asked.num_rows:
        dim, ids = points["dim"][0].as_py(), points["ids"].to_pylist()
        index = Index(_matrix(points["v"], dim), np.array([i[0] for i in ids]))
        for rep, q, worst in zip(asked["rep"].to_pylist(), _matrix(asked["qv"], dim), asked["worst"].to_pylist(), strict=True):
            found, dist = index.search(q, k + 1, stop, worst)
            flat = sorted((d, i) for p, d in zip(found.tolist(), np.sqrt(dist).tolist(), strict=True) for i in ids[p])[: k + 1]
            reps += [rep] * len(flat)
            got += [i for _, i in flat]
            scores += [d for d, _ in flat]
    return pa.table([pa.array(reps, pa.int64()), pa.array(got, pa.int64()), pa.array(scores, pa.float64())], names=["rep", "vec_id", "score"])


def _searched(points: DataFrame, asked: DataFrame, k: int, stop: float) -> DataFrame:
    """points(dim, cell, ids, v), asked(dim, cell, rep, v, worst) -> FOUND. Cells (a bounded number) asked by more than
    CHUNK queries are sent to several tasks."""
    load = asked.groupBy("dim", "cell").agg(F.ceil(F.count("*") / CHUNK).alias("parts"))
    parts = points.sparkSession.createDataFrame(load.collect(), "dim int, cell long, parts long")
    asked = asked.join(F.broadcast(parts), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
    dealt = points.select("dim", "cell", "ids", "v").join(F.broadcast(parts), ["dim", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    asked = asked.select(F.col("dim").alias("qdim"), F.col("cell").alias("qcell"), F.col("part").alias("qpart"), "rep", F.col("v").alias("qv"), "worst")
    return dealt.groupBy("dim", "cell", "part").cogroup(asked.groupBy("qdim", "qcell", "qpart")).applyInArrow(lambda a, b: _answers(a, b, k, stop), FOUND)


def nearest(vectors: DataFrame, is_query, k: int = 10, stop: float = STOP, block: int = BLOCK) -> DataFrame:
    """vectors(vec_id, embedding) -> query_id, rank, vec_id, score for the rows that is_query selects."""
    spark = vectors.sparkSession
    raw = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and size(v) > 0")
    big = F.lit(float("inf"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists("v", lambda x: x != 0)
    rows = raw.where(F.coalesce(sound, F.lit(False)))
    first = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    merged = keep(first.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "ids", "v", F.size("v").alias("dim"), F.xxhash64("v").alias("h")))
    wanted = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "v", F.xxhash64("v").alias("h"))
    wanted = keep(wanted.join(merged.select("rep", "h", F.col("v").alias("pv")), "h").where(F.col("v") == F.col("pv")).select("query_id", "rep").distinct())

    sizes = {r["dim"]: r["n"] for r in merged.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    total = max(1, sum(sizes.values()))
    picked: dict[int, list] = {}
    for r in merged.where(F.pmod("h", F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, SAMPLE / total)))).select("dim", "v").limit(2 * SAMPLE).collect():
        picked.setdefault(r["dim"], []).append(np.asarray(r["v"]) @ projection(r["dim"]))
    cells = {d: max(1, min(math.ceil(sizes[d] / block), len(p) // PER_CELL)) for d, p in picked.items()}
    cuts = {d: cell_cuts(np.array(p), cells[d]) for d, p in picked.items() if cells[d] > 1}
    schema = T.StructType([*merged.schema.fields, T.StructField("p", T.ArrayType(T.DoubleType())), T.StructField("cell", T.LongType())])
    points = keep(merged.mapInArrow(lambda it: _projected(it, cuts), schema))
    sides = [f(F.get("p", F.lit(i))).alias(f"{n}{i}") for n, f in (("low", F.min), ("high", F.max)) for i in range(PROJECTED)]
    boxes: dict[int, list] = {}
    for r in points.groupBy("dim", "cell").agg(*sides).collect():
        boxes.setdefault(r["dim"], []).append((r["cell"], *r[2:]))

    queries = points.join(wanted.select("rep").distinct(), "rep").select("rep", "v", "dim", "p", "cell")
    home = keep(_searched(points, queries.withColumn("worst", F.lit(math.inf)), k, stop))
    # The (k + 1)-th distance of the home cell, the query's own place included.
    reach = home.groupBy("rep").agg(F.when(F.count("*") > k, F.max("score")).alias("far"))
    ready = keep(queries.join(reach, "rep").select("rep", "v", "dim", "p", F.col("cell").alias("home"), F.coalesce(F.col("far") * F.col("far"), F.lit(math.inf)).alias("worst")))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {d: (np.array([r[0] for r in rows_]), np.array([r[1:] for r in rows_]).reshape(-1, 2, PROJECTED)) for d, rows_ in boxes.items()}
        for b in batches:
            out = []
            for dim, p, own, worst in zip(b["dim"].to_pylist(), b["p"], b["home"].to_pylist(), b["worst"].to_pylist(), strict=True):
                cell, box = tables[dim]
                bound = box_distance(np.asarray(p.values), box[:, 0], box[:, 1])
                out.append(cell[~ruled_out(bound, worst, stop) & (cell != own)])
            yield pa.RecordBatch.from_arrays([b["rep"], b["v"], b["dim"], b["worst"], pa.array(out, pa.list_(pa.int64()))], names=["rep", "v", "dim", "worst", "cells"])

    further = ready.mapInArrow(others, "rep long, v array<double>, dim int, worst double, cells array<long>").select("dim", F.explode("cells").alias("cell"), "rep", "v", "worst")
    more = _searched(points, keep(further), k, stop)
    best = home.union(more).withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("score", "vec_id"))).where(F.col("r") <= k + 1)
    lists = best.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
    mine = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = wanted.join(lists, "rep").select("query_id", F.posexplode(mine).alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op9_stable_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
