"""Graph operators on edge tables. Iterations cut their lineage with reliable checkpoints."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CUT_EVERY = 3


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed to the session's shared folder. Where none is set, a temporary one on a single machine only."""
    spark: SparkSession = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        root = sc.getConf().get("spark.checkpoint.dir", None)
        if root is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(root or tempfile.mkdtemp(prefix="evistrata-"))
    return df.checkpoint()


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, w) without loops, one row per unordered pair with its largest weight -> both directions (src, dst, w)."""
    one = edges.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("w").alias("w"))
    return one.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").union(one.select(F.col("b").alias("src"), F.col("a").alias("dst"), "w"))


def transitions(edges: DataFrame) -> DataFrame:
    """(src, dst, p): weights divided by the row sum."""
    sums = edges.groupBy("src").agg(F.sum("w").alias("total"))
    return edges.join(sums, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p"))


def personalized_pagerank(moves: DataFrame, seeds: DataFrame, alpha: float = 0.85, iterations: int = 100, tolerance: float = 1e-9) -> DataFrame:
    """moves(src, dst, p) or Hubs, seeds(run_id, node) -> (run_id, node, score): all runs advance together.

    Seeds off the graph are ignored; a run without seeds has no rows. Nodes without a row have score 0. Ends when no
    run's scores move by more than `tolerance` in sum, or after `iterations`.
    """
    from .hubs import Hubs

    if isinstance(moves, Hubs):
        return moves.pagerank(seeds, alpha, iterations, tolerance)
    nodes = moves.select(F.col("src").alias("node")).distinct()
    on = seeds.distinct().join(nodes, "node", "left_semi")
    start = cut(on.join(on.groupBy("run_id").agg(F.count("*").alias("n")), "run_id").select("run_id", "node", (1 / F.col("n")).alias("s")))
    x = start.withColumnRenamed("s", "score")
    for i in range(iterations):
        spread = x.join(moves, x.node == moves.src).select("run_id", F.col("dst").alias("node"), (F.col("score") * F.col("p") * alpha).alias("score"))
        new = spread.union(start.select("run_id", "node", (F.col("s") * (1 - alpha)).alias("score"))).groupBy("run_id", "node").agg(F.sum("score").alias("score"))
        if i % CUT_EVERY == CUT_EVERY - 1:
            new = cut(new)
            if tolerance:
                old = x.select("run_id", "node", F.col("score").alias("was"))
                moved = new.join(old, ["run_id", "node"], "outer").groupBy("run_id").agg(F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("was", F.lit(0.0)))).alias("d")).agg(F.max("d")).first()[0]
                if moved is None or moved <= tolerance:
                    return new
        x = new
    return x


def distances(edges: DataFrame, targets: DataFrame, most: int = 1 << 30) -> DataFrame:
    """edges(src, dst), targets(node) -> (node, distance) of every node that reaches a target."""
    seen = cut(targets.select("node").distinct().withColumn("distance", F.lit(0)))
    frontier, d = seen, 0
    while d < most:
        d += 1
        step = edges.join(frontier, edges.dst == frontier.node).select(F.col("src").alias("node")).distinct()
        frontier = cut(step.join(seen, "node", "left_anti").withColumn("distance", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = cut(seen.union(frontier))
    return seen


def components(edges: DataFrame) -> DataFrame:
    """edges(src, dst) in both directions -> (node, component): the smallest node it is connected to.

    Each round takes the least label around a node and then that label's own label, so depth halves.
    """
    labels = cut(edges.select(F.col("src").alias("node")).distinct().withColumn("component", F.col("node")))
    while True:
        near = edges.join(labels, edges.dst == labels.node).select(F.col("src").alias("node"), "component").union(labels)
        least = near.groupBy("node").agg(F.min("component").alias("component"))
        jump = least.select(F.col("node").alias("component"), F.col("component").alias("far"))
        new = cut(least.join(jump, "component", "left").select("node", F.coalesce("far", "component").alias("component")))
        if new.join(labels, ["node", "component"], "left_anti").isEmpty():
            return new
        labels = new


def background_normalized(scores: DataFrame, background: DataFrame) -> DataFrame:
    """(node, log_ratio): ln(score) - ln(background) on the background's nodes, each of which must have both, positive."""
    from .joins import aligned

    out = aligned(scores, background, "node", "score")
    return out.select("node", (F.ln("score") - F.ln("reference")).alias("log_ratio"))


def select_seeds(rows: DataFrame, node: str, by: str, threshold: float) -> DataFrame:
    """Distinct nodes of rows whose column `by` (a label, a score or evidence; missing counts as 0) reaches the threshold."""
    return rows.where(F.coalesce(F.col(by).cast("double"), F.lit(0.0)) >= threshold).select(F.col(node).alias("node")).distinct()


def map_seeds(seeds: DataFrame, gene: str, nodes: DataFrame, source: str) -> DataFrame:
    """seeds(gene), blanks and repeats allowed -> node, source, status: missing_gene_id, mapped or unmapped, one row each."""
    from ..functions.scalars import blank_to_null

    rows = seeds.select(blank_to_null(F.col(gene)).alias("gene")).distinct()
    known = nodes.select(F.col("node").cast("string").alias("n__")).distinct()
    out = rows.join(known, rows.gene == known.n__, "left")
    status = F.when(F.col("gene").isNull(), "missing_gene_id").when(F.col("n__").isNotNull(), "mapped").otherwise("unmapped")
    return out.select(F.col("gene").alias("node"), F.lit(source).alias("source"), status.alias("status"))


def scored(rows: DataFrame, node: str, scores: DataFrame, default: float = 0.0) -> DataFrame:
    """rows with `score` from scores(node, score), else the default."""
    s = scores.select(F.col("node").alias("n__"), F.col("score").alias("s__"))
    return rows.join(s, rows[node] == s.n__, "left").withColumn("score", F.coalesce("s__", F.lit(default))).drop("n__", "s__")


def seeded_pagerank(moves: DataFrame, seeds: DataFrame, alpha: float = 0.85, iterations: int = 500, tolerance: float = 1e-9) -> DataFrame:
    """personalized_pagerank that refuses a run without any seed on the graph."""
    nodes = moves.select(F.col("src").alias("node")).distinct()
    asked = seeds.groupBy("run_id").agg(F.count("*").alias("n")).count()
    if not asked or seeds.join(nodes, "node", "left_semi").select("run_id").distinct().count() < asked:
        raise ValueError("a run has no seed on the graph")
    return personalized_pagerank(moves, seeds, alpha, iterations, tolerance)


def fold_scores(moves: DataFrame, rows: DataFrame, fold: str, node: str, label: str, **options) -> DataFrame:
    """rows with `network_score`: for each fold, propagated from the positives of the other folds only; 0 off the graph.

    All folds are runs of one propagation.
    """
    folds = rows.select(F.col(fold).alias("run_id")).distinct()
    positives = rows.where(F.col(label) == 1).select(F.col(fold).alias("f"), F.col(node).alias("node")).distinct()
    own = positives.withColumnRenamed("f", "run_id").distinct()
    # A gene that is positive in the fold as well is no seed: its label is to be predicted there.
    seeds = folds.join(F.broadcast(positives), F.col("run_id") != F.col("f")).select("run_id", "node").distinct().join(own, ["run_id", "node"], "left_anti")
    s = personalized_pagerank(moves, seeds, **options).select("run_id", F.col("node").alias("n__"), F.col("score").alias("s__"))
    out = rows.join(s, (rows[fold] == s.run_id) & (rows[node] == s.n__), "left")
    return out.select(*rows.columns, F.coalesce("s__", F.lit(0.0)).alias("network_score"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges (src, dst, ...) with both ends among nodes(node)."""
    n = nodes.select("node").distinct()
    return edges.join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi").select(*edges.columns)


def component_sizes(labels: DataFrame) -> DataFrame:
    """labels(node, component) -> component, size, place (largest first, ties by component) and share of all nodes."""
    from .ranking import rank_first

    sizes = labels.groupBy("component").agg(F.count("*").alias("size")).withColumn("all__", F.lit(1))
    total = labels.agg(F.count("*").alias("n__"))
    out = rank_first(sizes, ["all__"], "size", ["component"], "place").join(F.broadcast(total))
    return out.select("component", "size", "place", (F.col("size") / F.col("n__")).alias("share"))


DENSE_NODES = 8192


def _merged(src, dst, w, n: int, total: float) -> list[int]:
    """The community, named by its smallest node, of each of n nodes: edges are given in both directions."""
    import numpy as np

    label = np.arange(n)
    if n > DENSE_NODES:  # rows as dictionaries, all pairs looked at for every merge
        weight: dict[int, dict[int, float]] = {i: {} for i in range(n)}
        for a, b, x in zip(src.tolist(), dst.tolist(), w.tolist(), strict=True):
            weight[a][b] = x
        degree = {i: sum(x.values()) for i, x in weight.items()}
        while True:
            gains = [(2 * (x / total - degree[a] * degree[b] / total**2), -a, -b) for a, near in weight.items() for b, x in near.items() if a < b]
            best = max(gains, default=(0.0, 0, 0))
            if best[0] <= 1e-12:
                return label.tolist()
            a, b = -best[1], -best[2]
            for c, x in weight.pop(b).items():
                del weight[c][b]
                if c != a:
                    weight[a][c] = weight[c][a] = weight[a].get(c, 0.0) + x
            degree[a] += degree.pop(b)
            label[label == b] = a
    m = np.zeros((n, n))
    m[src, dst] = w
    d = m.sum(axis=1)

    def gain(r: np.ndarray) -> np.ndarray:
        """Of every pair (r, larger node) that is tied."""
        g = 2 * (m[r] / total - d[r][:, None] * d / total**2)
        g[(m[r] <= 0) | (np.arange(n) <= r[:, None])] = -np.inf
        return g

    best, to = np.full(n, -np.inf), np.zeros(n, dtype=np.int64)

    def renew(rows: np.ndarray) -> None:
        for r in np.array_split(rows, len(rows) // 512 + 1):
            g = gain(r)
            to[r] = g.argmax(axis=1)
            best[r] = g[np.arange(len(r)), to[r]]

    renew(np.arange(n))
    while n:
        a = int(best.argmax())
        if best[a] <= 1e-12:
            break
        b = int(to[a])
        m[a] += m[b]
        m[:, a] = m[a]
        m[a, a] = 0.0
        m[b] = m[:, b] = 0.0
        d[a] += d[b]
        label[label == b] = a
        best[b] = -np.inf
        lost = np.flatnonzero(((to == a) | (to == b)) & (best > -np.inf))
        renew(np.union1d(lost, [a]))
        r = np.flatnonzero(m[:a, a] > 0)
        g = 2 * (m[r, a] / total - d[r] * d[a] / total**2)
        up = (g > best[r]) | ((g == best[r]) & (a < to[r]))
        best[r[up]], to[r[up]] = g[up], a
    return label.tolist()


def modularity_communities(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, community) of the graph of nodes(node), or of all of Hubs: pairs of communities are merged greedily while
    modularity grows (ties: the smallest pair). Merges in one component don't bear on another, so each component is a task
    of its own. Without edges every node is its own community; communities are numbered by falling size, then by their
    smallest node."""
    import numpy as np
    import pyarrow as pa

    from .hubs import Hubs
    from .ranking import distributed_row_number

    def numbered(found: DataFrame) -> DataFrame:
        sizes = found.groupBy("first").agg(F.count("*").alias("size"))
        places = distributed_row_number(sizes, [F.desc("size"), F.col("first")], "place").select("first", (F.col("place") - 1).cast("int").alias("community"))
        return found.join(places, "first").select("node", "community")

    if isinstance(edges, Hubs):
        return numbered(cut(edges.merged()))
    kind = dict(nodes.dtypes)["node"]
    own = cut(induced(edges, nodes).where("src <> dst").select(F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst"), F.col("w").cast("double").alias("w")))
    total = own.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]

    def merge(t: pa.Table) -> pa.Table:
        ids, at = np.unique(t["src"].to_numpy(), return_inverse=True)
        labels = _merged(at, np.searchsorted(ids, t["dst"].to_numpy()), t["w"].to_numpy(), len(ids), total)
        return pa.table({"node": ids, "first": ids[labels]})

    parts = components(own).withColumnRenamed("node", "src")
    tied = own.join(parts, "src").groupBy("component").applyInArrow(merge, f"node {kind}, first {kind}")
    return numbered(cut(nodes.select("node").distinct().join(tied, "node", "left").select("node", F.coalesce("first", "node").alias("first"))))


def community_summary(communities: DataFrame, flags: DataFrame, a: str, b: str, samples: int = 5) -> DataFrame:
    """Per community: size, nodes flagged by a, b and both, its type, and a sample of nodes. flags(node, a, b) are 0/1."""
    on = lambda c: F.coalesce(F.col(c), F.lit(0)) == 1
    d = communities.join(flags, "node", "left")
    n = d.groupBy("community").agg(F.count("*").alias("size"), F.count_if(on(a)).alias("n_a"), F.count_if(on(b)).alias("n_b"), F.count_if(on(a) & on(b)).alias("n_both"), F.slice(F.array_sort(F.collect_set("node")), 1, samples).alias("held"))
    kind = F.when((F.col("n_a") > 0) & (F.col("n_b") > 0), "mixed").when(F.col("n_a") > 0, a).when(F.col("n_b") > 0, b).otherwise("none")
    return n.select("community", "size", "n_a", "n_b", "n_both", kind.alias("kind"), F.array_join(F.transform("held", lambda x: x.cast("string")), "|").alias("sample"))


def threshold_sweep(moves: DataFrame, rows: DataFrame, node: str, by: str, thresholds: list[float], reference: DataFrame, **options) -> DataFrame:
    """threshold, seeds, spearman: scores propagated from the seeds of each threshold (all in one propagation) against
    reference(node, score), by average ranks over the reference's nodes; best agreement first."""
    from .ranking import average_rank

    spark = rows.sparkSession
    runs = spark.createDataFrame([(i, float(t)) for i, t in enumerate(thresholds)], "run_id int, threshold double")
    value = F.coalesce(F.col(by).cast("double"), F.lit(0.0))
    seeds = rows.select(F.col(node).alias("node"), value.alias("v")).join(F.broadcast(runs), F.col("v") >= F.col("threshold")).select("run_id", "node").distinct()
    counts = seeds.groupBy("run_id").agg(F.count("*").alias("seeds"))
    got = personalized_pagerank(moves, seeds, **options)
    pairs = runs.crossJoin(reference.select("node", F.col("score").alias("ref"))).join(got, ["run_id", "node"], "left").select("run_id", "ref", F.round(F.coalesce("score", F.lit(0.0)), 9).alias("score"))
    ranks = pairs.select("run_id", average_rank("score", ["run_id"]).alias("a"), average_rank("ref", ["run_id"]).alias("b"))
    agree = ranks.groupBy("run_id").agg(F.corr("a", "b").alias("spearman"))
    return runs.join(counts, "run_id", "left").join(agree, "run_id", "left").select("threshold", F.coalesce("seeds", F.lit(0)).alias("seeds"), "spearman").orderBy(F.desc_nulls_last("spearman"), "threshold")


def module_scores(members: DataFrame, edges: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """members(module, node) -> module, node, a, b, mean of those known, bias a - b, degree within the module."""
    own = edges.join(members.select("module", F.col("node").alias("src")), "src").join(members.select("module", F.col("node").alias("dst")), ["module", "dst"])
    degree = own.groupBy("module", F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    out = members.join(a.select("node", F.col("score").alias("a")), "node", "left").join(b.select("node", F.col("score").alias("b")), "node", "left").join(degree, ["module", "node"], "left")
    some = F.array_compact(F.array("a", "b"))
    mean = F.try_divide(F.aggregate(some, F.lit(0.0), lambda s, x: s + x), F.size(some))
    return out.select("module", "node", "a", "b", mean.alias("mean"), (F.col("a") - F.col("b")).alias("bias"), F.coalesce("degree", F.lit(0)).alias("degree"))


def module_genes(members: DataFrame, symbols: DataFrame) -> DataFrame:
    """members(module, node) -> module, genes: symbols where all of a module's nodes have one, else ids; sorted, joined."""
    d = members.join(symbols.select("node", "symbol"), "node", "left").groupBy("module").agg(F.bool_and(F.col("symbol").isNotNull()).alias("all"), F.array_sort(F.collect_set("symbol")).alias("s"), F.array_sort(F.collect_set(F.col("node").cast("string"))).alias("i"))
    return d.select("module", F.array_join(F.when(F.col("all"), F.col("s")).otherwise(F.col("i")), "|").alias("genes"))
