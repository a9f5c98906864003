"""Greedy modularity of graphs of any size, component by component."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evistrata.operators import graph, hubs
from evistrata.plans import modelling, queries


def test_more_than_2000_nodes(spark):
    pairs = spark.range(1500).select((F.col("id") * 2).alias("a"), (F.col("id") * 2 + 1).alias("b"), F.lit(1.0).alias("w"))
    e = graph.undirected(pairs)
    got = graph.modularity_communities(e, e.select(F.col("src").alias("node")).distinct()).collect()
    assert {r["node"]: r["community"] for r in got} == {n: n // 2 for n in range(3000)}


def test_dense_and_sparse_agree(monkeypatch):
    rng = np.random.default_rng(5)
    for size in (12, 30, 60):
        w = np.triu(rng.integers(0, 4, (size, size)) * (rng.random((size, size)) < 0.3), 1).astype(float)
        w += w.T
        src, dst = np.nonzero(w)
        args = (src, dst, w[src, dst], size, w.sum())
        dense = graph._merged(*args)
        with monkeypatch.context() as m:
            m.setattr(graph, "DENSE_NODES", 0)
            assert graph._merged(*args) == dense


def test_no_pairs_of_suppliers(spark, monkeypatch):
    """Communities by way of the shared parts are those of the edges, which the query no longer makes."""
    tables = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet").where("l_suppkey % 3 = l_partkey % 3 AND l_partkey % 7 < 2")
    e = modelling._edges(tables)
    want = {tuple(r) for r in graph.modularity_communities(e, e.select(F.col("src").alias("node")).distinct()).collect()}

    def refuse(*_):
        raise AssertionError("pairs of suppliers")

    monkeypatch.setattr(queries, "_shared_parts", refuse)
    got = {tuple(r) for r in modelling.modularity(tables).collect()}
    assert got == want and len({c for _, c in got}) >= 3


@pytest.mark.parametrize(("large", "kept"), [(8, 1 << 29), (2, 1), (1 << 20, 1)])
def test_merged_on_hubs(monkeypatch, large, kept):
    """Rows made from hubs, all kept, some kept, none."""
    monkeypatch.setattr(hubs, "LARGE", large)
    monkeypatch.setattr(hubs, "KEPT", kept)
    rng = np.random.default_rng(7)
    for n, count, most in ((12, 8, 4), (60, 200, 6), (150, 120, 4), (50, 3, 30)):
        lists = [np.sort(rng.choice(n, rng.integers(2, most + 1), replace=False)) for _ in range(count)]
        ids, members = np.unique(np.concatenate(lists), return_inverse=True)
        w = np.zeros((len(ids), len(ids)))
        for x in lists:
            w[np.ix_(at := np.searchsorted(ids, x), at)] += 1
        np.fill_diagonal(w, 0)
        src, dst = np.nonzero(w)
        got = hubs._merged(np.array([len(x) for x in lists], dtype=np.int32), members.astype(np.int32), w.sum())
        assert got.tolist() == graph._merged(src, dst, w[src, dst], len(ids), w.sum())
