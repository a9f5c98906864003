"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import glob
import hashlib
import os
import re

import duckdb
import numpy as np
import pandas as pd
import pytest

from evistrata import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    def plain(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
            return None
        if isinstance(x, bool | np.bool_):
            return str(bool(x))
        return round(float(x), 5) + 0.0 if isinstance(x, int | float | np.number) else str(x).removesuffix(" 00:00:00")

    out = pd.DataFrame({c: pd.Series([plain(x) for x in df[c]], dtype=object) for c in sorted(df.columns)})
    return out.sort_values(list(out.columns), key=lambda s: s.map(str)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_as_sql(spark, duck, name):
    got, want = tidy(registry.QUERIES[name](spark, DATA).toPandas()), tidy(duck.sql(registry.ORACLE[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for c in got.columns:
        bad = [(a, b) for a, b in zip(got[c], want[c], strict=True) if a != b and not (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-5 * max(1, abs(a)))]
        assert not bad, (c, bad[:5])


def test_rows_only(spark):
    for name in set(registry.QUERIES) - set(registry.ORACLE):
        assert registry.QUERIES[name](spark, DATA).count() > 0


def test_all_loci_have_folds(spark):
    li = pd.read_parquet(f"{DATA}/lineitem.parquet")[["l_orderkey", "l_partkey"]]
    got = {r["locus"]: (r["test"], r["excluded"], r["train"]) for r in registry.QUERIES["lolo_folds"](spark, DATA).collect()}
    assert set(got) == set(li.l_orderkey)
    for locus in sorted(got)[::50]:
        own = li.l_orderkey == locus
        lost = ~own & li.l_partkey.isin(li.l_partkey[own])
        assert got[locus] == (own.sum(), lost.sum(), (~own & ~lost).sum())


def test_fallback_takes_all_parts(spark):
    li, part = pd.read_parquet(f"{DATA}/lineitem.parquet"), pd.read_parquet(f"{DATA}/part.parquet")
    by_brand = li[li.l_returnflag == "A"].merge(part, left_on="l_partkey", right_on="p_partkey").groupby("p_brand").size()
    rows = [r for r in registry.QUERIES["fallback_join"](spark, DATA).collect() if r["status"] == "matched_by_symbol_fallback"]
    assert rows and all(r["n"] == by_brand[r["p_brand"]] for r in rows)


def test_cosine_of_every_twentieth(spark, monkeypatch):
    from evistrata.operators import ranking

    monkeypatch.setattr(ranking, "BLOCK", 64)  # several blocks of rows
    e = pd.read_parquet(f"{DATA}/embeddings.parquet").sort_values("vec_id")
    ids, v = e.vec_id.to_numpy(), np.stack(e.embedding).astype(float)
    s = np.round(v @ v.T / np.outer(np.linalg.norm(v, axis=1), np.linalg.norm(v, axis=1)), 9)
    want = {(int(ids[q]), int(c), r + 1) for q in np.flatnonzero(ids % 20 == 0) for r, c in enumerate([ids[c] for c in np.lexsort((ids, -s[q])) if c != q][:10])}
    got = {(r["query"], r["vec_id"], r["rank"]) for r in registry.QUERIES["cosine_topk"](spark, DATA).collect()}
    assert got == want and len({q for q, _, _ in got}) == (ids % 20 == 0).sum()


@pytest.mark.parametrize("li", [None, [(1, 3), (1, 5), (2, 5), (2, 10), (3, 10), (3, 7), (4, 14), (4, 21), (5, 3), (5, 5), (6, 21), (6, 22), (7, 33)]])
def test_graph_queries_on_all_edges(spark, li, tmp_path):
    """The whole co-supply graph against dense matrices, on the smallest tables and on a sparse one of two parts."""
    sf_dir = DATA
    if li:
        sf_dir = str(tmp_path)
        spark.createDataFrame(li, "l_partkey long, l_suppkey long").write.parquet(f"{sf_dir}/lineitem.parquet")
    sp = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_partkey").distinct().toPandas()
    has = pd.crosstab(sp.l_suppkey, sp.l_partkey)
    w = has.to_numpy() @ has.to_numpy().T * (1 - np.eye(len(has)))
    on = w.sum(axis=1) > 0
    ids, w = has.index.to_numpy()[on], w[on][:, on]
    rows = lambda name: registry.QUERIES[name](spark, sf_dir).collect()
    got = {(r["run_id"], r["node"]): r["score"] for r in rows("ppr_scores")}
    reach = np.linalg.matrix_power((w > 0) + np.eye(len(w)), len(w)) > 0
    for run in (3, 5, 7):
        s = (ids % run == 0).astype(float)
        if not s.any():
            assert not any(k[0] == run for k in got)
            continue
        s /= s.sum()
        exact = np.linalg.solve(np.eye(len(w)) - 0.85 * (w / w.sum(axis=1, keepdims=True)).T, 0.15 * s)
        assert all(abs(got.get((run, i), 0.0) - x) <= 1e-6 for i, x in zip(ids, exact, strict=True))
    far = np.where(ids % 10 == 0, 0, -1)
    for d in range(1, len(w)):
        far[(far < 0) & (w[:, far == d - 1].sum(axis=1) > 0)] = d
    assert {r["node"]: r["distance"] for r in rows("bfs_nearest")} == {i: d for i, d in zip(ids, far, strict=True) if d >= 0}
    want = {i: (ids[reach[k]].min(), (w[k] > 0).sum()) for k, i in enumerate(ids)}
    assert {r["node"]: (r["component"], r["degree"]) for r in rows("components_degree")} == want


def normalized(text):
    """The cleaning chain in Python."""
    from evistrata.functions import text as X

    out = re.sub(r"\bet\s+al\b", " ", text.translate(str.maketrans(X.FOLD)).lower())
    for u in X.UNITS:
        out = out.replace(u, " ")
    out = re.sub(f"(?i)({'|'.join(X.SYNONYMS)})", f" {X.ENTITY} ", out)
    out = re.sub(r"\bals\b", f" {X.ENTITY} ", out)
    for p, by in X.CLEANING:
        out = re.sub(p, by, out, flags=re.ASCII if p in (r"\b\d+\b", r"\bh4\b", r"\b[a-zA-Z0-9]\b") else 0)
    return out.strip(" ")


def test_texts_are_normalized_whole(spark, tmp_path):
    from evistrata.functions import text as X

    words = "protein folding under cellular stress in motor neurons shows early loss of axonal transport and later decline of muscle strength within cohorts"
    more = [f"Résumé of naïve cells: {words}", f"Rsum of nave cells: {words}", f"Resume of naive cells: {words}", f"5 μg dose → 10 °C, Lou Gehrig’s disease et\u00a0al {words}"]
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10**9 + i, t) for i, t in enumerate(more)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    norm = {i: normalized(t) for i, t in rows if t is not None}
    got = {r["doc_id"]: (r["digest"], r["n"]) for r in registry.QUERIES["text_normalize"](spark, str(tmp_path)).collect() if r["n"] is not None}
    assert got == {i: (hashlib.md5(t.encode()).hexdigest(), len(t)) for i, t in norm.items()}
    want = {}
    for i in sorted(norm):
        t = norm[i]
        if len(t) > X.MIN_CHARS and len(t.split(" ")) > X.MIN_TOKENS and not re.search(rf"(?i)\b({'|'.join(X.EXCLUDED)})\b", t):
            want.setdefault(t, (i, len(t.split(" "))))
    assert {(r["doc_id"], r["n_tokens"]) for r in registry.QUERIES["corpus_filter_dedup"](spark, str(tmp_path)).collect()} == set(want.values())
    assert [10**9 + i in {i for i, _ in want.values()} for i in range(3)] == [True, True, False]
