import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from evistrata.functions import scalars as S
from evistrata.operators import graph, joins, models, ranking, selection
from evistrata.sources import artefacts, records, services, tables


def test_cursor_scan_and_lookup():
    pages = {"*": (["a", "b"], "x"), "x": (["b", "c"], "y"), "y": ([], "y")}
    asked = []

    def transport(p):
        asked.append(p["cursorMark"])
        ids, following = pages[p["cursorMark"]]
        return {"resultList": {"result": [{"id": i} for i in ids]}, "nextCursorMark": following}

    assert services.cursor_scan(transport, "q") == ["a", "b", "c"] and asked == ["*", "x", "y"]
    del pages["y"]
    assert services.cursor_scan(transport, "q") == ["a", "b", "c"]

    def details(p):
        if "EXT_ID:3" in p["query"]:
            raise OSError
        return {"resultList": {"result": [{"q": p["query"]}]}}

    assert [r["q"] for r in services.batched_lookup(details, ["1", "2", "3", "4", "5"], 2)] == ["EXT_ID:1 OR EXT_ID:2", "EXT_ID:5"]
    genes = lambda p: {"genes": [{"symbol": p["symbol"], "name": "Name", "aliases": ["A1 ", None]}]}
    assert services.expanded_symbols(genes, ["SOD1"]) == {"sod1", "name", "a1"}
    assert services.validated_symbols(lambda p: {"found": [x for x in p["symbols"] if x != "no"]}, ["x", "no", "x", "y"], 1) == {"x", "y"}


def test_graphql_pages(spark):
    waits, calls = [], []

    def transport(p):
        calls.append(p["variables"]["page"]["index"])
        if len(calls) == 1:
            raise OSError("down")
        i = p["variables"]["page"]["index"]
        return {"data": {"study": {"sets": {"count": 5, "rows": [{"studyLocusId": f"L{2 * i + j}"} for j in range(min(2, 5 - 2 * i))]}}}}

    g = services.GraphQL(transport, wait=0.5, sleep=waits.append)
    rows = list(g.pages("q", {"id": 1}, ["study", "sets"], 2))
    assert [r["studyLocusId"] for r in rows] == [f"L{i}" for i in range(5)] and waits == [0.5] and calls == [0, 0, 1, 2]
    with pytest.raises(services.ServiceError):
        services.GraphQL(lambda p: {"errors": ["bad"]}, sleep=waits.append).execute("q", {})
    t = services.as_table(spark, rows, study="S")
    assert [r["study_locus_id"] for r in records.credible_sets(t).collect()] == [f"L{i}" for i in range(5)]


def test_vectors_and_scores(spark, tmp_path):
    artefacts.write_npz(str(tmp_path / "s.npz"), genes=["a", "A", "b"], scores_topm=[0.1, 0.7, 0.2], ctx_counts=[1, 2, 3])
    assert sorted(map(tuple, artefacts.read_scores_npz(spark, str(tmp_path / "s.npz")).collect())) == [("A", 0.7, 2), ("B", 0.2, 3)]
    (tmp_path / "v.txt").write_text("2 3\nx 1 2 3\ny 4 5 6\n")
    (tmp_path / "v.jsonl").write_text('{"gene": "x", "embeddings": [[1, 3], [3, 5], [9]]}\n{"gene": "y", "embeddings": [7, 8]}\n{"gene": "z", "embeddings": []}\n')
    artefacts.write_npz(str(tmp_path / "v.npz"), genes=["x"], embeddings=[[1.0, 2.0]])
    vectors = lambda n: {r["word"]: list(r["vector"]) for r in artefacts.read_vectors(spark, str(tmp_path / n)).collect()}
    assert vectors("v.txt") == {"x": [1, 2, 3], "y": [4, 5, 6]} and vectors("v.jsonl") == {"X": [2, 4], "Y": [7, 8]} and vectors("v.npz") == {"x": [1, 2]}


def test_token_lists(tmp_path):
    (tmp_path / "c.csv").write_text('text,year\n"Alpha, beta",2001\nGamma,1990\nDelta x,n/a\n,2001\n')
    assert [list(artefacts.token_lists(str(tmp_path / "c.csv"), first=2000)) for _ in range(2)] == [[["alpha", "beta"], ["delta", "x"]]] * 2
    with pytest.raises(ValueError):
        next(artefacts.token_lists(str(tmp_path / "c.csv"), column="none"))


def test_runs_and_files(spark, tmp_path):
    for n in ("a", "b"):
        (tmp_path / "runs" / n).mkdir(parents=True)
        (tmp_path / "runs" / n / "m.csv").write_text("x\n1\n")
    assert artefacts.latest_run(str(tmp_path / "runs"), ["m.csv"]).name in "ab" and artefacts.latest_run(str(tmp_path / "runs"), ["none"]) is None
    runs = spark.createDataFrame([("l1", "pca", 0.5, 0.7), ("l1", "full", 0.5, 0.8), ("l2", "none", 0.9, 0.9)], "penalty string, mode string, mean_pr_auc double, mean_roc_auc double")
    assert artefacts.select_run(runs, "l1").first()["mode"] == "full" and artefacts.select_run(runs, "l1", "pca").first()["mode"] == "pca" and artefacts.select_run(runs).first()["mode"] == "none"
    (tmp_path / "l1" / "pca").mkdir(parents=True)
    (tmp_path / "l1" / "pca" / "summary.csv").write_text("metric,value\nroc,0.5\n")
    assert list(artefacts.read_bundle(spark, str(tmp_path), "l1", "pca")) == ["summary"]
    got = artefacts.first_readable([str(tmp_path / "no")], lambda: b"x", str(tmp_path / "cache" / "f"))
    assert got == b"x" == artefacts.first_readable([], None, str(tmp_path / "cache" / "f"))
    with pytest.raises(FileNotFoundError):
        artefacts.first_readable([str(tmp_path / "no")])
    (tmp_path / "mode_none").mkdir()
    assert artefacts.sibling_baseline(str(tmp_path / "mode_full")).name == "mode_none" and artefacts.resolve_table(None, lambda: "built") == "built"
    assert [artefacts.unique_dir(str(tmp_path), "out").name for _ in range(3)] == ["out", "out_2", "out_3"]
    assert tables.read_lines(spark, str(tmp_path / "not_there.txt")).count() == 0


def test_sinks(spark, tmp_path):
    pred = spark.createDataFrame([("L", "g1", 0, 0.9, 1), ("L", "g2", 1, 0.4, 2)], "locus string, gene string, label int, score double, rank int")
    artefacts.write_model(str(tmp_path / "m"), spark.createDataFrame([("f", 1.0)], "feature string, coefficient double"), pred, {"auc": float("nan"), "n": np.int64(2)}, components=np.eye(2))
    s = json.loads((tmp_path / "m" / "summary.json").read_text())
    assert s == {"auc": None, "n": 2, "tables": ["coefficients", "false_positives_top3", "predictions", "top3"]}
    assert spark.read.option("header", True).csv(str(tmp_path / "m" / "false_positives_top3")).count() == 1
    artefacts.write_scores(pred.select(F.col("gene").alias("node"), "score"), str(tmp_path / "s"))
    assert [r["node"] for r in spark.read.option("header", True).csv(str(tmp_path / "s")).collect()] == ["g1", "g2"]
    assert artefacts.markdown_table(pred.select("gene", "score").limit(1)) == "| gene | score |\n|---|---|\n| g1 | 0.9000 |\n"
    tables.write_table(pred, str(tmp_path / "t"), csv=True, partition_by=["locus"])
    assert spark.read.parquet(str(tmp_path / "t.parquet")).count() == 2 and (tmp_path / "t.csv" / "locus=L").is_dir()


def test_ids_and_reports(spark):
    nodes = spark.createDataFrame([("ENSG1",), ("ENSG2",), ("x",)], "node string")
    assert artefacts.node_format(nodes, "node") == "ensembl"
    assert artefacts.overlap_report(spark.createDataFrame([("ENSG1", 1.0), ("z", 2.0)], "node string, score double"), nodes) == {"shared": 1, "only_background": 1, "only_nodes": 2}
    assert sorted(r[0] for r in artefacts.seed_ids(spark.createDataFrame([("A.1",), (" A",), ("nan",)], "g string"), "g").collect()) == ["A"]
    assert records.pick_column(["Gene name", "nTPM"], ["TPM", "ntpm"]) == "nTPM" and records.pick_column(["a"], ["b"]) is None


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    nan = F.lit(float("nan"))
    assert value(S.thresholded(F.lit(0.4), 0.5)) == 0 and value(S.thresholded(F.lit(0.75), 0.5)) == 0.5 and value(S.squared(F.lit(None).cast("double"))) == 0
    assert [value(S.soft_threshold(F.lit(x), 1.0)) for x in (-3.0, 0.5, 2.5)] == [-2, 0, 1.5]
    assert value(S.standardized(F.lit(3.0), F.lit(1.0), F.lit(2.0))) == 1 and value(S.standardized(F.lit(3.0), F.lit(1.0), F.lit(0.0))) == 0 == value(S.standardized(F.lit(3.0), F.lit(1.0), nan))
    assert [value(S.sign_of(F.lit(x), 0.1)) for x in (0.2, -0.2, 0.05)] == ["+", "-", "0"]
    assert np.allclose(value(S.l2_normalized(F.array(F.lit(3.0), F.lit(4.0)))), [0.6, 0.8])
    assert [value(S.variant_id(F.lit(x))) for x in ("chr1:007_a/G", "X 5-A>t", "1-5", "rs5", "12345_n_c", "M_7_A_T")] == ["1_7_A_G", "X_5_A_T", None, None, "1234_5_N_C", "MT_7_A_T"]
    assert value(S.rsid(F.lit(" RS12 "))) == "rs12" and value(S.rsid(F.lit("rs1 rs2"))) is None
    assert value(S.gene_id(F.lit(" E1.5 "))) == "E1" and value(S.gene_id(F.lit("E1"), "prefix")) is None and value(S.gene_id(F.lit("ENSGx.1"), "prefix")) == "ENSGx"


def test_keep_first_align_and_seeds(spark):
    d = spark.createDataFrame([(1, 5), (1, 3), (2, 9)], "a long, b long")
    assert sorted(map(tuple, ranking.keep_first(d, ["a"], ["b"]).collect())) == [(1, 3), (2, 9)]
    s, r = spark.createDataFrame([(1, 2.0)], "node long, score double"), spark.createDataFrame([(1, 1.0), (2, 1.0)], "node long, score double")
    with pytest.raises(Exception, match="no score"):
        graph.background_normalized(s, r).collect()
    moves = graph.transitions(graph.undirected(spark.createDataFrame([(1, 2, 1.0)], "a long, b long, w double")))
    with pytest.raises(ValueError):
        graph.seeded_pagerank(moves, spark.createDataFrame([(0, 9)], "run_id long, node long"))
    assert abs(sum(x["score"] for x in graph.seeded_pagerank(moves, spark.createDataFrame([(0, 1)], "run_id long, node long")).collect()) - 1) < 1e-6
    assert joins.grid(spark, a=[1, 2], b=["x"]).count() == 2 and selection.existing(d, ["b", "z"]).columns == ["b"]


def test_modularity_and_folds(spark):
    """Two cliques with one tie: two communities; without edges, one node each."""
    cliques = [(a, b, 1.0) for g in (0, 10) for a in range(g, g + 4) for b in range(a + 1, g + 4)] + [(0, 10, 1.0)]
    e = graph.undirected(spark.createDataFrame(cliques, "a long, b long, w double"))
    nodes = e.select(F.col("src").alias("node")).distinct()
    got = {r["node"]: r["community"] for r in graph.modularity_communities(e, nodes).collect()}
    assert {n for n, c in got.items() if c == 0} == {0, 1, 2, 3} and {n for n, c in got.items() if c == 1} == {10, 11, 12, 13}
    assert graph.modularity_communities(e.limit(0), nodes).select("community").distinct().count() == 8
    rows = spark.createDataFrame([(n, n % 2, int(n in (0, 11))) for n in got], "node long, fold int, label int")
    out = {r["node"]: r["network_score"] for r in graph.fold_scores(graph.transitions(e), rows, "fold", "node", "label").collect()}
    w = np.zeros((14, 14))
    for a, b, _ in cliques:
        w[a, b] = w[b, a] = 1
    p = np.divide(w, w.sum(1, keepdims=True), where=w.sum(1, keepdims=True) > 0, out=np.zeros_like(w))
    for fold, seed in ((0, 11), (1, 0)):
        exact = np.linalg.solve(np.eye(14) - 0.85 * p.T, 0.15 * (np.arange(14) == seed))
        assert all(abs(out[n] - exact[n]) < 1e-7 for n in got if n % 2 == fold)


def test_models(spark):
    assert models.parse_c_grid("1, 0.1,1") == [0.1, 1.0]
    with pytest.raises(ValueError):
        models.parse_c_grid("0")
    with pytest.raises(ValueError):
        models.split_views(F.col("x"), 3)
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 2))
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.standard_normal(300) > 0).astype(int)
    d = spark.createDataFrame([(i, i % 3, *map(float, v), int(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "id long, fold int, a double, b double, y int")
    out = np.array([(r["id"], r["linear_score"]) for r in models.stacked_scores(d, "fold", 3, ["a"], ["b"], "y").orderBy("id").collect()])
    assert len(out) == 300 and np.mean((out[:, 1] > 0) == (y == 1)) > 0.7
    curve = models.learning_curve(d, "id", "fold", 0, ["a", "b"], "y", 4).collect()
    assert [r["train_rows"] for r in curve] == sorted(r["train_rows"] for r in curve) and curve[-1]["train_rows"] == 200


def test_scored_universe_and_sets(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((240, 2))
    y = [int(v > 0) if i % 2 else None for i, v in enumerate(x[:, 0])]
    d = spark.createDataFrame([(i, i // 2 % 3 if t is not None else None, *map(float, v), t) for i, (v, t) in enumerate(zip(x, y, strict=True))], "id long, fold int, a double, b double, y int")
    out = models.scored_universe(d, "id", "fold", 3, ["a", "b"], "y").orderBy("rank").collect()
    assert [r["rank"] for r in out] == list(range(1, 241)) and [r["linear_score"] for r in out] == sorted((r["linear_score"] for r in out), reverse=True)
    off = [r for r in out if r["y"] is None]
    assert np.mean([(r["linear_score"] > 0) == (x[r["id"], 0] > 0) for r in off]) > 0.9
    gold = d.where("y is not null")
    assert models.survivors(gold, ["a", "b"], "y") == ["a"] and models.coefficient_table(gold, ["a", "b"], "y").count() == 3
    rows = {(r["universe"], r["model"]): r for r in models.compared(gold, "fold", 3, {"a": ["a"], "b": ["b"]}, "y", {"all": F.lit(True), "some": F.col("b") > 0}).collect()}
    assert rows["all", "a"]["roc_auc"] > 0.95 > 0.7 > rows["all", "b"]["roc_auc"] and rows["some", "a"]["n"] < rows["all", "a"]["n"] == 120
