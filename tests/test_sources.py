import gzip

import pytest

from evistrata.operators import graph, joins
from evistrata.sources import tables
from evistrata.streaming import incremental


def test_texts_lines_and_dispatch(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "2001_x.txt").write_text("one\n  two\n")
    (tmp_path / "a" / "b" / "1999-y.txt").write_text("three")
    (tmp_path / "a" / "none.txt").write_text("no year")
    (tmp_path / "a" / "2002.txt").write_text(" \n")
    rows = sorted((r["year"], r["text"]) for r in tables.read_texts(spark, str(tmp_path / "a")).collect())
    assert rows == [(1999, "three"), (2001, "one two")]
    (tmp_path / "l.txt").write_text("x\n\n y \n")
    assert [r[0] for r in tables.read_lines(spark, str(tmp_path / "l.txt")).collect()] == ["x", "y"]
    (tmp_path / "t.csv").write_text("gene_id,score\nA,1.5\nB,NaN\n")
    assert [tuple(r) for r in tables.read_table(spark, str(tmp_path / "t.csv"), tables.SCHEMAS["score_series"]).collect()] == [("A", 1.5), ("B", None)]
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.xlsx")
    with pytest.raises(ValueError):
        tables.assert_columns(spark.range(1), ["id", "gene"])


def test_gtf(spark, tmp_path):
    def line(a, b, strand, gene, kind="protein_coding", feature="gene"):
        return f'chr1\tsrc\t{feature}\t{a}\t{b}\t.\t{strand}\t.\tgene_id "{gene}"; gene_type "{kind}"; gene_name "n{gene}";'

    text = "\n".join(["# head", line(10, 20, "+", "E1.3"), line(40, 30, "-", "E2"), line(1, 2, "+", "E3", "lncRNA"), line(1, 2, "+", "E4", feature="exon"), line(99, 100, "+", "E1.4"), "short\tline"])
    with gzip.open(tmp_path / "g.gtf.gz", "wt") as f:
        f.write(text)
    got = {r["gene_id"]: r for r in tables.read_gtf(spark, str(tmp_path / "g.gtf.gz")).collect()}
    assert set(got) == {"E1", "E2"}
    assert (got["E1"]["start"], got["E1"]["tss"], got["E1"]["gene_symbol"]) == (10, 10, "NE1.3")
    assert (got["E2"]["start"], got["E2"]["end"], got["E2"]["strand"], got["E2"]["tss"], got["E2"]["chromosome"]) == (30, 40, -1, 40, "1")


def test_network(spark):
    links = spark.createDataFrame([("p1", "p2", 900.0), ("p2", "p1", 950.0), ("p1", "p3", 699.0), ("p1", "p4", 800.0), ("p1", "zz", 999.0)], "protein1 string, protein2 string, combined_score double")
    names = spark.createDataFrame([("p1", "A"), ("p2", "B"), ("p3", "C"), ("p4", "A")], "protein string, gene string")
    assert [tuple(r) for r in tables.string_network(links, names).collect()] == [("A", "B", 0.95)]


def test_stream_appends_only_unseen(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "a"), (2, "b"), (1, "a")], "id long, v string").coalesce(1).write.parquet(str(src))
    for extra in ([], [(2, "b"), (3, "c")]):
        if extra:
            spark.createDataFrame(extra, "id long, v string").coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema("id long, v string").parquet(str(src))
        incremental.append_new(stream, "id", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_interval_join_is_brute_force(spark):
    import random

    rng = random.Random(4)
    pts = [(k, rng.choice("AB"), rng.randint(1, 500)) for k in range(40)]
    spans = [(k, rng.choice("AB"), s := rng.randint(1, 500), s + rng.randint(0, 90)) for k in range(60)]
    p = spark.createDataFrame(pts, "p long, chrom string, position long")
    s = spark.createDataFrame(spans, "g long, chrom string, start long, end long")
    got = sorted((r["p"], r["g"]) for r in joins.interval_join(p, s, "chrom", 25, width=13).collect())
    assert got == sorted((a, b) for a, c, x in pts for b, d, lo, hi in spans if c == d and hi >= max(1, x - 25) and lo <= x + 25)


def test_pagerank_mass_and_unmapped_seeds(spark):
    edges = graph.undirected(spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (3, 1, 1.0), (8, 9, 1.0)], "a long, b long, w double"))
    seeds = spark.createDataFrame([(0, 1), (0, 77), (1, 9), (2, 77)], "run_id long, node long")
    out = graph.personalized_pagerank(graph.transitions(edges), seeds, iterations=12).collect()
    for run in (0, 1):
        assert abs(sum(r["score"] for r in out if r["run_id"] == run) - 1) < 1e-6
    assert not [r for r in out if r["run_id"] == 2] and not [r for r in out if r["run_id"] == 0 and r["node"] > 3]
