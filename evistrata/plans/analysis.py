"""Selections, rollups, metrics and tests on the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import metrics as M
from ..operators import ranking, statistics
from ..operators import selection as L
from .queries import query, r6

k = F.col


def _modules(t) -> DataFrame:
    """Suppliers as modules with two methods' enrichment columns."""
    s = t("supplier")
    x, y = (k("s_acctbal") + 1000) / 11000, (k("s_suppkey") * 37 % 101) / 101.0
    cols = {"padj_a": x / 4, "NES_a": y * 4 - 1, "ES_a": y - 0.2, "padj_b": y / 3, "NES_b": x * 4 - 1, "ES_b": x - 0.3}
    return s.select(k("s_suppkey").alias("module"), k("s_nationkey").alias("module_size"), *[v.alias(n) for n, v in cols.items()])


_MODULES = """SELECT s_suppkey AS module, s_nationkey AS module_size, x / 4 AS padj_a, y * 4 - 1 AS nes_a, y - 0.2 AS es_a, y / 3 AS padj_b, x * 4 - 1 AS nes_b, x - 0.3 AS es_b
    FROM (SELECT *, (s_acctbal + 1000) / 11000 AS x, (s_suppkey * 37 % 101) / 101.0::DOUBLE AS y FROM supplier)"""


@query(
    f"""SELECT module, round(least(nes_a, nes_b), 6) AS convergence_min_nes, round((nes_a + nes_b) / 2, 6) AS convergence_mean_nes FROM ({_MODULES})
    WHERE module_size >= 5 AND padj_a <= 0.2 AND padj_b <= 0.25 AND nes_a > 0 AND nes_b > 0 AND es_a > 0 AND es_b > 0"""
)
def convergent_modules(t) -> DataFrame:
    d = _modules(t).withColumns({"padj_a": k("padj_a") * 1.25, "padj_b": k("padj_b")})
    return L.convergent(d, ("a", "b"), 0.25, 5).select("module", r6("convergence_min_nes").alias("convergence_min_nes"), r6("convergence_mean_nes").alias("convergence_mean_nes"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_nationkey IN (SELECT s_nationkey FROM supplier)")
def universe_filter(t) -> DataFrame:
    """Only rows that both evidence tables know; the flag columns that the table lacks are passed over."""
    c = t("customer")
    has_orders = t("orders").where("o_orderstatus = 'P'").select(k("o_custkey").alias("c_custkey"))
    out = c.join(has_orders, "c_custkey", "left_semi").join(t("supplier").select(k("s_nationkey").alias("c_nationkey")), "c_nationkey", "left_semi")
    return L.existing(out, ["c_custkey", "no_such_column", "c_mktsegment"])


@query("SELECT p_partkey, p_brand IN (SELECT p_brand FROM part WHERE p_size = 50) AS valid FROM part")
def valid_genes(t) -> DataFrame:
    p = t("part").select("p_partkey", "p_brand")
    return L.split_valid(p, "p_brand", t("part").where("p_size = 50"), "p_brand").select("p_partkey", "valid")


@query("SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY md5('42:' || p_partkey), p_partkey) AS r FROM part) WHERE r <= 4")
def subsample(t) -> DataFrame:
    return L.sampled(t("part").select("p_brand", "p_partkey"), ["p_brand"], "p_partkey", 4)


@query(
    """WITH d AS (SELECT p_partkey, round(p_retailprice, 0) AS a, p_size AS b, p_partkey % 12 AS n FROM part),
    r AS (SELECT *, (rank() OVER (ORDER BY a DESC) + (count(*) OVER (PARTITION BY a) - 1) / 2.0) / count(*) OVER () AS pa, (rank() OVER (ORDER BY b DESC) + (count(*) OVER (PARTITION BY b) - 1) / 2.0) / count(*) OVER () AS pb FROM d)
    SELECT p_partkey, round(pa, 6) AS pct_a, round(pb, 6) AS pct_b FROM r WHERE n >= 5 AND pa <= 0.05 AND pb >= 0.5"""
)
def specific_only(t) -> DataFrame:
    d = t("part").select("p_partkey", F.round("p_retailprice", 0).alias("a"), k("p_size").alias("b"), (k("p_partkey") % 12).alias("n"))
    return L.specific_only(d, "p_partkey", "a", "b", "n").select("p_partkey", r6("pct_a").alias("pct_a"), r6("pct_b").alias("pct_b"))


@query("SELECT count(*) AS n, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS positive, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS unknown FROM documents")
def relabelled(t) -> DataFrame:
    gold = t("labels").where("toxic = 1")
    d = L.split_valid(t("documents").select("doc_id"), "doc_id", gold, "doc_id").withColumnRenamed("valid", "label")
    d = L.split_valid(d, "doc_id", t("labels"), "doc_id")
    return d.agg(F.count("*").alias("n"), F.count_if("label").alias("positive"), F.count_if(~k("valid")).alias("unknown"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, count(*) AS n FROM lineitem WHERE (l_discount * 10 - l_tax * 10 > 0.1 AND l_discount * 10 > 0.5) OR (l_discount * 10 > 0.8 AND l_tax * 10 > 0.8) GROUP BY ALL")
def specificity_labels(t) -> DataFrame:
    hit = L.worth_labelling(k("l_discount") * 10, k("l_tax") * 10)
    return t("lineitem").where(hit).groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.count("*").alias("n"))


@query("SELECT 'all' AS mode, unnest(['none', 'full', 'pca']) AS run UNION ALL SELECT 'all_plus_residual', unnest(['none', 'full', 'pca', 'residual_pca']) UNION ALL SELECT 'score_modifier_pca', 'baseline_then_pca' UNION ALL SELECT 'pca', 'pca'")
def resolved_modes(t) -> DataFrame:
    rows = [(m, r) for m in ("all", "all_plus_residual", "score_modifier_pca", "pca") for r in L.resolve_modes(m)]
    return t("nation").sparkSession.createDataFrame(rows, "mode string, run string")


@query("SELECT l_partkey, l_suppkey, max(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2")
def gene_max_scores(t) -> DataFrame:
    return t("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max("l_extendedprice").alias("score"))


@query("SELECT p_brand, max(p_retailprice) AS value, max((p_size > 45)::INT) AS any_evidence, min('E' || lpad(p_partkey::VARCHAR, 8, '0')) AS gene_id FROM part GROUP BY 1")
def symbol_collapse(t) -> DataFrame:
    gene = F.concat(F.lit("E"), F.lpad(k("p_partkey").cast("string"), 8, "0"))
    return t("part").groupBy("p_brand").agg(F.max("p_retailprice").alias("value"), F.max((k("p_size") > 45).cast("int")).alias("any_evidence"), F.min(gene).alias("gene_id"))


@query(
    """SELECT l_partkey, arg_min(l_returnflag, (l_orderkey * 10 + l_linenumber) * 100000 + l_suppkey) FILTER (l_linestatus = 'F') AS symbol, max((l_discount >= 0.09)::INT) AS positive, count(DISTINCT l_orderkey) AS loci,
    round(avg(l_quantity), 6) AS pc1, round(avg(l_tax), 6) AS pc2, count(*) AS n FROM lineitem GROUP BY 1"""
)
def gene_rollup(t) -> DataFrame:
    first = S.first_filled(F.when(k("l_linestatus") == "F", k("l_returnflag")).otherwise(""), (k("l_orderkey") * 10 + k("l_linenumber")) * 100000 + k("l_suppkey"))
    return t("lineitem").groupBy("l_partkey").agg(
        first.alias("symbol"), F.max((k("l_discount") >= 0.09).cast("int")).alias("positive"), F.countDistinct("l_orderkey").alias("loci"), r6(F.avg("l_quantity")).alias("pc1"), r6(F.avg("l_tax")).alias("pc2"), F.count("*").alias("n")
    )


@query("SELECT o_custkey, sum(greatest(n, 1))::BIGINT AS mentions FROM (SELECT o_custkey, o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2) GROUP BY 1")
def mention_totals(t) -> DataFrame:
    """Vectors held by each entry, at least one, summed per gene."""
    n = t("lineitem").groupBy(k("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return t("orders").join(n, "o_orderkey", "left").groupBy("o_custkey").agg(F.sum(F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))).alias("mentions"))


_CONTRIB = "SELECT l_orderkey % 50 AS row, l_returnflag AS family, sum((l_quantity - 25) / 14 * 0.8) AS c FROM lineitem GROUP BY 1, 2"


@query(f"SELECT family, round(sum(c), 3) AS signed_sum, round(sum(abs(c)), 3) AS abs_sum, round(avg(c), 5) AS mean, round(stddev_pop(c), 5) AS sd, round(100 * sum(abs(c)) / sum(sum(abs(c))) OVER (), 5) AS pct FROM ({_CONTRIB}) GROUP BY 1")
def family_summary(t) -> DataFrame:
    rows = t("lineitem").groupBy((k("l_orderkey") % 50).alias("row"), k("l_returnflag").alias("family")).agg(F.sum((k("l_quantity") - 25) / 14 * 0.8).alias("c"))
    out = rows.groupBy("family").agg(F.sum("c").alias("s"), F.sum(F.abs("c")).alias("a"), F.avg("c").alias("m"), F.stddev_pop("c").alias("d"))
    total = out.agg(F.sum("a").alias("total"))
    return out.join(F.broadcast(total)).select("family", F.round("s", 3).alias("signed_sum"), F.round("a", 3).alias("abs_sum"), F.round("m", 5).alias("mean"), F.round("d", 5).alias("sd"), F.round(100 * k("a") / k("total"), 5).alias("pct"))


def _predictions(t) -> DataFrame:
    """Orders as loci, lines as genes, with folds, labels and ranks."""
    li = t("lineitem").groupBy(k("l_orderkey").alias("locus"), k("l_partkey").alias("gene")).agg(F.max("l_extendedprice").alias("score"), F.max((k("l_returnflag") == "R").cast("int")).alias("label"))
    return ranking.rank_first(li, ["locus"], "score", ["gene"]).withColumn("fold", k("locus") % 5)


_PRED = """SELECT *, locus % 5 AS fold, row_number() OVER (PARTITION BY locus ORDER BY score DESC, gene) AS r FROM (SELECT l_orderkey AS locus, l_partkey AS gene, max(l_extendedprice) AS score, max((l_returnflag = 'R')::INT) AS label FROM lineitem GROUP BY 1, 2)"""


@query(
    f"""WITH p AS ({_PRED}), f AS (SELECT fold, count(DISTINCT locus) AS n_loci, sum(label)::BIGINT AS n_positive_rows, count(DISTINCT CASE WHEN label = 1 THEN gene END) AS n_positive_genes FROM p GROUP BY 1)
    SELECT p.fold, locus, count(*) AS n_candidates, coalesce(string_agg(gene || '(locus=' || locus || ', rank=' || r || ')', '; ' ORDER BY r) FILTER (label = 1), '') AS positives, max(gene) FILTER (r = 1) AS top1_gene,
    max(score) FILTER (r = 1) AS top1_score, max(label) FILTER (r = 1) AS top1_is_positive, max(score) FILTER (r = 2) AS top2_score, round(max(score) FILTER (r = 1) - max(score) FILTER (r = 2), 6) AS gap,
    any_value(n_loci) AS n_loci, any_value(n_positive_rows) AS n_positive_rows, any_value(n_positive_genes) AS n_positive_genes FROM p JOIN f ON p.fold = f.fold GROUP BY 1, 2"""
)
def fold_audit(t) -> DataFrame:
    return L.fold_audit(_predictions(t)).withColumn("gap", r6("gap"))


@query(
    f"""WITH b AS (SELECT fold, locus, min(r) AS best FROM ({_PRED}) WHERE label = 1 GROUP BY 1, 2) SELECT fold, count(*) AS loci, round(quantile_cont(best, 0.5), 6) AS median_rank, min(best) AS least, max(best) AS most,
    round(avg((best <= 3)::INT), 6) AS within_3 FROM b GROUP BY 1"""
)
def fold_rank_summary(t) -> DataFrame:
    best = _predictions(t).where("label = 1").groupBy("fold", "locus").agg(F.min("rank").alias("best"))
    return best.groupBy("fold").agg(F.count("*").alias("loci"), r6(F.percentile("best", 0.5)).alias("median_rank"), F.min("best").cast("long").alias("least"), F.max("best").cast("long").alias("most"), r6(F.avg((k("best") <= 3).cast("double"))).alias("within_3"))


@query(f"SELECT fold, count(*) FILTER (r = 1 AND label = 1) AS top_1, count(*) FILTER (r <= 3 AND label = 1) AS top_3, sum(label)::BIGINT AS positives FROM ({_PRED}) GROUP BY 1")
def topk_positives(t) -> DataFrame:
    hit = lambda n: F.count_if((k("rank") <= n) & (k("label") == 1)).alias(f"top_{n}")
    return _predictions(t).groupBy("fold").agg(hit(1), hit(3), F.sum("label").cast("long").alias("positives"))


@query(
    """WITH d AS (SELECT c_custkey, c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) AS mapped, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS positive FROM customer)
    SELECT count(*) AS genes, count(*) FILTER (mapped) AS mapped, count(*) FILTER (positive) AS positives, count(*) FILTER (mapped AND positive) AS mapped_positives, round(avg(mapped::INT), 6) AS coverage FROM d"""
)
def network_coverage(t) -> DataFrame:
    c = L.split_valid(t("customer").select("c_custkey", "c_nationkey"), "c_nationkey", t("supplier").where("s_acctbal > 5000"), "s_nationkey").withColumnRenamed("valid", "mapped")
    c = L.split_valid(c, "c_custkey", t("orders").where("o_orderstatus = 'P'"), "o_custkey").withColumnRenamed("valid", "positive")
    return c.agg(F.count("*").alias("genes"), F.count_if("mapped").alias("mapped"), F.count_if("positive").alias("positives"), F.count_if(k("mapped") & k("positive")).alias("mapped_positives"), r6(F.avg(k("mapped").cast("int"))).alias("coverage"))


@query("SELECT round(sum(v * n) / sum(n), 6) AS mean, min(v) AS least, max(v) AS most, '{' || string_agg('\"' || v || '\": ' || n, ', ' ORDER BY v) || '}' AS histogram FROM (SELECT p_size AS v, count(*) AS n FROM part GROUP BY 1)")
def distance_histogram(t) -> DataFrame:
    d = t("part").groupBy(k("p_size").alias("v")).agg(F.count("*").alias("n"))
    return d.agg(r6(F.sum(k("v") * k("n")) / F.sum("n")).alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"), L.histogram_json(d, "v").alias("histogram"))


@query(
    """SELECT l_orderkey, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS min, round(quantile_cont(x, 0.5), 6) AS median, max(x) AS max FROM (SELECT l_orderkey, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END AS x FROM lineitem) GROUP BY 1"""
)
def finite_distribution(t) -> DataFrame:
    d = t("lineitem").select("l_orderkey", F.when(k("l_linenumber") % 3 == 0, F.lit(float("nan"))).otherwise(k("l_quantity")).alias("x"))
    return d.groupBy("l_orderkey").agg(*L.distribution(d, "x")).withColumns({c: r6(c) for c in ("mean", "std", "median")})


@query(
    """SELECT l_returnflag, min(s) AS linear_min, max(s) AS linear_max, count(*) FILTER (s < -50) AS below, round(count(*) FILTER (s < -50) * 1.0 / count(*), 6) AS below_share, count(*) FILTER (s <= -50) AS at_floor, count(DISTINCT s) AS distinct_linear
    FROM (SELECT l_returnflag, round((l_quantity - 26) * 4) AS s FROM lineitem) GROUP BY GROUPING SETS ((l_returnflag), ())"""
)
def saturation_diagnostics(t) -> DataFrame:
    """Ranges of linear scores and how many meet the sigmoid's floor, per group and overall."""
    s = F.round((k("l_quantity") - 26) * 4)
    d = t("lineitem").select("l_returnflag", s.alias("s"), (F.abs(S.sigmoid(s) - S.sigmoid(F.lit(-50.0))) <= 1e-30).alias("floor"))
    return d.groupingSets([[k("l_returnflag")], []], "l_returnflag").agg(
        F.min("s").alias("linear_min"), F.max("s").alias("linear_max"), F.count_if(k("s") < -50).alias("below"), r6(F.count_if(k("s") < -50) / F.count("*")).alias("below_share"), F.count_if("floor").alias("at_floor"), F.countDistinct("s").alias("distinct_linear")
    )


@query("SELECT 'price' AS source, count(*) FILTER (p_retailprice / 2000 >= 0.5) AS n FROM part UNION ALL SELECT 'size', count(*) FILTER (p_size / 50.0 >= 0.5) FROM part")
def gold_per_source(t) -> DataFrame:
    cells = t("part").select((k("p_retailprice") / 2000).alias("price"), (k("p_size") / 50.0).alias("size")).unpivot([], ["price", "size"], "source", "v")
    return cells.groupBy("source").agg(F.count_if(k("v") >= 0.5).alias("n"))


@query(
    """SELECT (vec_id IS NOT NULL)::INT AS has_vector, count(*) AS rows, count(DISTINCT p_brand) AS brands, round(avg(p_retailprice), 6) AS mean_price FROM part LEFT JOIN embeddings ON p_partkey = vec_id GROUP BY 1"""
)
def evidence_coverage(t) -> DataFrame:
    d = L.split_valid(t("part"), "p_partkey", t("embeddings").select("vec_id"), "vec_id")
    return d.groupBy(k("valid").cast("int").alias("has_vector")).agg(F.count("*").alias("rows"), F.countDistinct("p_brand").alias("brands"), r6(F.avg("p_retailprice")).alias("mean_price"))


@query("SELECT count(*) AS modules, count(*) FILTER (n >= 60) AS kept, min(n) AS least, round(quantile_cont(n, 0.5), 6) AS median, max(n) AS most FROM (SELECT p_brand, count(DISTINCT p_name) AS n FROM part GROUP BY 1)")
def module_size_summary(t) -> DataFrame:
    n = t("part").groupBy("p_brand").agg(F.countDistinct("p_name").alias("n"))
    return n.agg(F.count("*").alias("modules"), F.count_if(k("n") >= 60).alias("kept"), F.min("n").alias("least"), r6(F.percentile("n", 0.5)).alias("median"), F.max("n").alias("most"))


@query(
    """SELECT p_type AS feature, round(avg(p_size) FILTER (p_brand LIKE 'Brand#1%'), 6) AS "none", round(avg(p_size) FILTER (p_brand LIKE 'Brand#2%'), 6) AS "full", round(avg(p_size) FILTER (p_brand LIKE 'Brand#3%'), 6) AS pca FROM part
    WHERE p_brand LIKE 'Brand#1%' OR p_brand LIKE 'Brand#2%' OR p_brand LIKE 'Brand#3%' GROUP BY 1"""
)
def weight_matrix(t) -> DataFrame:
    """Coefficient tables of three runs, one below the other, as a feature x mode matrix."""
    run = lambda d, mode: t("part").where(k("p_brand").startswith(f"Brand#{d}")).groupBy(k("p_type").alias("feature")).agg(F.avg("p_size").alias("w")).withColumn("mode", F.lit(mode))
    return run(1, "none").union(run(2, "full")).union(run(3, "pca")).groupBy("feature").pivot("mode", ["none", "full", "pca"]).agg(r6(F.first("w")))


@query(
    f"""WITH m AS (SELECT fold, avg((best <= 1)::INT) AS r1, avg(1.0 / best) AS mrr FROM (SELECT fold, locus, min(r) AS best FROM ({_PRED}) WHERE label = 1 GROUP BY 1, 2) GROUP BY 1)
    SELECT fold, 'recall_at_1' AS metric, round(r1, 6) AS value FROM m UNION ALL SELECT fold, 'mrr', round(mrr, 6) FROM m"""
)
def flat_metrics(t) -> DataFrame:
    """Nested metrics flattened to rows."""
    best = _predictions(t).where("label = 1").groupBy("fold", "locus").agg(F.min("rank").alias("best"))
    nested = best.groupBy("fold").agg(F.struct(r6(F.avg((k("best") <= 1).cast("double"))).alias("recall_at_1"), r6(F.avg(1 / k("best"))).alias("mrr")).alias("metrics"))
    return nested.select("fold", "metrics.*").unpivot(["fold"], ["recall_at_1", "mrr"], "metric", "value")


@query(
    f"""WITH f AS (SELECT fold, round(avg((best <= 1)::INT), 6) AS r1 FROM (SELECT fold, locus, min(r) AS best FROM ({_PRED}) WHERE label = 1 GROUP BY 1, 2) GROUP BY 1),
    c AS (SELECT *, row_number() OVER (ORDER BY r1 DESC, fold) AS place, r1 - (SELECT max(r1) FROM f) AS behind FROM f) SELECT fold, r1, place, round(behind, 6) AS behind FROM c"""
)
def model_comparison(t) -> DataFrame:
    """Runs side by side, best first, with their distance from the best."""
    best = _predictions(t).where("label = 1").groupBy("fold", "locus").agg(F.min("rank").alias("best"))
    runs = best.groupBy("fold").agg(r6(F.avg((k("best") <= 1).cast("double"))).alias("r1"))
    out = ranking.rank_first(runs.withColumn("run", F.lit(1)), ["run"], "r1", ["fold"], "place")
    return out.join(F.broadcast(runs.agg(F.max("r1").alias("top")))).select("fold", "r1", k("place").cast("long").alias("place"), r6(k("r1") - k("top")).alias("behind"))


def _terms(t) -> DataFrame:
    return t("part").groupBy(k("p_brand").alias("g"), k("p_type").alias("term")).agg((F.min("p_retailprice") / 20000).alias("fdr"), F.count("*").alias("n"))


_TERMS = "SELECT p_brand AS g, p_type AS term, min(p_retailprice) / 20000 AS fdr, count(*) AS n FROM part GROUP BY 1, 2"


@query(f"SELECT g, term, place FROM (SELECT g, term, row_number() OVER (PARTITION BY g ORDER BY fdr, term) AS place FROM ({_TERMS})) WHERE place <= 6")
def report_terms(t) -> DataFrame:
    out = ranking.top_k(_terms(t).withColumn("s", -k("fdr")), ["g"], "s", ["term"], 6, "place")
    return out.select("g", "term", k("place").cast("long").alias("place"))


@query(f"WITH t AS ({_TERMS}), s AS (SELECT *, max((fdr <= 0.046)::INT) OVER (PARTITION BY g) AS hit FROM t) SELECT g, term, place FROM (SELECT g, term, row_number() OVER (PARTITION BY g ORDER BY fdr, term) AS place FROM s WHERE hit = 0 OR fdr <= 0.046) WHERE place <= 3")
def significant_terms(t) -> DataFrame:
    return L.significant_or_head(_terms(t), ["g"], "fdr", ["term"], 0.046, 3).select("g", "term", k("place").cast("long").alias("place"))


@query(f"WITH t AS ({_TERMS}), a AS (SELECT term, min(fdr) AS p FROM t GROUP BY 1), s AS (SELECT *, max((p <= 0.0455)::INT) OVER () AS hit FROM a) SELECT term, place FROM (SELECT term, row_number() OVER (ORDER BY p, term) AS place FROM s WHERE hit = 0 OR p <= 0.0455) WHERE place <= 12")
def heatmap_terms(t) -> DataFrame:
    low = _terms(t).groupBy("term").agg(F.min("fdr").alias("p")).withColumn("all", F.lit(1))
    return L.significant_or_head(low, ["all"], "p", ["term"], 0.0455, 12).select("term", k("place").cast("long").alias("place"))


@query(f"SELECT module, n, round(strongest, 6) AS strongest FROM (SELECT module, (padj_a <= 0.1)::INT + (padj_b <= 0.1)::INT AS n, greatest(abs(nes_a), abs(nes_b)) AS strongest FROM ({_MODULES})) ORDER BY n DESC, strongest DESC, module LIMIT 20")
def heatmap_modules(t) -> DataFrame:
    d = _modules(t).select("module", ((k("padj_a") <= 0.1).cast("int") + (k("padj_b") <= 0.1).cast("int")).alias("n"), F.greatest(F.abs("NES_a"), F.abs("NES_b")).alias("s"))
    return d.orderBy(F.desc("n"), F.desc("s"), "module").limit(20).select("module", "n", r6("s").alias("strongest"))


@query(f"""WITH t AS ({_TERMS}), b AS (SELECT DISTINCT term FROM (SELECT term, row_number() OVER (PARTITION BY g ORDER BY fdr, term) AS r FROM t) WHERE r <= 2)
    SELECT g.g, b.term, round(-log10(least(greatest(coalesce(fdr, 1), 1e-300), 1)), 6) AS weight FROM (SELECT DISTINCT g FROM t) g CROSS JOIN b LEFT JOIN t ON t.g = g.g AND t.term = b.term""")
def term_matrix(t) -> DataFrame:
    return L.group_term_matrix(_terms(t), "g", "term", "fdr", 2).withColumn("weight", r6(k("weight") + 0.0))


@query(
    """WITH h AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer), l AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS r FROM customer)
    SELECT c_custkey, r AS place FROM h WHERE r <= 9 UNION ALL SELECT c_custkey, 9 + row_number() OVER (ORDER BY r) FROM l WHERE r <= 6 AND c_custkey NOT IN (SELECT c_custkey FROM h WHERE r <= 9)"""
)
def label_picks(t) -> DataFrame:
    return L.both_ends(t("customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", 9, 6).select("c_custkey", k("place").cast("long").alias("place"))


@query(
    f"""WITH a AS ({_PRED}), b AS (SELECT locus, gene, row_number() OVER (PARTITION BY locus ORDER BY gene % 97 DESC, gene) AS r FROM a),
    x AS (SELECT a.locus, a.gene AS lead, b.gene AS promoted FROM a JOIN b ON a.locus = b.locus AND a.r = 1 AND b.r = 1)
    SELECT x.locus, lead, promoted, o.r AS promoted_was, n.r AS lead_is, (lead <> promoted)::INT AS replaced FROM x JOIN a o ON o.locus = x.locus AND o.gene = promoted JOIN b n ON n.locus = x.locus AND n.gene = lead"""
)
def lead_changes(t) -> DataFrame:
    p = _predictions(t)
    after = ranking.rank_first(p.select("locus", "gene", (k("gene") % 97).alias("s")), ["locus"], "s", ["gene"])
    return L.lead_changes(p, after).withColumns({c: k(c).cast("long") for c in ("promoted_was", "lead_is")})


@query(
    f"""WITH a AS ({_PRED}), b AS (SELECT locus, gene, label, row_number() OVER (PARTITION BY locus ORDER BY gene % 97 DESC, gene) AS r FROM a) SELECT x.locus, x.best AS "none", y.best AS "full", x.best - y.best AS gain
    FROM (SELECT locus, min(r) AS best FROM a WHERE label = 1 GROUP BY 1) x JOIN (SELECT locus, min(r) AS best FROM b WHERE label = 1 GROUP BY 1) y USING (locus)"""
)
def ablation_ranks(t) -> DataFrame:
    """The best positive's rank in each locus, without and with the features."""
    p = _predictions(t)
    after = ranking.rank_first(p.select("locus", "gene", "label", (k("gene") % 97).alias("s")), ["locus"], "s", ["gene"])
    best = lambda d, n: d.where("label = 1").groupBy("locus").agg(F.min("rank").cast("long").alias(n))
    return best(p, "none").join(best(after, "full"), "locus").withColumn("gain", k("none") - k("full"))


@query(f"SELECT g, string_agg(term, '; ' ORDER BY fdr, term) AS annotation FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY fdr, term) AS r FROM ({_TERMS}) WHERE n >= 2) WHERE r <= 2 GROUP BY 1")
def gene_annotations(t) -> DataFrame:
    top = ranking.top_k(_terms(t).where("n >= 2").withColumn("s", -k("fdr")), ["g"], "s", ["term"], 2)
    return top.groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), "; ").alias("annotation"))


@query(
    """WITH s AS (SELECT p_brand, p_partkey, p_retailprice, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS a, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS b FROM part)
    SELECT p_brand, p_partkey, concat_ws('+', CASE WHEN a <= 2 THEN 'price' END, CASE WHEN b <= 2 THEN 'size' END) AS reason FROM s WHERE a <= 2 OR b <= 2"""
)
def representatives(t) -> DataFrame:
    p = ranking.rank_first(t("part").select("p_brand", "p_partkey", "p_retailprice", "p_size"), ["p_brand"], "p_retailprice", ["p_partkey"], "a")
    p = ranking.rank_first(p, ["p_brand"], "p_size", ["p_partkey"], "b").where("a <= 2 or b <= 2")
    return p.select("p_brand", "p_partkey", F.concat_ws("+", F.when(k("a") <= 2, "price"), F.when(k("b") <= 2, "size")).alias("reason"))


@query(f"SELECT locus, round(strength, 6) AS strength FROM (SELECT locus, max(score) FILTER (label = 1) - max(score) FILTER (label = 0) AS strength FROM ({_PRED}) GROUP BY 1) WHERE strength IS NOT NULL ORDER BY strength DESC, locus LIMIT 25")
def locus_stories(t) -> DataFrame:
    """The loci whose best positive stands out most."""
    best = lambda v: F.max(F.when(k("label") == v, k("score")))
    out = _predictions(t).groupBy("locus").agg((best(1) - best(0)).alias("strength")).where("strength is not null")
    return out.orderBy(F.desc("strength"), "locus").limit(25).withColumn("strength", r6("strength"))


@query(
    f"""SELECT gene, locus, round(score, 6) AS score, 'true_positive' AS kind FROM (SELECT * FROM ({_PRED}) WHERE label = 1 ORDER BY score DESC, locus, gene LIMIT 10)
    UNION ALL SELECT gene, locus, round(score, 6), 'false_positive' FROM (SELECT * FROM ({_PRED}) WHERE label = 0 AND r = 1 ORDER BY score DESC, locus, gene LIMIT 10)"""
)
def score_decomposition(t) -> DataFrame:
    p = _predictions(t)
    best = lambda d, kind: d.orderBy(F.desc("score"), "locus", "gene").limit(10).select("gene", "locus", r6("score").alias("score"), F.lit(kind).alias("kind"))
    return best(p.where("label = 1"), "true_positive").union(best(p.where("label = 0 and rank = 1"), "false_positive"))


@query(
    """WITH d AS (SELECT l_suppkey AS g, sum(l_quantity) FILTER (l_returnflag = 'R') - sum(l_quantity) FILTER (l_returnflag = 'A') AS delta FROM lineitem GROUP BY 1) SELECT g, round(delta, 6) AS delta FROM d WHERE delta IS NOT NULL ORDER BY abs(delta) DESC, g LIMIT 15"""
)
def largest_deltas(t) -> DataFrame:
    by = lambda f: F.sum(F.when(k("l_returnflag") == f, k("l_quantity")))
    d = t("lineitem").groupBy(k("l_suppkey").alias("g")).agg((by("R") - by("A")).alias("delta")).where("delta is not null")
    return d.orderBy(F.abs("delta").desc(), "g").limit(15).withColumn("delta", r6("delta"))


@query("SELECT p_partkey, p_retailprice, CASE WHEN p_size % 4 = 0 THEN 0 ELSE p_size END::DOUBLE AS evidence FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50")
def evidence_matrix(t) -> DataFrame:
    raw = F.when(k("p_size") % 4 == 0, "No data").otherwise(k("p_size").cast("string"))
    top = t("part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(50)
    return top.select("p_partkey", "p_retailprice", F.coalesce(S.to_double(raw), F.lit(0.0)).alias("evidence"))


@query(
    """WITH r AS (SELECT label, i, vec_id, row_number() OVER (PARTITION BY label, i ORDER BY x DESC, vec_id) AS hi, row_number() OVER (PARTITION BY label, i ORDER BY x, vec_id) AS lo FROM (SELECT label, vec_id, i, embedding[i]::DOUBLE AS x FROM embeddings, (SELECT unnest([1, 2]) AS i)))
    SELECT label, i::INT AS component, 'top' AS side, hi AS place, vec_id FROM r WHERE hi <= 3 UNION ALL SELECT label, i, 'bottom', lo, vec_id FROM r WHERE lo <= 3"""
)
def component_extremes(t) -> DataFrame:
    """Nested extremes of every component flattened to rows."""
    e = t("embeddings").select("label", "vec_id", F.explode(F.array(*[F.struct(F.lit(i + 1).alias("component"), F.get("embedding", F.lit(i)).cast("double").alias("x")) for i in range(2)])).alias("c")).select("label", "vec_id", "c.*")
    side = lambda s, n: ranking.top_k(e.withColumn("s", s), ["label", "component"], "s", ["vec_id"], 3, "place").select("label", "component", F.lit(n).alias("side"), k("place").cast("long").alias("place"), "vec_id")
    return side(k("x"), "top").union(side(-k("x"), "bottom"))


@query("SELECT n_regionkey, CASE WHEN e > 1200 THEN 35 WHEN e > 850 THEN 45 ELSE 55 END AS cap FROM (SELECT n_regionkey, count(*) * 25 AS e FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)")
def node_caps(t) -> DataFrame:
    e = t("customer").join(F.broadcast(t("nation")), k("c_nationkey") == k("n_nationkey")).groupBy("n_regionkey").agg((F.count("*") * 25).alias("e"))
    cap = F.when(k("e") > 1200, L.node_cap(1201)).when(k("e") > 850, L.node_cap(851)).otherwise(L.node_cap(0))
    return e.select("n_regionkey", cap.alias("cap"))


@query(
    """WITH a AS (SELECT o_custkey AS id, max(o_totalprice) AS s FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 3 <> 0 GROUP BY 1), b AS (SELECT c_name AS n, max(c_acctbal * 10) AS s FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1)
    SELECT key, round(s, 6) AS s, row_number() OVER (ORDER BY s DESC, key) AS place FROM (SELECT 'id' || id AS key, s FROM a UNION ALL SELECT n, s FROM b) ORDER BY place LIMIT 40"""
)
def seed_union(t) -> DataFrame:
    """Seeds with an id and seeds without, one row each, sorted again."""
    a = t("orders").where("o_orderstatus = 'F' and o_custkey % 3 <> 0").groupBy(F.concat(F.lit("id"), k("o_custkey").cast("string")).alias("key")).agg(F.max("o_totalprice").alias("s"))
    b = t("customer").where("c_custkey % 3 = 0").groupBy(k("c_name").alias("key")).agg(F.max(k("c_acctbal") * 10).alias("s"))
    top = a.union(b).orderBy(F.desc("s"), "key").limit(40).withColumn("all", F.lit(1))
    return ranking.rank_first(top, ["all"], "s", ["key"], "place").select("key", r6("s").alias("s"), k("place").cast("long").alias("place"))


_GLOBAL = "SELECT p_partkey, (p_size > 45)::INT AS gold, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r FROM part"


def _global(t) -> DataFrame:
    return ranking.distributed_row_number(t("part").select("p_partkey", "p_retailprice", (k("p_size") > 45).cast("int").alias("gold")), [F.desc("p_retailprice"), F.asc("p_partkey")], "r")


@query(_GLOBAL)
def global_ranking(t) -> DataFrame:
    return _global(t).select("p_partkey", "gold", "r")


def _global_sql(n: str) -> str:
    return f"""SELECT count(*) FILTER (gold = 1) AS found, {", ".join(f"round(count(*) FILTER (gold = 1 AND r <= {c}) / ({n})::DOUBLE, 6) AS recall_at_{c}" for c in (10, 50, 100))}, round(sum(1.0 / r) FILTER (gold = 1) / ({n}), 6) AS mrr,
    round(coalesce(sum(1.0 / r) FILTER (gold = 1 AND r <= 20), 0) / ({n}), 6) AS mrr_20, round(avg(r) FILTER (gold = 1), 6) AS mean_rank, round(quantile_cont(r, 0.5) FILTER (gold = 1), 6) AS median_rank FROM ({_GLOBAL})"""


@query(_global_sql("count(*) FILTER (gold = 1)"))
def global_metrics(t) -> DataFrame:
    out = M.global_metrics(_global(t), "r", "gold")
    return out.withColumns({c: r6(c) for c in out.columns[1:]})


@query(_global_sql("500.0"))
def global_metrics_all_gold(t) -> DataFrame:
    out = M.global_metrics(_global(t), "r", "gold", 500)
    return out.withColumns({c: r6(c) for c in out.columns[1:]})


_SOURCES = """WITH d AS (SELECT 'a' AS source, (l_discount >= 0.08)::INT AS y, l_quantity AS model, l_tax AS other FROM lineitem UNION ALL SELECT 'b', (l_tax >= 0.08)::INT, l_quantity, l_tax FROM lineitem),
    u AS (SELECT source || ':model' AS g, model AS s, y FROM d UNION ALL SELECT source || ':other', other, y FROM d), r AS (SELECT g, y, rank() OVER (PARTITION BY g ORDER BY s) + (count(*) OVER (PARTITION BY g, s) - 1) / 2.0 AS ar,
    sum(y) OVER (PARTITION BY g ORDER BY s DESC) * 1.0 / count(*) OVER (PARTITION BY g ORDER BY s DESC) AS prec FROM u)
    SELECT split_part(g, ':', 1) AS source, split_part(g, ':', 2) AS predictor, count(*) AS n, sum(y)::BIGINT AS positives, round((sum(y * ar) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS roc_auc,
    round(sum(y * prec) / sum(y), 6) AS average_precision FROM r GROUP BY g"""


@query(_SOURCES)
def per_source_evaluation(t) -> DataFrame:
    d = t("lineitem").select(k("l_discount").alias("a"), k("l_tax").alias("b"), (k("l_discount") - 5).alias("c"), k("l_quantity").alias("model"), k("l_tax").alias("other"))
    return M.per_source_auc(d, ["a", "b", "c"], ["model", "other"], 0.08, 5).withColumns({c: r6(c) for c in ("roc_auc", "average_precision")})


@query(
    f"""WITH p AS ({_PRED}), s AS (SELECT range AS seed FROM range(10)), d AS (SELECT seed, locus, label, row_number() OVER (PARTITION BY seed, locus ORDER BY md5(seed || ':' || gene), gene) AS r FROM p, s), b AS (SELECT seed, locus, min(r) AS best FROM d WHERE label = 1 GROUP BY 1, 2)
    SELECT seed, count(*) AS groups, round(avg((best <= 1)::INT), 6) AS recall_at_1, round(avg((best <= 3)::INT), 6) AS recall_at_3, round(avg(1.0 / best), 6) AS mrr FROM b GROUP BY 1"""
)
def random_baseline(t) -> DataFrame:
    out = M.random_rankings(_predictions(t), "locus", "gene", "label", 10)
    return out.withColumn("seed", k("seed").cast("long")).withColumns({c: r6(c) for c in out.columns[2:]})


@query(
    """WITH d AS (SELECT doc_id, n_chars, quality AS y FROM documents JOIN labels USING (doc_id)), s AS (SELECT range AS seed FROM range(6)),
    a AS (SELECT seed, doc_id, n_chars, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || ':row' || doc_id), doc_id) AS spot FROM d, s), b AS (SELECT seed, y, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || ':label' || doc_id), doc_id) AS spot FROM d, s)
    SELECT seed, round(avg(n_chars) FILTER (y = 1), 6) AS mean_1, round(avg(n_chars) FILTER (y = 0), 6) AS mean_0, sum(y)::BIGINT AS positives FROM a JOIN b USING (seed, spot) GROUP BY 1"""
)
def label_permutations(t) -> DataFrame:
    d = t("documents").select("doc_id", "n_chars").join(t("labels").select("doc_id", "quality"), "doc_id")
    p = M.permuted_labels(d, "doc_id", "quality", 6)
    mean = lambda v: r6(F.avg(F.when(k("permuted") == v, k("n_chars")))).alias(f"mean_{v}")
    return p.groupBy(k("seed").cast("long").alias("seed")).agg(mean(1), mean(0), F.sum("permuted").alias("positives"))


@query(
    """WITH a AS (SELECT * FROM lineitem WHERE l_orderkey % 5 <> 0), b AS (SELECT * FROM lineitem WHERE l_orderkey % 5 = 0)
    SELECT 'l_partkey' AS id, (SELECT count(DISTINCT l_partkey) FROM a) AS in_train, (SELECT count(DISTINCT l_partkey) FROM b) AS in_test, (SELECT count(DISTINCT l_partkey) FROM a WHERE l_partkey IN (SELECT l_partkey FROM b)) AS in_both
    UNION ALL SELECT 'l_orderkey', (SELECT count(DISTINCT l_orderkey) FROM a), (SELECT count(DISTINCT l_orderkey) FROM b), 0"""
)
def leakage_counts(t) -> DataFrame:
    li = t("lineitem").select("l_orderkey", "l_partkey")
    return M.overlap_counts(li.where("l_orderkey % 5 <> 0"), li.where("l_orderkey % 5 = 0"), ["l_partkey", "l_orderkey"])


@query(
    """WITH c AS (SELECT s_suppkey AS feature, s_acctbal - 4000 AS a, CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE s_acctbal - 6000 END AS b FROM supplier) SELECT feature, CASE WHEN a > 0 THEN '+' WHEN a < 0 THEN '-' ELSE '0' END AS sign_a, CASE WHEN b > 0 THEN '+' WHEN b < 0 THEN '-' ELSE '0' END AS sign_b,
    (sign(a) = sign(b) AND a <> 0)::INT AS sign_stable, (sign(a) * sign(b) < 0)::INT AS sign_flip FROM c"""
)
def sign_consistency(t) -> DataFrame:
    c = t("supplier").select(k("s_suppkey").alias("feature"), (k("s_acctbal") - 4000).alias("a"), F.when(k("s_suppkey") % 4 != 0, k("s_acctbal") - 6000).alias("b"))
    return M.sign_consistency(c, "feature", ["a", "b"])


@query(
    """WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 7), s AS (SELECT vec_id, label, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS s FROM embeddings e, q WHERE vec_id <> 7),
    r AS (SELECT *, row_number() OVER (ORDER BY s DESC, vec_id) AS r FROM s) SELECT count(*) FILTER (label = 3) AS found, round(count(*) FILTER (label = 3 AND r <= 50) * 1.0 / count(*) FILTER (label = 3), 6) AS recall_at_50, round(avg(1.0 / r) FILTER (label = 3), 6) AS mrr FROM r"""
)
def similarity_ranking(t) -> DataFrame:
    """The vocabulary ranked by likeness to one target, evaluated against a gold label."""
    e = t("embeddings")
    q = e.where("vec_id = 7").select(k("embedding").alias("target"))
    s = e.where("vec_id <> 7").join(F.broadcast(q)).select("vec_id", (k("label") == 3).cast("int").alias("gold"), F.round(S.cosine(k("embedding"), k("target")), 9).alias("s"))
    r = ranking.distributed_row_number(s, [F.desc("s"), F.asc("vec_id")], "r")
    return M.global_metrics(r, "r", "gold").select("found", r6("recall_at_50").alias("recall_at_50"), r6("mrr").alias("mrr"))


@query(
    """WITH u AS (SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS feature, unnest([corr(l_extendedprice, l_quantity), corr(l_extendedprice, l_discount), corr(l_extendedprice, l_tax)]) AS r FROM lineitem)
    SELECT feature, round(r, 6) AS r, row_number() OVER (ORDER BY abs(r) DESC, feature) AS place FROM u"""
)
def strongest_correlations(t) -> DataFrame:
    names = ["l_quantity", "l_discount", "l_tax"]
    row = t("lineitem").agg(F.array(*[F.struct(F.lit(n).alias("feature"), F.corr("l_extendedprice", n).alias("r")) for n in names]).alias("x")).select(F.inline("x"))
    out = ranking.rank_first(row.withColumns({"all": F.lit(1), "s": F.abs("r")}), ["all"], "s", ["feature"], "place")
    return out.select("feature", r6("r").alias("r"), k("place").cast("long").alias("place"))


_TESTS = """SELECT set_id, p_type AS term, p FROM (SELECT p_brand AS set_id, p_type, min(p_retailprice) / 2500 AS p FROM part GROUP BY 1, 2)"""


@query(
    f"""WITH t AS ({_TESTS}), q AS (SELECT set_id, term, p, p * count(*) OVER () / row_number() OVER (ORDER BY p) AS q, p * count(*) OVER (PARTITION BY term) / row_number() OVER (PARTITION BY term ORDER BY p) AS qt FROM t)
    SELECT set_id, term, round(least(1, min(q) OVER (ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS padj_all, round(least(1, min(qt) OVER (PARTITION BY term ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS padj_term FROM q"""
)
def scoped_fdr(t) -> DataFrame:
    d = t("part").groupBy(k("p_brand").alias("set_id"), k("p_type").alias("term")).agg((F.min("p_retailprice") / 2500).alias("p"))
    d = statistics.benjamini_hochberg(statistics.benjamini_hochberg(d, "p", None, "padj_all"), "p", ["term"], "padj_term")
    return d.select("set_id", "term", r6("padj_all").alias("padj_all"), r6("padj_term").alias("padj_term"))


@query(
    """WITH m AS (SELECT DISTINCT p_brand AS category, p_partkey AS g FROM part WHERE p_size > 5), u AS (SELECT DISTINCT l_partkey AS g FROM lineitem WHERE l_quantity > 45)
    SELECT category, count(*) AS module_genes, count(*) FILTER (g IN (FROM u)) AS background FROM m GROUP BY 1"""
)
def category_background(t) -> DataFrame:
    """Genes of each category, and those that the universe holds too."""
    m = t("part").where("p_size > 5").select(k("p_brand").alias("category"), k("p_partkey").alias("g")).distinct()
    d = L.split_valid(m, "g", t("lineitem").where("l_quantity > 45"), "l_partkey")
    return d.groupBy("category").agg(F.count("*").alias("module_genes"), F.count_if("valid").alias("background"))


# DuckDB has no error function; the same fit is written out.
_SF = """(0.5 * t * exp(-x * x - 1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (-0.18628806 + t * (0.27886807 + t * (-1.13520398 + t * (1.48851587 + t * (-0.82215223 + t * 0.17087277))))))))))"""


@query(
    f"""WITH r AS (SELECT p_brand AS module, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS ar, count(*) OVER () AS n FROM (SELECT p_brand, round(p_retailprice) AS s FROM part)),
    z AS (SELECT module, count(*) AS n1, (sum(ar) - count(*) * (count(*) + 1) / 2.0 - count(*) * (any_value(n) - count(*)) / 2.0) / sqrt(count(*) * (any_value(n) - count(*)) * (any_value(n) + 1) / 12.0) AS z FROM r GROUP BY 1),
    e AS (SELECT *, abs(z) / sqrt(2) AS x, 1 / (1 + 0.5 * abs(z) / sqrt(2)) AS t FROM z) SELECT module, n1, round(z, 6) AS z, round(CASE WHEN z >= 0 THEN {_SF} ELSE 1 - {_SF} END, 6) AS p FROM e"""
)
def module_rank_sums(t) -> DataFrame:
    p = t("part")
    out = statistics.rank_sum_tests(p.select(k("p_partkey").alias("gene"), F.round("p_retailprice").alias("score")), p.select(k("p_brand").alias("module"), k("p_partkey").alias("gene")))
    return out.select("module", "n1", r6("z").alias("z"), r6("p").alias("p"))


@query(
    f"""WITH d AS (SELECT round(o_totalprice, -3) AS v, (o_orderstatus = 'F')::INT AS y FROM orders WHERE o_orderstatus IN ('F', 'O')), r AS (SELECT y, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS ar FROM d),
    ties AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM d GROUP BY v)), u AS (SELECT sum(y)::DOUBLE AS n1, (count(*) - sum(y))::DOUBLE AS n0, (sum(y * ar) - sum(y) * (sum(y) + 1) / 2.0)::DOUBLE AS u FROM r),
    z AS (SELECT *, (greatest(u, n1 * n0 - u) - n1 * n0 / 2 - 0.5) / sqrt(n1 * n0 / 12 * (n1 + n0 + 1 - ties / ((n1 + n0) * (n1 + n0 - 1)))) AS z FROM u, ties), e AS (SELECT *, abs(z) / sqrt(2) AS x, 1 / (1 + 0.5 * abs(z) / sqrt(2)) AS t FROM z)
    SELECT n1::BIGINT AS n1, n0::BIGINT AS n0, u, round(2 * u / (n1 * n0) - 1, 6) AS delta, round(least(1, 2 * CASE WHEN z >= 0 THEN {_SF} ELSE 1 - {_SF} END), 6) AS p FROM e"""
)
def rank_sum_p(t) -> DataFrame:
    d = t("orders").where("o_orderstatus in ('F', 'O')").select(F.round("o_totalprice", -3).alias("v"), (k("o_orderstatus") == "F").cast("int").alias("y"))
    return statistics.two_sided_rank_sum(d, "v", "y").withColumns({"delta": r6("delta"), "p": r6("p")})


@query(
    """WITH r AS (SELECT p_partkey AS g, p_brand AS m, p_retailprice AS s, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS pos, count(*) OVER () AS n FROM part),
    x AS (SELECT b.m, r.pos, r.g, r.m = b.m AS hit, CASE WHEN r.m = b.m THEN r.s / w ELSE 0 END - CASE WHEN r.m <> b.m THEN 1.0 / (r.n - k) ELSE 0 END AS d FROM r CROSS JOIN (SELECT m, sum(s) AS w, count(*) AS k FROM r GROUP BY 1) b),
    c AS (SELECT m, pos, g, hit, round(sum(d) OVER (PARTITION BY m ORDER BY pos), 9) AS run FROM x),
    e AS (SELECT m, max(run) AS hi, min(run) AS lo, arg_max(pos, (run, -pos)) AS at_hi, arg_min(pos, (run, pos)) AS at_lo FROM c GROUP BY 1)
    SELECT c.m AS module, least(count(*), 50) AS n, min(pos) AS first_pos FROM c JOIN e ON c.m = e.m WHERE hit AND CASE WHEN hi >= -lo THEN pos <= at_hi ELSE pos >= at_lo END GROUP BY 1"""
)
def leading_edges(t) -> DataFrame:
    p = t("part")
    scored = p.select(k("p_partkey").alias("gene"), k("p_retailprice").alias("score"))
    out = statistics.leading_edges(scored, p.select(k("p_brand").alias("module"), k("p_partkey").alias("gene")))
    at = ranking.distributed_row_number(scored, [F.desc("score"), F.asc("gene")], "pos")
    first = out.select("module", F.size("edge").cast("long").alias("n"), F.explode("edge").alias("gene")).join(at.select("gene", "pos"), "gene")
    return first.groupBy("module", "n").agg(F.min("pos").alias("first_pos"))


@query(
    """WITH g AS (SELECT p_brand AS grp, sum((p_size > 40)::INT) AS a, count(*) AS n FROM part GROUP BY 1), t AS (SELECT grp, a, n - a AS b, sum(a) OVER () - a AS c, sum(n) OVER () - n - sum(a) OVER () + a AS d, n AS n_set, sum(a) OVER () AS k, sum(n) OVER () AS m FROM g),
    p AS (SELECT *, least(1.0, (SELECT sum(exp(lgamma(k + 1) - lgamma(i + 1) - lgamma(k - i + 1) + lgamma(m - k + 1) - lgamma(n_set - i + 1) - lgamma(m - k - n_set + i + 1) - lgamma(m + 1) + lgamma(n_set + 1) + lgamma(m - n_set + 1))) FROM (SELECT unnest(range(a::BIGINT, least(n_set, k)::BIGINT + 1)) AS i))) AS p FROM t),
    q AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p) AS q FROM p) SELECT grp, a::BIGINT AS a, b::BIGINT AS b, c::BIGINT AS c, d::BIGINT AS d, round(a * d / (b * c)::DOUBLE, 6) AS odds_ratio, round(p, 6) AS p,
    round(least(1, min(q) OVER (ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS padj FROM q"""
)
def flag_enrichment(t) -> DataFrame:
    d = t("part").select(k("p_brand").alias("grp"), (k("p_size") > 40).cast("int").alias("flag"))
    return statistics.flag_enrichment(d, "grp", "flag").withColumns({c: r6(c) for c in ("odds_ratio", "p", "padj")})


@query(
    """WITH s AS (SELECT s_suppkey, s_acctbal AS x, s_nationkey * 100 AS y, (s_nationkey % 5 = 0) AS on_ FROM supplier), o AS (SELECT avg(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS d, (SELECT count(*) FROM s WHERE on_) AS n FROM s a JOIN s b ON a.s_suppkey < b.s_suppkey WHERE a.on_ AND b.on_),
    r AS (SELECT draw, s_suppkey, x, y FROM (SELECT range AS draw, s.*, row_number() OVER (PARTITION BY range ORDER BY md5(range || ':' || s_suppkey), s_suppkey) AS k FROM range(30), s) WHERE k <= (SELECT n FROM o)),
    m AS (SELECT a.draw, avg(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS d FROM r a JOIN r b ON a.draw = b.draw AND a.s_suppkey < b.s_suppkey GROUP BY 1)
    SELECT round(o.d, 4) AS observed, round(avg(m.d), 4) AS random_mean, round((count(*) FILTER (m.d <= o.d) + 1) / (count(*) + 1.0), 6) AS p, round((o.d - avg(m.d)) / stddev_samp(m.d), 4) AS z FROM m, o GROUP BY o.d"""
)
def distance_permutation(t) -> DataFrame:
    """Mean pairwise distance of flagged rows against that of equally many drawn at random."""
    s = t("supplier").select(k("s_suppkey").alias("key"), k("s_acctbal").alias("x"), (k("s_nationkey") * 100).cast("double").alias("y"), (k("s_nationkey") % 5 == 0).alias("flag"))
    out = statistics.distance_permutation(s, "key", "flag", 30)
    return out.select(F.round("observed", 4).alias("observed"), F.round("random_mean", 4).alias("random_mean"), r6("p").alias("p"), F.round("z", 4).alias("z"))


@query(
    f"""WITH a AS (SELECT max(r1) AS top FROM (SELECT fold, avg((best <= 1)::INT) AS r1 FROM (SELECT fold, locus, min(r) AS best FROM ({_PRED}) WHERE label = 1 GROUP BY 1, 2) GROUP BY 1)),
    b AS (SELECT quantile_cont(r1, 0.95) AS q95 FROM (SELECT seed, avg((best <= 1)::INT) AS r1 FROM (SELECT seed, locus, min(r) AS best FROM (SELECT range AS seed, locus, label, row_number() OVER (PARTITION BY range, locus ORDER BY md5(range || ':' || gene), gene) AS r FROM ({_PRED}), range(10)) WHERE label = 1 GROUP BY 1, 2) GROUP BY 1))
    SELECT (top > q95)::INT AS beats_random, CASE WHEN top > q95 THEN 'signal' ELSE 'no_signal' END AS verdict FROM a, b"""
)
def audit_verdict(t) -> DataFrame:
    p = _predictions(t)
    real = p.where("label = 1").groupBy("fold", "locus").agg(F.min("rank").alias("best")).groupBy("fold").agg(F.avg((k("best") <= 1).cast("double")).alias("r1")).agg(F.max("r1").alias("top"))
    drawn = M.random_rankings(p, "locus", "gene", "label", 10).agg(F.percentile("recall_at_1", 0.95).alias("q95"))
    beats = k("top") > k("q95")
    return real.join(F.broadcast(drawn)).select(beats.cast("int").alias("beats_random"), F.when(beats, "signal").otherwise("no_signal").alias("verdict"))
