"""Record parsers and identifier tables on the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources import records as R
from .queries import query, r6

k = F.col


def _text(x) -> F.Column:
    return x.cast("string")


@query(
    """SELECT 'L' || o_orderkey AS study_locus_id, 'S' || o_custkey % 7 AS study_id, CASE o_custkey % 25 WHEN 23 THEN 'X' WHEN 24 THEN 'Y' ELSE (o_custkey % 25)::VARCHAR END AS chromosome,
    CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey END AS position, round(o_totalprice, 6) AS beta, array_to_string(list_sort(list_distinct([o_orderpriority, o_orderstatus])), '|') AS quality_controls,
    CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'v' || o_orderkey END AS lead_variant_id,
    CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'rs' || o_custkey END AS lead_variant_rsids, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey + 5 END AS lead_variant_position FROM orders"""
)
def credible_set_rows(t) -> DataFrame:
    rs = F.concat(F.lit("rs"), _text(k("o_custkey")))
    variant = F.struct(F.concat(F.lit("v"), _text(k("o_orderkey"))).alias("id"), F.array(rs, F.lit(" "), rs).alias("rsIds"), (k("o_orderkey") + 5).alias("position"))
    raw = t("orders").select(
        F.to_json(F.struct(
            F.concat(F.lit("L"), _text(k("o_orderkey"))).alias("studyLocusId"), F.concat(F.lit("S"), _text(k("o_custkey") % 7)).alias("studyId"), F.concat(F.lit("chr"), _text(k("o_custkey") % 25)).alias("chromosome"),
            F.when(k("o_orderkey") % 9 != 0, _text(k("o_orderkey"))).otherwise("No data").alias("position"), k("o_totalprice").alias("beta"), F.array("o_orderpriority", "o_orderstatus").alias("qualityControls"),
            F.when(k("o_orderkey") % 4 != 0, variant).alias("variant"),
        )).alias("json")
    )
    return R.credible_sets(raw).select("study_locus_id", "study_id", "chromosome", "position", r6("beta").alias("beta"), "quality_controls", "lead_variant_id", "lead_variant_rsids", "lead_variant_position")


def _coloc(t) -> DataFrame:
    """lineitem as colocalisation records: JSON parsed to rows."""
    key = k("l_partkey") % 40
    ids = F.concat(F.lit("ENSG"), F.lpad(_text(key), 11, "0"))
    study = F.struct(
        F.concat(F.lit("st"), _text(k("l_suppkey") % 9)).alias("id"), k("l_shipmode_").alias("projectId"), F.struct(F.concat(F.lit(" t"), _text(k("l_linenumber"))).alias("biosampleName")).alias("biosample"),
        F.struct(F.when(key % 3 != 0, F.concat(ids, F.lit(".2"))).alias("id"), F.when(key % 5 != 0, F.concat(F.lit("g"), _text(key))).alias("approvedSymbol")).alias("target"),
    )
    other = F.struct(
        F.when(k("l_linenumber") < 7, F.concat(F.lit("q"), _text(k("l_suppkey") % 50))).alias("studyLocusId"), F.when(k("l_suppkey") % 2 == 0, F.concat(F.lit("st"), _text(k("l_suppkey") % 9))).otherwise("").alias("studyId"),
        k("l_returnflag").alias("studyType"), F.when(key % 6 == 0, ids).alias("qtlGeneId"), (k("l_linestatus") == "F").alias("isTransQtl"), study.alias("study"),
    )
    li = t("lineitem").withColumn("l_shipmode_", F.concat(F.lit("p"), _text(k("l_suppkey") % 4)))
    raw = li.select(F.concat(F.lit("L"), _text(k("l_orderkey") % 50)).alias("gwas_study_locus_id"), F.to_json(F.struct(k("l_tax").alias("h3"), k("l_discount").alias("h4"), (k("l_quantity") / 50).alias("clpp"), other.alias("otherStudyLocus"))).alias("json"))
    return R.colocalisations(raw)


_COLOC = """SELECT 'L' || l_orderkey % 50 AS locus, 'q' || l_suppkey % 50 AS qtl, 'st' || l_suppkey % 9 AS study, l_returnflag AS kind, key, CASE WHEN key % 3 <> 0 OR key % 6 = 0 THEN 'ENSG' || lpad(key::VARCHAR, 11, '0') END AS gene_id,
    CASE WHEN key % 5 <> 0 THEN 'G' || key END AS gene_symbol, l_linestatus = 'F' AS trans, 'p' || l_suppkey % 4 AS project, 't' || l_linenumber AS tissue, l_tax AS h3, l_discount AS h4, l_quantity / 50 AS clpp
    FROM (SELECT *, l_partkey % 40 AS key FROM lineitem) WHERE l_linenumber < 7"""


@query(
    f"""SELECT locus AS gwas_study_locus_id, qtl AS qtl_study_locus_id, study AS qtl_study_id, gene_id, gene_symbol, count(*) AS n, count(*) FILTER (trans) AS trans, round(sum(h4), 6) AS h4, round(sum(clpp), 6) AS clpp FROM ({_COLOC}) GROUP BY ALL"""
)
def colocalisation_rows(t) -> DataFrame:
    keys = ["gwas_study_locus_id", "qtl_study_locus_id", "qtl_study_id", "gene_id", "gene_symbol"]
    return _coloc(t).groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("qtl_is_trans_qtl").alias("trans"), r6(F.sum("colocalisation_h4")).alias("h4"), r6(F.sum("colocalisation_clpp")).alias("clpp"))


def coloc_rollup(records: DataFrame, key: str) -> DataFrame:
    """Evidence of each (locus, key): counts, sets and score summaries of its colocalisation records."""
    n_set = lambda c: F.countDistinct(F.when(F.trim(c) != "", F.trim(c)))
    sets = {"qtl_study_types": ("qtl_study_type", None), "qtl_projects": ("qtl_project_id", None), "qtl_biosample_ids": ("qtl_biosample_id", None), "qtl_tissues": ("qtl_biosample_name", None), "qtl_conditions": ("qtl_condition", None),
            "qtl_sub_study_descriptions": ("qtl_sub_study_description", 40), "qtl_traits": ("qtl_trait_from_source", 40)}
    return records.where(F.col(key).isNotNull()).groupBy("gwas_study_locus_id", key).agg(
        F.count("*").alias("coloc_record_count"), F.countDistinct("qtl_study_locus_id").alias("qtl_study_locus_count"), F.countDistinct("qtl_study_id").alias("qtl_study_count"), n_set("qtl_biosample_name").alias("tissue_count"),
        *[S.unique_join(F.col(c), most).alias(name) for name, (c, most) in sets.items()],
        F.coalesce(F.bool_or("qtl_is_trans_qtl"), F.lit(False)).alias("any_trans_qtl"), F.count_if("qtl_is_trans_qtl").alias("n_trans_qtl"),
        F.max("colocalisation_h4").alias("colocalisation_h4_max"), F.avg("colocalisation_h4").alias("colocalisation_h4_mean"), F.avg("colocalisation_h3").alias("colocalisation_h3_mean"),
        F.max("colocalisation_clpp").alias("colocalisation_clpp_max"), F.avg("colocalisation_clpp").alias("colocalisation_clpp_mean"),
    )


def _rollup_sql(key: str) -> str:
    return f"""SELECT locus AS gwas_study_locus_id, {key}, count(*) AS coloc_record_count, count(DISTINCT qtl) AS qtl_study_locus_count, count(DISTINCT study) AS qtl_study_count, count(DISTINCT tissue) AS tissue_count,
    array_to_string(list_sort(list_distinct(list(kind))), '|') AS qtl_study_types, array_to_string(list_sort(list_distinct(list(project))), '|') AS qtl_projects, '' AS qtl_biosample_ids,
    array_to_string(list_sort(list_distinct(list(tissue))), '|') AS qtl_tissues, '' AS qtl_conditions, '' AS qtl_sub_study_descriptions, '' AS qtl_traits, bool_or(trans) AS any_trans_qtl, count(*) FILTER (trans) AS n_trans_qtl,
    max(h4) AS colocalisation_h4_max, round(avg(h4), 6) AS colocalisation_h4_mean, round(avg(h3), 6) AS colocalisation_h3_mean, max(clpp) AS colocalisation_clpp_max, round(avg(clpp), 6) AS colocalisation_clpp_mean
    FROM ({_COLOC}) WHERE {key} IS NOT NULL GROUP BY 1, 2"""


_MEANS = ("colocalisation_h4_mean", "colocalisation_h3_mean", "colocalisation_clpp_mean")


@query(_rollup_sql("gene_id"))
def coloc_by_gene_id(t) -> DataFrame:
    return coloc_rollup(_coloc(t), "gene_id").withColumns({c: r6(c) for c in _MEANS})


@query(_rollup_sql("gene_symbol"))
def coloc_by_symbol(t) -> DataFrame:
    return coloc_rollup(_coloc(t), "gene_symbol").withColumns({c: r6(c) for c in _MEANS})


def _eva(t) -> DataFrame:
    score = lambda name, x: F.struct(F.lit(name).alias("id"), x.alias("score"))
    key = k("p_partkey") % 500
    scores = F.array(score("other", F.lit("9")), score(" EVA ", F.when(k("p_size") > 5, _text(k("p_retailprice") / 2000))), score("eva", F.when(k("p_size") % 3 != 0, _text(k("p_retailprice") / 4000))))
    target = F.struct(F.concat(F.lit("ENSG"), _text(key)).alias("id"), F.when(key % 4 != 0, F.concat(F.lit("g"), _text(key))).alias("approvedSymbol"))
    return R.associations(t("part").select(F.to_json(F.struct(_text(k("p_size")).alias("score"), target.alias("target"), scores.alias("datasourceScores"))).alias("json")), "eva")


_EVA = """SELECT gene_id, gene_symbol, max(s) AS s FROM (SELECT 'ENSG' || p_partkey % 500 AS gene_id, CASE WHEN p_partkey % 500 % 4 <> 0 THEN 'G' || p_partkey % 500 END AS gene_symbol,
    CASE WHEN p_size > 5 THEN p_retailprice / 2000 WHEN p_size % 3 <> 0 THEN p_retailprice / 4000 END AS s FROM part) WHERE s IS NOT NULL GROUP BY 1, 2"""


@query(f"SELECT gene_id, gene_symbol, round(s, 6) AS score FROM ({_EVA})")
def association_scores(t) -> DataFrame:
    return _eva(t).select("gene_id", "gene_symbol", r6("clinvar_eva_score").alias("score"))


@query(
    f"""WITH e AS ({_EVA}), a AS (SELECT gene_symbol AS k, max(s) AS s FROM e WHERE gene_symbol IS NOT NULL GROUP BY 1), b AS (SELECT gene_id AS k, max(s) AS s FROM e GROUP BY 1)
    SELECT c_custkey, round(CASE WHEN a.k IS NOT NULL THEN a.s ELSE b.s END, 6) AS score, CASE WHEN a.k IS NOT NULL THEN 'symbol' WHEN b.k IS NOT NULL THEN 'gene_id' ELSE 'unmatched' END AS status,
    (coalesce(CASE WHEN a.k IS NOT NULL THEN a.s ELSE b.s END, 0) >= 0.5)::INT AS label FROM customer LEFT JOIN a ON 'G' || c_custkey % 700 = a.k LEFT JOIN b ON 'ENSG' || c_custkey % 600 = b.k"""
)
def eva_labels(t) -> DataFrame:
    """Symbol first, id as fallback; the highest score of each key; label at the threshold."""
    from ..operators import joins

    e = _eva(t)
    best = lambda c, name: e.where(F.col(c).isNotNull()).groupBy(F.col(c).alias(name)).agg(F.max("clinvar_eva_score").alias("score"))
    genes = t("customer").select("c_custkey", S.gene_symbol(F.concat(F.lit("g"), _text(k("c_custkey") % 700))).alias("symbol"), F.concat(F.lit("ENSG"), _text(k("c_custkey") % 600)).alias("id"))
    out = joins.fallback_join(genes, best("gene_symbol", "k1"), best("gene_id", "k2"), k("symbol"), k("id"), ["score"], ("symbol", "gene_id"))
    return out.select("c_custkey", r6("score").alias("score"), "status", (F.coalesce("score", F.lit(0.0)) >= 0.5).cast("int").alias("label"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN s_name IS NOT NULL THEN upper(trim(s_name)) END ELSE p_name END AS gene_symbol FROM part LEFT JOIN supplier ON p_partkey % 200 = s_suppkey")
def resolved_symbols(t) -> DataFrame:
    records = t("part").select("p_partkey", (k("p_partkey") % 200).alias("gene_id"), F.when(k("p_partkey") % 3 != 0, k("p_name")).alias("gene_symbol"))
    return R.with_resolved_symbols(records, t("supplier").select(k("s_suppkey").alias("gene_id"), k("s_name").alias("symbol"))).select("p_partkey", "gene_symbol")


def _ot(t) -> DataFrame:
    missing = lambda c, m: F.when(k("c_custkey") % m == 0, "No data").otherwise(_text(k(c)))
    return t("customer").select(F.concat(F.lit(" seg"), _text(k("c_custkey") % 90)).alias("symbol"), missing("c_acctbal", 5).alias("globalScore"), missing("c_nationkey", 3).alias("europepmc"))


_OT = "SELECT 'SEG' || c_custkey % 90 AS gene, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS g, CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey END AS e FROM customer"


@query(f'SELECT gene, round(max(coalesce(g, 0)), 6) AS "globalScore", max(coalesce(e, 0))::DOUBLE AS europepmc FROM ({_OT}) GROUP BY 1')
def evidence_wide(t) -> DataFrame:
    return R.wide_scores(_ot(t), "symbol", ["globalScore", "europepmc"]).withColumn("globalScore", r6("globalScore"))


@query(f'SELECT gene, round(max(g), 6) AS "globalScore", max(e)::DOUBLE AS europepmc FROM ({_OT}) WHERE g IS NOT NULL GROUP BY 1')
def evidence_wide_missing(t) -> DataFrame:
    return R.wide_scores(_ot(t), "symbol", ["globalScore", "europepmc"], True, "globalScore").withColumn("globalScore", r6("globalScore"))


@query("SELECT 'E' || p_partkey % 60 AS symbol, array_to_string(list_sort(list_distinct(list('ENSG' || p_partkey % 250))), '|') AS ids FROM part WHERE p_size % 4 <> 0 GROUP BY 1")
def symbol_id_sets(t) -> DataFrame:
    rows = t("part").select(F.concat(F.lit("e"), _text(k("p_partkey") % 60)).alias("symbol"), F.when(k("p_size") % 4 != 0, F.concat(F.lit("ENSG"), _text(k("p_partkey") % 250), F.lit(".1"))).otherwise("LRG_1").alias("gene"))
    return R.symbol_to_ids(rows, "symbol", "gene").select("symbol", F.array_join("ids", "|").alias("ids"))


@query("""SELECT p_brand AS key, arg_min(p_name, (CASE WHEN p_size % 5 = 0 THEN 0 ELSE 1 END) * 10000000 + p_partkey) AS value FROM part GROUP BY 1""")
def approved_first_map(t) -> DataFrame:
    return R.approved_first(t("part"), k("p_brand"), k("p_name"), F.when(k("p_size") % 5 == 0, " Approved").otherwise("withdrawn"), k("p_partkey"))


def _aliases(t) -> DataFrame:
    source = F.when(k("l_linenumber") == 1, "best").when(k("l_linenumber") == 2, "good").otherwise("rest")
    return t("lineitem").select(k("l_suppkey").alias("protein"), F.concat(F.lit("a"), _text(k("l_partkey") % 3)).alias("alias"), source.alias("source"), (k("l_orderkey") * 10 + k("l_linenumber")).alias("o"))


_ALIASES = "SELECT l_suppkey AS protein, 'A' || l_partkey % 3 AS gene, l_linenumber AS r, l_orderkey * 10 + l_linenumber AS o FROM lineitem WHERE l_linenumber <= 2"


@query(f"SELECT protein, arg_min(gene, r * 1000000000 + o) AS gene FROM ({_ALIASES}) GROUP BY 1")
def alias_genes(t) -> DataFrame:
    a = _aliases(t)
    return R.alias_map(a, F.col("o"), ["best", "good"])[0]


@query(
    f"""WITH a AS ({_ALIASES}), p AS (SELECT *, min(r) OVER w AS least, min(r * 1000000000 + o) OVER w AS first FROM a WINDOW w AS (PARTITION BY protein ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT count(*) AS usable, count(DISTINCT protein) AS mapped, count(*) FILTER (r < least) AS replaced,
    count(*) FILTER (r = least AND gene <> (SELECT b.gene FROM a b WHERE b.protein = p.protein AND b.r * 1000000000 + b.o = p.first)) AS conflicts FROM p"""
)
def alias_conflicts(t) -> DataFrame:
    a = _aliases(t)
    return R.alias_map(a, F.col("o"), ["best", "good"])[1]


def _go(t) -> DataFrame:
    targets = F.concat(F.lit("ENSG"), _text(k("p_partkey") % 90), F.lit("; ENSG"), _text(k("p_size")), F.lit(".3;bad;"), F.when(k("p_size") % 2 == 0, F.concat(F.lit("ENSG"), _text(k("p_partkey") % 90))).otherwise(""))
    return t("part").select(F.concat(F.lit(" GO:"), _text(k("p_partkey") % 300)).alias("term"), k("p_brand").alias("name"), F.when(k("p_size") != 7, targets).alias("targets"), "p_partkey")


_GO = "SELECT 'GO:' || p_partkey % 300 AS term, p_brand AS name, list_distinct(['ENSG' || p_partkey % 90, 'ENSG' || p_size]) AS genes, p_partkey AS o FROM part WHERE p_size <> 7"


@query(f"SELECT term, count(DISTINCT g) AS genes FROM (SELECT term, unnest(genes) AS g FROM ({_GO})) GROUP BY 1")
def go_term_sizes(t) -> DataFrame:
    return R.go_terms(_go(t), "term", "name", "targets", k("p_partkey"))[0].groupBy("term").agg(F.count("*").alias("genes"))


@query(f"SELECT term, name, arg_min(len(genes), o)::INT AS size FROM ({_GO}) GROUP BY 1, 2")
def go_term_names(t) -> DataFrame:
    return R.go_terms(_go(t), "term", "name", "targets", k("p_partkey"))[1]


@query("SELECT p_brand AS module, count(DISTINCT 'ENSG' || p_partkey % 400) AS size, (count(DISTINCT p_partkey % 400) >= 8)::INT AS kept FROM part GROUP BY 1")
def module_sizes(t) -> DataFrame:
    rows = t("part").select(F.concat(F.lit("ENSG"), _text(k("p_partkey") % 400), F.lit("."), _text(k("p_size"))).alias("gene"), "p_brand")
    return R.modules(rows, "gene", "p_brand", 8)[1]


@query("SELECT 'ENSG' || o_custkey % 300 AS gene, round(arg_min(o_totalprice, o_orderkey), 6) AS score FROM orders WHERE o_orderkey % 6 <> 0 GROUP BY 1")
def first_scores(t) -> DataFrame:
    rows = t("orders").select(F.concat(F.lit("ENSG"), _text(k("o_custkey") % 300), F.lit(".4")).alias("gene"), F.when(k("o_orderkey") % 6 == 0, "nan").otherwise(_text(k("o_totalprice"))).alias("score"), "o_orderkey")
    return R.score_series(rows, "gene", "score", k("o_orderkey")).withColumn("score", r6("score"))


@query("SELECT DISTINCT upper(trim(p_name)) AS gene FROM part WHERE p_size >= 20")
def universe_genes(t) -> DataFrame:
    return R.gene_universe(t("part").select(F.concat(F.lit(" "), F.lower("p_name"), F.lit(" ")).alias("g"), "p_size"), "g", "p_size", 20)


@query("SELECT term, CASE WHEN term % 3 = 0 THEN 'word' || term WHEN term % 3 = 1 THEN 'Word' || term WHEN term % 6 = 2 THEN 'WORD' || term END AS found FROM (SELECT s_suppkey AS term FROM supplier)")
def resolved_keys(t) -> DataFrame:
    s = t("supplier").select(k("s_suppkey").alias("term"), F.concat(F.lit("Word"), _text(k("s_suppkey"))).alias("key"))
    spelled = F.when(k("term") % 3 == 0, F.lower("key")).when(k("term") % 3 == 1, k("key")).when(k("term") % 6 == 2, F.upper("key")).otherwise("none")
    return R.resolve_keys(s, "key", s.select(spelled.alias("w")).union(s.where("term % 3 = 0").select(F.upper("key"))), "w").select("term", "found")


@query(
    """WITH r AS (SELECT label % 5 AS key, CASE WHEN vec_id % 7 = 0 THEN embedding[1:8] ELSE embedding END AS v FROM embeddings), m AS (SELECT key, len(v) AS dim, count(*) AS n, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, len(v) DESC) AS p FROM r GROUP BY 1, 2),
    x AS (SELECT r.key, unnest(v)::DOUBLE AS x, generate_subscripts(v, 1) AS i FROM r JOIN m ON r.key = m.key AND len(v) = dim AND p = 1),
    a AS (SELECT key, i, avg(x) AS x FROM x GROUP BY 1, 2) SELECT a.key, any_value(dim)::INT AS dim, any_value(n) AS n, round(sum(x), 5) AS total, round(max(x), 6) AS largest FROM a JOIN m ON a.key = m.key AND p = 1 GROUP BY 1"""
)
def mean_vectors(t) -> DataFrame:
    e = t("embeddings").select((k("label") % 5).alias("key"), F.when(k("vec_id") % 7 == 0, F.slice("embedding", 1, 8)).otherwise(k("embedding")).alias("v"))
    out = R.mean_vector(e, "key", "v")
    return out.select("key", "dim", "n", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 5).alias("total"), r6(F.array_max("vector")).alias("largest"))
