"""Locus resolution, id mapping, joins and filters on the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as X
from ..operators import joins as J
from ..operators import loci, ranking
from .queries import query, r6

k = F.col


def _s(x) -> F.Column:
    return x.cast("string")


def _features(t) -> DataFrame:
    o = t("orders")
    base = F.concat(F.lit("chr"), _s(k("o_custkey") % 23 + 1), F.lit(":"), _s(k("o_orderkey") * 7), F.lit("_a/G"))
    return o.select(
        F.concat(F.lit("L"), _s(k("o_custkey"))).alias("locus"), F.when(k("o_orderkey") % 4 == 0, "").otherwise(base).alias("variant"), F.concat(F.lit("RS"), _s(k("o_orderkey") % 997), F.lit("; rs"), _s(k("o_custkey"))).alias("rsids"),
        F.concat(F.lit("chr"), _s(k("o_custkey") % 23 + 1)).alias("chromosome"), F.when(k("o_orderkey") % 3 == 0, "nan").otherwise(_s(k("o_custkey") % 400 + 0.4)).alias("position"), "o_orderkey",
    )


_LOCI = """SELECT 'L' || o_custkey AS locus, arg_min('chr' || (o_custkey % 23 + 1) || ':' || o_orderkey * 7 || '_a/G', o_orderkey) FILTER (o_orderkey % 4 <> 0) AS variant,
    arg_min(o_orderkey, o_orderkey) FILTER (o_orderkey % 4 <> 0) AS first_key, o_custkey AS c, list_distinct(list('rs' || o_orderkey % 997) || ['rs' || o_custkey]) AS rsids,
    CASE WHEN count(*) FILTER (o_orderkey % 3 <> 0) > 0 THEN o_custkey % 400 END AS pos FROM orders GROUP BY o_custkey"""
_REFERENCE = f"""SELECT locus, variant, rsids, (c % 23 + 1) || '_' || first_key * 7 || '_A_G' AS canonical_variant, (c % 23 + 1) || '_' || pos AS chr_pos FROM ({_LOCI})"""


@query(f"SELECT locus, variant, array_to_string(list_sort(rsids), '|') AS rsids, canonical_variant, chr_pos FROM ({_REFERENCE})")
def locus_table(t) -> DataFrame:
    r = loci.locus_reference(_features(t), "o_orderkey")
    return r.select("locus", "variant", F.array_join(F.array_sort("rsids"), "|").alias("rsids"), "canonical_variant", "chr_pos")


def _requests(t) -> DataFrame:
    c = k("c_custkey")
    asked = F.when(c % 5 == 0, F.concat(F.lit("chr"), _s(c % 23 + 1), F.lit(":"), _s(c * 7), F.lit("_a/G"))).when(c % 5 == 1, F.concat(F.lit(" RS"), _s(c))).when(c % 5 == 2, F.concat(F.lit("L"), _s(c)))
    asked = asked.when(c % 5 == 3, F.concat(_s(c % 23 + 1), F.lit("-"), _s(c * 7), F.lit(" A>g"))).otherwise(F.concat(F.lit("Chr"), _s(c % 23 + 1), F.lit(":"), _s(c % 800)))
    return t("customer").select(asked.alias("query"), F.when(c % 10 < 5, "variant_id").otherwise("rsid").alias("query_type"), "c_custkey")


_ASKED = """SELECT CASE c_custkey % 5 WHEN 0 THEN 'chr' || (c_custkey % 23 + 1) || ':' || c_custkey * 7 || '_a/G' WHEN 1 THEN 'RS' || c_custkey WHEN 2 THEN 'L' || c_custkey WHEN 3 THEN (c_custkey % 23 + 1) || '-' || c_custkey * 7 || ' A>g'
    ELSE 'Chr' || (c_custkey % 23 + 1) || ':' || c_custkey % 800 END AS query, CASE WHEN c_custkey % 10 < 5 THEN 'variant_id' ELSE 'rsid' END AS query_type,
    CASE WHEN c_custkey % 5 = 1 THEN 'rs' || c_custkey END AS rs, CASE WHEN c_custkey % 5 IN (0, 3) THEN (c_custkey % 23 + 1) || '_' || c_custkey * 7 || '_A_G' END AS canon,
    CASE WHEN c_custkey % 5 = 4 THEN (c_custkey % 23 + 1) || '_' || c_custkey % 800 END AS spot FROM customer"""


@query(
    f"""WITH ref AS ({_REFERENCE}), q AS ({_ASKED}), hit AS (SELECT query, 0 AS i, locus FROM q JOIN ref ON query = variant UNION SELECT query, 1, locus FROM q JOIN (SELECT locus, unnest(rsids) AS r FROM ref) ON rs = r
    UNION SELECT query, 2, locus FROM q JOIN ref ON query = locus UNION SELECT query, 3, locus FROM q JOIN ref ON canon = canonical_variant UNION SELECT query, 4, locus FROM q JOIN ref ON spot = chr_pos),
    g AS (SELECT query, i, count(*) AS n, min(locus) AS one, string_agg(locus, '|' ORDER BY locus) AS loci FROM hit GROUP BY 1, 2), m AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY i) AS p FROM g),
    a AS (SELECT q.query, query_type, rs, n, loci, i, CASE WHEN n = 1 THEN one END AS locus FROM q LEFT JOIN m ON q.query = m.query AND p = 1)
    SELECT a.query, a.query_type, (a.locus IS NOT NULL)::INT AS resolved, CASE WHEN a.locus IS NULL THEN 'unresolved' ELSE {list(loci.STRATEGIES)}[i + 1] END AS method, coalesce(a.locus, '') AS locus,
    CASE WHEN a.locus IS NULL THEN '' ELSE coalesce(variant, '') END AS variant, CASE WHEN a.locus IS NULL THEN 0 ELSE len(rsids) END AS n_rsids,
    CASE WHEN a.locus IS NOT NULL THEN '' WHEN query_type = 'rsid' AND rs IS NULL THEN 'identifier_mismatch_invalid_rsid_format' WHEN n > 1 THEN 'ambiguous_match_multiple_loci:' || loci
    ELSE 'not_found_in_current_feature_table_for_study' END AS notes FROM a LEFT JOIN ref ON a.locus = ref.locus"""
)
def locus_resolution(t) -> DataFrame:
    out = loci.resolve_loci(_requests(t).drop("c_custkey"), loci.locus_reference(_features(t), "o_orderkey"))
    return out.withColumn("n_rsids", F.when(k("rsids") == "", 0).otherwise(F.size(F.split("rsids", r"\|"))).cast("long")).drop("rsids")


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'X_' || p_partkey || '_A_GT' END AS variant, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'MT_' || p_partkey END AS position, 'rs' || p_partkey || '|rs' || p_size AS rsids,
    CASE WHEN p_partkey % 5 = 0 THEN 'id' || p_partkey WHEN p_partkey % 5 = 1 THEN p_name ELSE '__missing_gene_row_' || p_partkey END AS gene, CASE WHEN p_partkey % 2 = 0 THEN 1.0 WHEN p_partkey % 3 = 0 THEN 0.0 WHEN p_partkey % 5 = 0 THEN -1.0 ELSE p_size END AS number
    FROM part WHERE p_partkey <> p_size"""
)
def parsed_variants(t) -> DataFrame:
    p, key = t("part").where("p_partkey <> p_size"), _s(k("p_partkey"))
    variant = F.when(k("p_partkey") % 4 != 0, F.concat(F.lit(" chrX:00"), key, F.lit("-a/>gt"))).otherwise(F.concat(F.lit("X:"), key, F.lit("-a/>u")))
    position = F.when(k("p_partkey") % 3 != 0, F.concat(F.lit("m_"), key)).otherwise(F.concat(F.lit("m__"), key))
    number = F.when(k("p_partkey") % 2 == 0, " Yes").when(k("p_partkey") % 3 == 0, "f").when(k("p_partkey") % 5 == 0, "No data").otherwise(_s(k("p_size")))
    gene = S.gene_key(F.when(k("p_partkey") % 5 == 0, F.concat(F.lit(" id"), key)).otherwise("nan"), F.when(k("p_partkey") % 5 == 1, k("p_name")).otherwise(" "), k("p_partkey"))
    rs = F.concat(F.lit("xRS"), key, F.lit(" rs"), _s(k("p_size")), F.lit(",rs"), key)
    return p.select("p_partkey", S.variant_id(variant).alias("variant"), S.position_id(position).alias("position"), F.array_join(S.rsids(rs), "|").alias("rsids"), gene.alias("gene"), S.numeric_feature(number, -1.0).alias("number"))


@query(
    """WITH f AS (SELECT l_orderkey, list(l_returnflag ORDER BY l_linenumber, l_partkey, l_extendedprice) AS l FROM lineitem GROUP BY 1)
    SELECT l_orderkey, array_to_string(list_sort(list_distinct(l)), '') AS flags, l[1] AS first_flag, len(list_distinct(l)) AS n FROM f"""
)
def ordered_flags(t) -> DataFrame:
    out = t("lineitem").groupBy("l_orderkey").agg(S.ordered_join(k("l_returnflag"), F.struct("l_linenumber", "l_partkey", "l_extendedprice")).alias("j"))
    flags = F.split("j", r"\|")
    return out.select("l_orderkey", F.array_join(F.array_sort(flags), "").alias("flags"), flags[0].alias("first_flag"), F.size(flags).cast("long").alias("n"))


@query(
    """WITH m AS (SELECT max(l_quantity * l_discount) AS most, ln(min(CASE WHEN l_discount > 0 THEN l_quantity * l_discount END)) AS lo, ln(max(CASE WHEN l_discount > 0 THEN l_quantity * l_discount END)) AS hi FROM lineitem)
    SELECT l_orderkey, l_linenumber, round(l_quantity * l_discount / most, 6) AS linear, round(CASE WHEN l_quantity * l_discount > 0 THEN (ln(l_quantity * l_discount) - lo) / (hi - lo) ELSE 0 END, 6) AS log_scaled FROM lineitem, m"""
)
def attention_weights(t) -> DataFrame:
    li = t("lineitem").select("l_orderkey", "l_linenumber", (k("l_quantity") * k("l_discount")).alias("w"))
    ends = li.agg(F.max("w").alias("most"), F.ln(F.min(F.when(k("w") > 0, k("w")))).alias("lo"), F.ln(F.max(F.when(k("w") > 0, k("w")))).alias("hi"))
    linear, scaled = S.attention_rescale(k("w"), k("most"), k("lo"), k("hi"))
    return li.join(F.broadcast(ends)).select("l_orderkey", "l_linenumber", r6(linear).alias("linear"), r6(scaled).alias("log_scaled"))


@query(
    """SELECT p_partkey, round(coalesce(max(embedding[1])::DOUBLE, -1.0), 6) AS first, (count(vec_id) > 0)::INT AS has_vector FROM part LEFT JOIN embeddings ON p_partkey = vec_id AND vec_id % 3 <> 0 GROUP BY 1"""
)
def vector_lookup(t) -> DataFrame:
    e = t("embeddings")
    dim = len(e.first()["embedding"])
    v = e.select(k("vec_id").alias("key"), F.when(k("vec_id") % 3 != 0, k("embedding").cast("array<double>")).otherwise(F.array(F.lit(1.0))).alias("vector"))
    return J.lookup_with_fill(t("part").select("p_partkey"), "p_partkey", v, dim, -1.0).select("p_partkey", r6(F.col("vector")[0]).alias("first"), "has_vector")


@query("SELECT n_nationkey, n_name, n_regionkey, r_name AS n_name_region FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey <> 2")
def suffixed_names(t) -> DataFrame:
    r = t("region").where("r_regionkey <> 2").select(k("r_regionkey").alias("n_regionkey"), k("r_name").alias("n_name"))
    return J.suffixed_join(t("nation").select("n_nationkey", "n_name", "n_regionkey"), r, "n_regionkey", "_region")


@query("WITH a AS (SELECT s_nationkey AS node, avg(s_acctbal) + 5000 AS v FROM supplier GROUP BY 1), c AS (SELECT c_nationkey AS node, avg(c_acctbal) + 5000 AS v FROM customer GROUP BY 1) SELECT a.node, round(ln(c.v) - ln(a.v), 6) AS log_ratio FROM a JOIN c USING (node)")
def background_normalized(t) -> DataFrame:
    """Logarithm of the score over its background, on the background's keys."""
    from ..operators import graph

    mean = lambda d, p: d.groupBy(k(f"{p}_nationkey").alias("node")).agg((F.avg(f"{p}_acctbal") + 5000).alias("score"))
    out = graph.background_normalized(mean(t("customer"), "c"), mean(t("supplier"), "s"))
    return out.select("node", r6("log_ratio").alias("log_ratio"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN p_brand ELSE p_type END AS gene_id, CASE p_size % 3 WHEN 0 THEN 'missing' WHEN 1 THEN 'hpa' ELSE 'hgnc' END AS id_source FROM part")
def id_provenance(t) -> DataFrame:
    choices = {"hpa": F.when(k("p_size") % 3 == 1, k("p_brand")), "hgnc": F.when(k("p_size") % 3 > 0, k("p_type"))}
    return J.coalesced_id(t("part"), choices).select("p_partkey", "gene_id", "id_source")


_CENTRES = "SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1 HAVING label IN (SELECT label FROM embeddings GROUP BY 1 HAVING count(*) >= 3)"


def _centres(t) -> DataFrame:
    e = t("embeddings").select(k("label").alias("key"), k("embedding").alias("v"))
    enough = e.groupBy("key").agg(F.count("*").alias("n")).where("n >= 3").select("key")
    from ..sources.records import mean_vector

    return mean_vector(e.join(enough, "key", "left_semi"), "key", "v").select(k("key").alias("label"), "vector")


def _distance(a, b) -> F.Column:
    d = F.zip_with(a, b, lambda x, y: x - y)
    return S.norm(d)


@query(f"WITH c AS ({_CENTRES}) SELECT a.label AS a, b.label AS b, round(list_distance(a.c, b.c), 6) AS distance FROM c a JOIN c b ON a.label < b.label")
def centroid_pairs(t) -> DataFrame:
    p = J.unordered_pairs(_centres(t), "label")
    return p.select(k("a.label").alias("a"), k("b.label").alias("b"), r6(_distance(k("a.vector"), k("b.vector"))).alias("distance"))


@query(f"WITH c AS ({_CENTRES}), d AS (SELECT a.label AS a, b.label AS b, round(list_distance(a.c, b.c), 9) AS d FROM c a JOIN c b ON a.label <> b.label) SELECT * FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY d, b) AS \"rank\" FROM d) WHERE \"rank\" <= 3")
def centroid_neighbours(t) -> DataFrame:
    c = _centres(t)
    pairs = J.unordered_pairs(c, "label").select(k("a.label").alias("a"), k("b.label").alias("b"), (-F.round(_distance(k("a.vector"), k("b.vector")), 9)).alias("s"))
    near = pairs.union(pairs.select(k("b").alias("a"), k("a").alias("b"), "s"))
    return ranking.top_k(near, ["a"], "s", ["b"], 3).select("a", "b", F.col("rank").cast("long").alias("rank"))


@query(f"WITH c AS ({_CENTRES}), d AS (SELECT a.label AS a, b.label AS b, round(list_distance(a.c, b.c), 9) AS d FROM c a JOIN c b ON a.label < b.label) (SELECT 'closest' AS side, a, b FROM d ORDER BY d, a, b LIMIT 15) UNION ALL (SELECT 'farthest', a, b FROM d ORDER BY d DESC, a, b LIMIT 15)")
def extreme_pairs(t) -> DataFrame:
    p = J.unordered_pairs(_centres(t), "label").select(k("a.label").alias("a"), k("b.label").alias("b"), F.round(_distance(k("a.vector"), k("b.vector")), 9).alias("d"))
    end = lambda order, name: p.orderBy(order, "a", "b").limit(15).select(F.lit(name).alias("side"), "a", "b")
    return end(F.asc("d"), "closest").union(end(F.desc("d"), "farthest"))


@query("SELECT n, metric, size FROM (SELECT unnest([5, 10, 15]) AS n), (SELECT unnest(['cosine', 'euclidean']) AS metric), (SELECT n_nationkey AS size FROM nation)")
def parameter_grid(t) -> DataFrame:
    n = t("nation")
    return J.grid(n.sparkSession, n=[5, 10, 15], metric=["cosine", "euclidean"]).select(k("n").cast("int").alias("n"), "metric").crossJoin(F.broadcast(n.select(k("n_nationkey").alias("size"))))


@query("SELECT o_custkey, string_agg(o_orderkey::VARCHAR, '|' ORDER BY o_orderkey) AS loci FROM orders GROUP BY 1")
def reverse_lookup(t) -> DataFrame:
    held = F.array_sort(F.collect_set("o_orderkey"))
    return t("orders").groupBy("o_custkey").agg(F.array_join(F.transform(held, lambda x: x.cast("string")), "|").alias("loci"))


@query(
    """WITH i AS (SELECT DISTINCT 'E' || l_partkey AS id FROM lineitem), v AS (SELECT DISTINCT 'E' || l_partkey AS id FROM lineitem WHERE l_linenumber % 2 = 0), n AS (SELECT 'E' || p_partkey AS id FROM part WHERE p_size > 10),
    m AS (SELECT id, id IN (FROM n) AS hit FROM i) SELECT (SELECT count(*) FROM i) AS n_ids, (SELECT count(*) FROM v) AS n_versioned, count(*) FILTER (hit) AS n_mapped, count(*) FILTER (NOT hit) AS n_unmapped,
    (SELECT string_agg(id, '|') FROM (SELECT id FROM m WHERE hit ORDER BY id LIMIT 10)) AS mapped_sample, (SELECT string_agg(id, '|') FROM (SELECT id FROM m WHERE NOT hit ORDER BY id LIMIT 10)) AS unmapped_sample FROM m"""
)
def node_mapping(t) -> DataFrame:
    ids = t("lineitem").select(F.concat(F.lit(" E"), _s(k("l_partkey")), F.when(k("l_linenumber") % 2 == 0, ".4").otherwise("")).alias("g"))
    return J.mapping_report(ids, "g", t("part").where("p_size > 10").select(F.concat(F.lit("E"), _s(k("p_partkey"))).alias("n")), "n")


@query(
    """WITH a AS (SELECT l_partkey AS g, max(l_quantity) AS x FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey AS g, max(l_discount) AS y FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT g, x, y, coalesce((p_size > 40)::INT, 0) AS label FROM a JOIN b USING (g) LEFT JOIN (SELECT * FROM part WHERE p_size > 20) ON g = p_partkey"""
)
def score_scatter(t) -> DataFrame:
    """Scores of two methods on shared ids, with labels, 0 where unlabelled."""
    best = lambda flag, c, n: t("lineitem").where(k("l_returnflag") == flag).groupBy(k("l_partkey").alias("g")).agg(F.max(c).alias(n))
    label = t("part").where("p_size > 20").select(k("p_partkey").alias("g"), (k("p_size") > 40).cast("int").alias("label"))
    return best("A", "l_quantity", "x").join(best("R", "l_discount", "y"), "g").join(label, "g", "left").fillna(0, ["label"])


@query(
    """SELECT doc_id, len(regexp_extract_all(text, '(?i)\\bthe\\b')) AS marks, contains(lower(text), 'license') AS has_license FROM documents"""
)
def highlighted(t) -> DataFrame:
    marked = X.highlight(F.col("text"), "the")
    return t("documents").select("doc_id", ((F.char_length(marked) - F.char_length("text")) / 4).cast("long").alias("marks"), X.mentions(F.col("text"), "license").alias("has_license"))


@query("SELECT o_custkey, array_to_string(list_distinct(list(o_orderpriority)), '') IS NOT NULL AS some, len(list_distinct(list(o_orderpriority))) AS n, arg_min(o_orderpriority, o_orderkey) AS first FROM orders GROUP BY 1")
def distinct_in_order(t) -> DataFrame:
    lists = t("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.array("o_orderpriority").alias("p")))).alias("l"))
    flat = X.distinct_flat(F.transform("l", lambda x: x["p"]))
    return lists.select("o_custkey", F.lit(True).alias("some"), F.size(flat).cast("long").alias("n"), flat[0].alias("first"))
