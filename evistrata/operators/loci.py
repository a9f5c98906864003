"""Loci: their reference table, and the resolution of requested identifiers by five strategies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

STRATEGIES = ("exact_gwas_lead_variant_id", "exact_gwas_lead_variant_rsids", "robust_gwas_study_locus_id", "robust_canonical_variant_id", "robust_lead_chr_pos_unique")


def locus_reference(features: DataFrame, order: str) -> DataFrame:
    """features(locus, variant, rsids, chromosome, position, order) -> one row per locus: the first non-empty value of
    each by order, the union of its rsIDs, its canonical variant and its chromosome_position."""
    first = lambda c: S.first_filled(F.col(c).cast("string"), F.col(order))
    place = F.col("position").cast("string").try_cast("double")
    rows = features.withColumn("place__", F.when(~F.isnan(place) & (F.abs(place) < float("inf")), F.bround(place).cast("long").cast("string")))
    tokens = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), S.rsids(F.col("rsids")).alias("r")))), lambda x: F.coalesce(x["r"], F.array().cast("array<string>"))))
    out = rows.groupBy("locus").agg(first("variant").alias("variant"), F.array_distinct(tokens).alias("rsids"), first("chromosome").alias("chromosome"), first("place__").alias("position"))
    chromosome = S.locus_chromosome(F.col("chromosome"))
    spot = F.when(chromosome.isNotNull() & F.col("position").isNotNull(), F.concat_ws("_", chromosome, "position"))
    return out.withColumns({"canonical_variant": S.variant_id(F.col("variant")), "chr_pos": spot})


def resolve_loci(queries: DataFrame, reference: DataFrame) -> DataFrame:
    """queries(query, query_type) -> query, query_type, resolved, method, locus, variant, rsids, notes.

    The strategies are tried in order. One with a single locus resolves the query; one with several ends the search.
    Only equi-joins: each strategy turns a query into one key.
    """
    q = queries.withColumn("query", F.trim("query"))
    asked = [F.col("query"), S.rsid(F.col("query")), F.col("query"), S.variant_id(F.col("query")), S.position_id(F.col("query"))]
    held = [F.array(F.trim("variant")), F.col("rsids"), F.array(F.trim("locus")), F.array("canonical_variant"), F.array("chr_pos")]
    struct = lambda i, key: F.struct(F.lit(i).alias("i"), key.alias("key"))
    keys = q.select("query").distinct().select("query", F.explode(F.array(*[struct(i, a) for i, a in enumerate(asked)])).alias("x")).select("query", "x.i", "x.key").where("key <> ''")
    index = reference.select("locus", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), h.alias("keys")) for i, h in enumerate(held)])).alias("x")).select("locus", "x.i", F.explode("x.keys").alias("key")).where("key <> ''").distinct()
    hits = keys.join(index, ["i", "key"]).groupBy("query", "i").agg(F.sort_array(F.collect_set("locus")).alias("loci"))
    best = hits.groupBy("query").agg(F.min_by(F.struct("i", "loci"), "i").alias("m")).withColumn("locus", F.when(F.size("m.loci") == 1, F.col("m.loci")[0]))
    out = q.join(best, "query", "left").join(reference.select(F.col("locus").alias("l__"), "variant", "rsids"), F.col("locus") == F.col("l__"), "left")
    resolved = F.col("locus").isNotNull()
    several = F.size("m.loci") > 1
    note = (
        F.when(resolved, "").when((F.col("query_type") == "rsid") & S.rsid(F.col("query")).isNull(), "identifier_mismatch_invalid_rsid_format")
        .when(several, F.concat(F.lit("ambiguous_match_multiple_loci:"), F.array_join("m.loci", "|"))).otherwise("not_found_in_current_feature_table_for_study")
    )
    method = F.when(resolved, F.element_at(F.array(*[F.lit(s) for s in STRATEGIES]), F.col("m.i") + 1)).otherwise("unresolved")
    return out.select(
        "query", "query_type", resolved.cast("int").alias("resolved"), method.alias("method"), F.coalesce("locus", F.lit("")).alias("locus"),
        F.when(resolved, F.coalesce("variant", F.lit(""))).otherwise("").alias("variant"), F.when(resolved, F.array_join("rsids", "|")).otherwise("").alias("rsids"), note.alias("notes"),
    )
