"""Row parsers for nested API records and identifier tables: JSON in, flat typed rows out.

Nothing here opens a connection: a crawler's pages land as JSON (one record a row) and these turn them into tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

VARIANT = "struct<id:string,rsIds:array<string>,chromosome:string,position:string>"
CREDIBLE_SET = (
    "struct<studyLocusId:string,studyId:string,studyType:string,chromosome:string,position:string,region:string,credibleSetIndex:string,pValueMantissa:string,"
    f"pValueExponent:string,beta:string,zScore:string,confidence:string,locusStart:string,locusEnd:string,qualityControls:array<string>,variant:{VARIANT}>"
)
STUDY = "struct<id:string,studyType:string,projectId:string,traitFromSource:string,condition:string,biosample:struct<biosampleId:string,biosampleName:string>,target:struct<id:string,approvedSymbol:string>>"
COLOCALISATION = (
    "struct<h3:string,h4:string,clpp:string,numberColocalisingVariants:string,colocalisationMethod:string,"
    f"otherStudyLocus:struct<studyLocusId:string,studyId:string,studyType:string,qtlGeneId:string,isTransQtl:string,subStudyDescription:string,study:{STUDY}>>"
)
ASSOCIATION = "struct<score:string,target:struct<id:string,approvedSymbol:string>,datasourceScores:array<struct<id:string,score:string>>>"


def joined_set(values: Column) -> Column:
    """Distinct non-blank values of an array, sorted, joined by "|"; "" for none."""
    trimmed = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.trim(x))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(trimmed, lambda x: x.isNotNull() & (x != "")))), "|")


def parsed(raw: DataFrame, column: str, schema: str, *others: Column) -> DataFrame:
    """raw with `r`, its JSON parsed once: the fields taken from r above can't have the parser run again."""
    return raw.select(*others, F.explode(F.array(F.from_json(column, schema))).alias("r"))


def credible_sets(raw: DataFrame, column: str = "json") -> DataFrame:
    """raw(json) -> one row of 19 columns for each credible set."""
    r = parsed(raw, column, CREDIBLE_SET).select("r.*")
    return r.select(
        F.col("studyLocusId").alias("study_locus_id"), F.col("studyId").alias("study_id"), F.col("studyType").alias("study_type"), S.chromosome(F.col("chromosome")).alias("chromosome"),
        S.to_long(F.col("position")).alias("position"), "region", S.to_long(F.col("credibleSetIndex")).alias("credible_set_index"), S.to_double(F.col("pValueMantissa")).alias("p_value_mantissa"),
        S.to_long(F.col("pValueExponent")).alias("p_value_exponent"), S.to_double(F.col("beta")).alias("beta"), S.to_double(F.col("zScore")).alias("z_score"), "confidence",
        S.to_long(F.col("locusStart")).alias("locus_start"), S.to_long(F.col("locusEnd")).alias("locus_end"), joined_set(F.col("qualityControls")).alias("quality_controls"),
        F.col("variant.id").alias("lead_variant_id"), joined_set(F.col("variant.rsIds")).alias("lead_variant_rsids"), S.chromosome(F.col("variant.chromosome")).alias("lead_variant_chromosome"),
        S.to_long(F.col("variant.position")).alias("lead_variant_position"),
    )


def filled(*columns: str) -> Column:
    """The first of the columns that is neither null nor empty."""
    return F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in columns])


def colocalisations(raw: DataFrame, locus: str = "gwas_study_locus_id", column: str = "json", study_types: Sequence[str] = ()) -> DataFrame:
    """raw(locus, json) -> 18 columns; records without a QTL locus id, or of other study types, are dropped."""
    r = parsed(raw, column, COLOCALISATION, F.col(locus).alias("gwas_study_locus_id"))
    o, s = "r.otherStudyLocus", "r.otherStudyLocus.study"
    out = r.select(
        "gwas_study_locus_id", F.col(f"{o}.studyLocusId").alias("qtl_study_locus_id"), filled(f"{o}.studyId", f"{s}.id").alias("qtl_study_id"), filled(f"{o}.studyType", f"{s}.studyType").alias("qtl_study_type"),
        S.gene_id(filled(f"{s}.target.id", f"{o}.qtlGeneId")).alias("gene_id"), S.gene_symbol(F.col(f"{s}.target.approvedSymbol")).alias("gene_symbol"), S.to_bool(F.col(f"{o}.isTransQtl")).alias("qtl_is_trans_qtl"),
        F.col(f"{o}.subStudyDescription").alias("qtl_sub_study_description"), F.col(f"{s}.projectId").alias("qtl_project_id"), F.col(f"{s}.traitFromSource").alias("qtl_trait_from_source"),
        F.col(f"{s}.condition").alias("qtl_condition"), F.col(f"{s}.biosample.biosampleId").alias("qtl_biosample_id"), F.col(f"{s}.biosample.biosampleName").alias("qtl_biosample_name"),
        S.to_double(F.col("r.h3")).alias("colocalisation_h3"), S.to_double(F.col("r.h4")).alias("colocalisation_h4"), S.to_double(F.col("r.clpp")).alias("colocalisation_clpp"),
        S.to_long(F.col("r.numberColocalisingVariants")).alias("number_colocalising_variants"), F.col("r.colocalisationMethod").alias("colocalisation_method"),
    )
    out = out.where(F.coalesce(F.col("qtl_study_locus_id"), F.lit("")) != "")
    return out.where(F.col("qtl_study_type").isin(*study_types)) if study_types else out


def associations(raw: DataFrame, datasource: str, column: str = "json") -> DataFrame:
    """raw(json) -> gene_id, gene_symbol, clinvar_eva_score, association_score_global: per target the first non-null score
    of the datasource (whatever its case), targets without one dropped, the highest row of each (gene_id, gene_symbol)."""
    r = parsed(raw, column, ASSOCIATION)
    mine = F.filter("r.datasourceScores", lambda d: (F.lower(F.trim(d["id"])) == datasource.strip().lower()) & S.to_double(d["score"]).isNotNull())
    rows = r.select(S.gene_id(F.col("r.target.id")).alias("gene_id"), S.gene_symbol(F.col("r.target.approvedSymbol")).alias("gene_symbol"), S.to_double(F.get(mine, F.lit(0))["score"]).alias("s"), S.to_double(F.col("r.score")).alias("g"))
    best = rows.where("s is not null").groupBy("gene_id", "gene_symbol").agg(F.max(F.struct("s", "g")).alias("b"))
    return best.select("gene_id", "gene_symbol", F.col("b.s").alias("clinvar_eva_score"), F.col("b.g").alias("association_score_global"))


def with_resolved_symbols(records: DataFrame, lookup: DataFrame) -> DataFrame:
    """records(gene_id, gene_symbol, ...) with missing symbols filled from lookup(gene_id, symbol)."""
    known = lookup.select(F.col("gene_id").alias("id__"), S.gene_symbol(F.col("symbol")).alias("symbol__")).where("symbol__ is not null").groupBy("id__").agg(F.min("symbol__").alias("symbol__"))
    out = records.join(known, records.gene_id == F.col("id__"), "left").withColumn("gene_symbol", F.coalesce("gene_symbol", "symbol__"))
    return out.select(*records.columns)


def wide_scores(table: DataFrame, symbol: str, sources: Sequence[str], keep_missing: bool = False, required: str | None = None) -> DataFrame:
    """One row per upper-cased symbol with the highest value of each source. Text that is no number ("No data") counts as 0,
    or as missing with keep_missing; rows whose `required` source is missing are then dropped."""
    value = lambda c: S.to_double(F.col(c)) if keep_missing else F.coalesce(S.to_double(F.col(c)), F.lit(0.0))
    rows = table.select(S.gene_symbol(F.col(symbol)).alias("gene"), *[value(c).alias(c) for c in sources]).where("gene is not null")
    if required:
        rows = rows.where(F.col(required).isNotNull())
    return rows.groupBy("gene").agg(*[F.max(c).alias(c) for c in sources])


def symbol_to_ids(table: DataFrame, symbol: str, gene_id: str) -> DataFrame:
    """(symbol, ids): the sorted set of strict ids of each symbol."""
    rows = table.select(S.gene_symbol(F.col(symbol)).alias("symbol"), S.gene_id(F.col(gene_id), "strict").alias("id")).where("symbol is not null and id is not null")
    return rows.groupBy("symbol").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def approved_first(table: DataFrame, key: Column, value: Column, status: Column, order: Column) -> DataFrame:
    """(key, value): of each key the first row whose status is "approved", else the first row, by order."""
    rows = table.select(key.alias("key"), value.alias("value"), (F.lower(F.trim(F.coalesce(status, F.lit("")))) != "approved").alias("later"), order.alias("o")).where("key is not null and value is not null")
    return rows.groupBy("key").agg(F.min_by("value", F.struct("later", "o")).alias("value"))


def alias_map(aliases: DataFrame, order: Column, preferred: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """aliases(protein, alias, source) -> (protein, gene): the first alias of the best source; and one row of counts.

    A better source replaces a worse one; other aliases of the same source are counted as conflicts while it is the best.
    """
    rank = F.coalesce(*[F.when(F.col("source") == s, F.lit(i)) for i, s in enumerate(preferred)])
    hits = aliases.select("protein", S.gene_symbol(F.col("alias")).alias("gene"), rank.alias("rank"), order.alias("o")).where("rank is not null")
    good = hits.where("gene is not null")
    best = good.groupBy("protein").agg(F.min_by("gene", F.struct("rank", "o")).alias("gene"))
    w = Window.partitionBy("protein").orderBy("o")
    upto = good.withColumn("least", F.min("rank").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    upto = upto.withColumn("held", F.min_by("gene", F.struct("rank", "o")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    counts = upto.agg(
        F.count("*").alias("usable"), F.countDistinct("protein").alias("mapped"), F.count_if(F.col("rank") < F.col("least")).alias("replaced"),
        F.count_if((F.col("rank") == F.col("least")) & (F.col("gene") != F.col("held"))).alias("conflicts"),
    )
    return best, counts


def go_terms(table: DataFrame, term: str, name: str, targets: str, order: Column) -> tuple[DataFrame, DataFrame]:
    """(term, gene) pairs, rows of one term united, and (term, name, size): the first row of each (term, name)."""
    ids = F.array_distinct(F.filter(F.transform(F.split(F.coalesce(targets, F.lit("")), ";"), lambda x: S.gene_id(x)), lambda x: x.isNotNull() & x.startswith("ENSG")))
    rows = table.select(F.trim(term).alias("term"), F.trim(name).alias("name"), ids.alias("genes"), order.alias("o")).where("term <> '' and name <> '' and size(genes) > 0")
    meta = rows.groupBy("term", "name").agg(F.min_by(F.size("genes"), "o").alias("size"))
    return rows.select("term", F.explode("genes").alias("gene")).distinct(), meta


def modules(table: DataFrame, gene: str, cluster: str, least: int) -> tuple[DataFrame, DataFrame]:
    """(module, gene) of modules with at least `least` genes, and (module, size, kept) of all."""
    rows = table.select(F.trim(F.col(cluster).cast("string")).alias("module"), S.gene_id(F.col(gene)).alias("gene")).where("gene is not null and module <> ''").distinct()
    sizes = rows.groupBy("module").agg(F.count("*").alias("size")).withColumn("kept", (F.col("size") >= least).cast("int"))
    return rows.join(sizes.where("kept = 1").select("module"), "module", "left_semi"), sizes


def score_series(table: DataFrame, gene: str, score: str, order: Column) -> DataFrame:
    """(gene, score): normalised ids, numeric scores, the first row of each id."""
    rows = table.select(S.gene_id(F.col(gene)).alias("gene"), S.to_double(F.col(score)).alias("score"), order.alias("o")).where("gene is not null and score is not null")
    return rows.groupBy("gene").agg(F.min_by("score", "o").alias("score"))


def gene_universe(table: DataFrame, gene: str, count: str | None = None, least: int = 0) -> DataFrame:
    rows = table.where(F.col(count) >= least) if count else table
    return rows.select(S.gene_symbol(F.col(gene)).alias("gene")).where("gene is not null").distinct()


def resolve_keys(wanted: DataFrame, key: str, vocabulary: DataFrame, word: str) -> DataFrame:
    """wanted with `found`: the vocabulary's spelling of the key, tried in lower case, as it is, in upper case."""
    tries = wanted.withColumn("try__", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), f(F.col(key)).alias("w")) for i, f in enumerate((F.lower, F.trim, F.upper))])))
    hit = tries.join(vocabulary.select(F.col(word).alias("word__")).distinct(), F.col("try__.w") == F.col("word__"))
    best = hit.groupBy(F.col(key).alias("k__")).agg(F.min_by("word__", "try__.i").alias("found"))
    return wanted.join(best, wanted[key].eqNullSafe(F.col("k__")), "left").drop("k__")


def pick_column(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """The first candidate whose name, cleaned of case and punctuation, is that of a column."""
    clean = lambda c: "".join(x for x in c.lower() if x.isalnum())
    by = {clean(c): c for c in reversed(columns)}
    return next((by[clean(c)] for c in candidates if clean(c) in by), None)


def mean_vector(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """vectors(key, vector), any number of rows a key -> (key, dim, n, vector): the mean over the rows of the key's most
    frequent length (ties: the longer), non-finite components left out, 0 where none is left."""
    rows = vectors.where(F.size(vector) > 0).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"), F.size(vector).alias("dim"))
    modal = rows.groupBy("key", "dim").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by(F.struct("dim", "n"), F.struct("n", "dim")).alias("m")).select("key", "m.dim", "m.n")
    parts = rows.join(modal.select("key", "dim"), ["key", "dim"]).select("key", F.posexplode("v").alias("i", "x"))
    finite = F.when(~F.isnan("x") & (F.abs("x") < float("inf")), F.col("x"))
    means = parts.groupBy("key", "i").agg(F.coalesce(F.avg(finite), F.lit(0.0)).alias("x")).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))
    return modal.join(means, "key")
