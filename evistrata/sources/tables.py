"""Readers and writers: explicit schemas, column checks and NaN to null at the boundary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS = {
    "corpus": "text string, year int",
    "gene_universe": "gene string, count bigint",
    "gtf_gene": "gene_id string, gene_symbol string, gene_type string, chromosome string, start bigint, end bigint, strand int, tss bigint",
    "string_link": "protein1 string, protein2 string, combined_score double",
    "module": "Gene string, Cluster string",
    "score_series": "gene_id string, score double",
    "hgnc": "symbol string, ensembl_gene_id string, status string",
}


def assert_columns(df: DataFrame, needed: list[str]) -> DataFrame:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, T.FloatType | T.DoubleType)]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def sniffed(spark: SparkSession, path: str) -> str:
    """The separator that occurs most often in the first line, of tab, comma, semicolon and bar."""
    head = next((r["value"] for r in spark.read.text(path).limit(1).collect()), "")
    return max("\t,;|", key=head.count)


def read_table(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = False) -> DataFrame:
    """Parquet, CSV or TSV by suffix, .txt by its first line; anything else is an error. Files whose quoted values span
    lines need multi_line and can't be split among tasks."""
    low = path.lower().removesuffix(".gz")
    if low.endswith((".parquet", ".pq")):
        return nan_to_null(spark.read.parquet(path))
    if low.endswith((".csv", ".tsv", ".txt")):
        reader = spark.read.option("header", True).option("sep", "," if low.endswith(".csv") else "\t" if low.endswith(".tsv") else sniffed(spark, path)).option("escape", "\\").option("multiLine", multi_line)
        return nan_to_null((reader.schema(schema) if schema else reader).csv(path))
    raise ValueError(f"unsupported file type: {path}")


def read_texts(spark: SparkSession, root: str) -> DataFrame:
    """(text, year) of every *.txt below root whose name starts with a year; white space squeezed, empty texts gone."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(root, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)
    text = F.trim(F.regexp_replace("value", r"(?U)\s+", " "))
    return raw.select(text.alias("text"), F.substr(name, F.lit(1), F.lit(4)).try_cast("int").alias("year")).where("year is not null and text <> ''")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed non-empty lines; none where there is no such file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at):
        return spark.createDataFrame([], "value string")
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """Protein-coding genes of a GTF file (plain or gzip), one row per gene_id: the first in file order."""
    f = F.split("value", "\t")
    attribute = lambda k: F.nullif(F.regexp_extract(F.get(f, F.lit(8)), rf'\b{k} "([^"]*)"', 1), F.lit(""))
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).where("not startswith(value, '#')").where(F.size(f) >= 9)
    genes = lines.where(F.get(f, F.lit(2)) == "gene")
    a, b = F.get(f, F.lit(3)).try_cast("bigint"), F.get(f, F.lit(4)).try_cast("bigint")
    strand = F.when(F.get(f, F.lit(6)) == "-", -1).otherwise(1)
    out = genes.select(
        "line", F.substring_index(attribute("gene_id"), ".", 1).alias("gene_id"), F.upper(attribute("gene_name")).alias("gene_symbol"), F.coalesce(attribute("gene_type"), attribute("gene_biotype")).alias("gene_type"),
        F.regexp_replace(F.get(f, F.lit(0)), "^chr", "").alias("chromosome"), F.least(a, b).alias("start"), F.greatest(a, b).alias("end"), strand.alias("strand"),
    ).where("gene_type = 'protein_coding' and gene_id is not null and start is not null")
    first = out.groupBy("gene_id").agg(F.min_by(F.struct(*[c for c in out.columns if c not in ("gene_id", "line")]), "line").alias("g")).select("gene_id", "g.*")
    return first.withColumn("tss", F.when(F.col("strand") == 1, F.col("start")).otherwise(F.col("end")))


def string_network(links: DataFrame, protein_to_gene: DataFrame, least: float = 700) -> DataFrame:
    """links(protein1, protein2, combined_score), map(protein, gene) -> (a, b, w): unordered gene pairs, best score / 1000."""
    m1 = protein_to_gene.select(F.col("protein").alias("protein1"), F.col("gene").alias("g1"))
    m2 = protein_to_gene.select(F.col("protein").alias("protein2"), F.col("gene").alias("g2"))
    both = links.where(F.col("combined_score") >= least).join(m1, "protein1").join(m2, "protein2").where("g1 <> g2")
    return both.groupBy(F.least("g1", "g2").alias("a"), F.greatest("g1", "g2").alias("b")).agg((F.max("combined_score") / 1000).alias("w"))


def write_table(df: DataFrame, path: str, parquet: bool = True, csv: bool = False, partition_by: list[str] | None = None) -> None:
    for on, kind in ((parquet, "parquet"), (csv, "csv")):
        if on:
            w = df.write.mode("overwrite")
            w = w.partitionBy(*partition_by) if partition_by else w
            w.parquet(f"{path}.parquet") if kind == "parquet" else w.option("header", True).csv(f"{path}.csv")
