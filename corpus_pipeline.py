"""The corpus pipeline: documents through five stages, each written as Parquet and read again.

Decisions: texts that the quality classifier rejects go; one document of each near-duplicate group stays; secrets are
replaced by a mark in the texts (all documents stay, n_chars follows); rows are dropped and repeated to meet the source
weights; and every remaining text is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evistrata.llm import mixing, pieces, quality, secrets, simhash
from evistrata.llm.common import keep


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the compression classifier, trained on the labelled rows of docs, predicts as 0."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.with_scores(docs, model).where("predicted__ = 1").select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of copies (five-word shingles at least 0.8 alike)."""
    return simhash.deduplicate(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts. Rows travel as one struct, so no column name of docs can clash."""
    _, findings, _ = secrets.scan(docs)
    spans = keep(secrets.by_blob(findings))
    rows = docs.select(F.struct("*").alias("row"), secrets.blob_id(F.coalesce("text", F.lit(""))).alias("id"))
    # A merge join at every size: findings grow with the corpus.
    held = rows.join(spans.hint("merge"), rows.id == spans.blob, "left")
    old = F.col("row.text")
    text = F.when(F.col("spans").isNull(), old).otherwise(secrets.redact(old, secrets.covered(old, F.col("spans"))))
    out = held.select("row", "spans", text.alias("clean"))
    row = F.col("row").withField("text", F.col("clean"))
    if "n_chars" in docs.columns:
        counted = F.char_length("clean").cast(dict(docs.dtypes)["n_chars"])
        row = row.withField("n_chars", F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(counted))
    return out.select(row.alias("row")).select("row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that sources meet their target weights."""
    return mixing.apply_mix(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids of every row."""
    return pieces.encode_documents(docs, with_ids=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", dedup_stage),
    ("secret scans", secrets_stage),
    ("mixing sources", mixing_stage),
    ("SentencePiece encoding", encoding_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
