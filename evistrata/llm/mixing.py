"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words; a document's expected number of copies is its source's target over its
source's size. Within a source, documents are laid out by size (then doc_id), expected copies are prefix-summed, one
random offset per source (fixed by the seed) is added, and a document is emitted once for each integer boundary that
its stretch crosses. The layout by size makes neighbours alike, so the words taken stay within about one document of
the target, whatever the offset.

The table of sources (one row each: size) is the recipe and is held on the driver; documents never are.

Defined cases: null text has size 0; null source is a source of its own, sorted last for weights; sources of size 0
have target 0 and take nothing; repeated rows count as rows; null doc_id sorts first; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, running

WEIGHTS = (5.0, 2.0, 1.0)
#: A recipe of more sources is joined by shuffling.
BROADCAST_SOURCES = 100_000


def water_fill(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Targets in proportion to weights, none above most * size; the excess is reshared by weight until none is."""
    targets, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > most * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / w
            break
        for i in over:
            targets[i] = most * sizes[i]
        left -= sum(targets[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return targets


def _offset(seed: int, source: str | None) -> float:
    """In [0, 1), a multiple of 2**-10 so that adding it is exact."""
    return int.from_bytes(hashlib.sha256(f"{seed}:{source is None}:{source}".encode()).digest()[:2], "big") % 1024 / 1024


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = 42) -> DataFrame:
    """docs(doc_id, source, text) -> doc_id, source, size, source_size, target, copies, taken."""
    spark = docs.sparkSession
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    base = keep(docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size")))
    laid = keep(running(base, ["source", "size", "doc_id"], {}))
    rows = laid.groupBy("source").agg(F.sum("size").alias("size"), F.min("row_index").alias("begin")).collect()
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in rows]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(rows))], share * sum(sizes), most)
    recipe = [(r["source"], r["size"], t, min(t / r["size"], most) if r["size"] else 0.0, r["begin"], _offset(seed, r["source"])) for r, t in zip(rows, targets, strict=True)]
    plan = spark.createDataFrame(recipe, "name string, source_size long, target double, rate double, begin long, shift double")
    k = F.col("row_index") - F.col("begin")
    before, after = F.floor(k * F.col("rate") + F.col("shift")), F.floor((k + 1) * F.col("rate") + F.col("shift"))
    copies = F.least(after - before, F.lit(int(most))).cast("long")
    plan = F.broadcast(plan) if len(rows) <= BROADCAST_SOURCES else plan
    out = laid.join(plan, F.col("source").eqNullSafe(F.col("name"))).withColumn("copies", copies)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """docs with every row repeated as often as the mix takes it. Rows travel as one struct: no column name can clash."""
    key = F.unhex(F.sha2(F.concat(F.coalesce("text", F.lit("")), F.lit("\u0000"), F.coalesce(F.col("source").cast("string"), F.lit("\u0001"))).cast("binary"), 256))
    rows = docs.select(F.struct("*").alias("row"), key.alias("key"), F.col("doc_id").alias("id"))
    asked = rows.select(F.struct("id", "key").alias("doc_id"), F.col("row.source").alias("source"), F.col("row.text").alias("text"))
    taken = keep(mix(asked, **options).groupBy("doc_id.id", "doc_id.key").agg(F.sum("copies").alias("copies"), F.count("*").alias("n")))
    if not taken.where("n > 1").isEmpty():
        rows = rows.dropDuplicates(["id", "key"])
    plan = taken.where("copies > 0").select(F.col("id").alias("i"), F.col("key").alias("k"), "copies")
    out = rows.join(plan.hint("merge"), F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")))
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def op7_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "copies")
