"""Minimax contiguous sharding of atomic groups.

Documents with equal texts form one atomic group. Groups are laid out in the order of their smallest doc_id, prefix
sums of their sizes are taken in a distributed pass, and the smallest capacity for which a greedy sweep needs at most
`shards` shards is searched. A sweep needs one look-up per shard ("the last group boundary up to here"), so
CANDIDATES capacities are swept side by side, each look-up one aggregation over the boundaries; only those look-ups
reach the driver. Shards are cut at the greedy boundaries of the smallest feasible capacity.

Defined cases: null text = empty text (size 1, one group with empty texts); null doc_id sorts first; repeated rows
stay together, in any order among themselves; a group larger than an even share gets a shard of its own size;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import clean_text, keep, running

CANDIDATES = 24


def _sweep(bounds: DataFrame, total: int, shards: int, capacities: list[int]) -> list[list[int]]:
    """Greedy cut positions for each capacity; the last equals `total` where the capacity suffices."""
    at = [[0] for _ in capacities]
    for _ in range(shards):
        reach = [min(total, c[-1] + cap) for c, cap in zip(at, capacities, strict=True)]
        ask = sorted({r for r, c in zip(reach, at, strict=True) if r < total and c[-1] < total})
        got = {total: total}
        if ask:
            row = bounds.agg(*[F.max(F.when(F.col("start") <= r, F.col("start"))).alias(f"r{i}") for i, r in enumerate(ask)]).first()
            got |= dict(zip(ask, row, strict=True))
        for c, r in zip(at, reach, strict=True):
            c.append(total if c[-1] >= total else got[r])
    return at


def minimax_cuts(bounds: DataFrame, total: int, largest: int, shards: int) -> list[int]:
    """bounds(start): first position of each group. The `shards` - 1 cuts of the smallest feasible capacity."""
    if total == 0:
        return [0] * (shards - 1)
    low = max(-(-total // shards), largest)
    high = max(low, -(-total // shards) + largest)
    best = None
    while best is None or low < high:
        step = max(1, -(-(high - low) // (CANDIDATES - 1)))
        caps = sorted({min(high, low + step * i) for i in range(CANDIDATES)})
        found = _sweep(bounds, total, shards, caps)
        first = next(i for i, c in enumerate(found) if c[-1] >= total)
        best, high = found[first], caps[first]
        low = high if first == 0 else caps[first - 1] + 1
    return best[1:shards]


def shard_groups(docs: DataFrame, shards: int = 8) -> DataFrame:
    """docs(doc_id, text) -> doc_id, size, text_crc32, shard, slot; slots run from 0 in each shard."""
    spark = docs.sparkSession
    text = clean_text()
    base = keep(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("key")))
    firsts = keep(base.groupBy("key").agg(F.min("doc_id").alias("first")))  # a table of its own, so that a hot key of the join can be split
    laid = keep(running(base.join(firsts, "key"), ["first", "key", "doc_id"], {"start": "size"}))
    groups = keep(laid.groupBy("key").agg(F.min("start").alias("start"), F.sum("size").alias("bytes")))
    total, largest = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("bytes"), F.lit(0))).first()
    cuts = minimax_cuts(groups.select("start"), total, largest, shards)
    shard = sum(((F.col("start") >= F.lit(c)).cast("int") for c in cuts), F.lit(0))
    placed = laid.withColumn("shard", shard.cast("int"))
    begins = {r["shard"]: r["b"] for r in placed.groupBy("shard").agg(F.min("row_index").alias("b")).collect()}
    begin = F.element_at(F.create_map(*[F.lit(x) for k, v in (begins or {0: 0}).items() for x in (k, v)]), F.col("shard"))
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("row_index") - begin).cast("long").alias("slot"))


def op3_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
