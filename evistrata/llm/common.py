"""Shared plumbing: table access, durable intermediate tables, distributed prefix sums and components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lower bound on shuffle partitions, for tiny inputs.
MIN_PARTITIONS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(MIN_PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none, a temporary one on a single machine only."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None)
    if root is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = getattr(spark, "_evistrata_dir", None)
        if root is None:
            root = spark._evistrata_dir = tempfile.mkdtemp(prefix="evistrata-")
    return root


def keep(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, keeps column pruning."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/evistrata-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean_text(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def byte_slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch holding about `limit` bytes of `column` each, so that Python never holds one huge word list."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0), dtype=np.int64)
    start = 0
    cut = np.searchsorted(np.cumsum(sizes), np.arange(limit, sizes.sum() + limit, limit))
    for end in [*np.unique(np.minimum(cut + 1, len(sizes))).tolist(), len(sizes)]:
        if end > start:
            yield batch.slice(start, end - start)
            start = end


def running(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """df with `row_index` (from 0, by `order`) and, for each sums[new] = column, the sum of all rows before.

    One range shuffle; each task adds up its own rows, the driver only sees one total per task.
    """
    spark = df.sparkSession
    names = list(sums)
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.LongType()) for n in ["row_index", *names, "part"]]])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, rows, carry = TaskContext.get().partitionId(), 0, dict.fromkeys(names, 0)
        for b in batches:
            cols = [b.column(i) for i in range(b.num_columns)] + [pa.array(np.arange(rows, rows + b.num_rows))]
            for n in names:
                v = np.asarray(b[sums[n]], dtype=np.int64)
                c = np.cumsum(v)
                cols.append(pa.array(c - v + carry[n]))
                carry[n] += int(c[-1]) if len(c) else 0
            cols.append(pa.array(np.full(b.num_rows, part, dtype=np.int64)))
            rows += b.num_rows
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    local = keep(df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(add, schema))
    totals = local.groupBy("part").agg(F.count("*").alias("row_index"), *[F.sum(sums[n]).alias(n) for n in names])
    offsets, at = [], dict.fromkeys(["row_index", *names], 0)
    for r in sorted(totals.collect(), key=lambda r: r["part"]):
        offsets.append((r["part"], *at.values()))
        for n in at:
            at[n] += r[n]
    cols = ["part", *[f"{n}__before" for n in at]]
    if not offsets:
        offsets = [(0, *[0] * len(at))]
    before = spark.createDataFrame(offsets, ", ".join(f"{c} long" for c in cols))
    out = local.join(F.broadcast(before), "part")
    return out.select(*[c for c in df.columns], *[(F.col(n) + F.col(f"{n}__before")).alias(n) for n in at])


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) of longs -> (u, root): every vertex but the smallest of each component, with that smallest one.

    Alternating large-star and small-star steps; each keeps the edge count at most the input's and about halves depth.
    Ends when all components are stars: no vertex has two edges up, or one up and one down.
    """
    e = keep(edges.where("u <> v").select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).distinct())
    while True:
        low = e.groupBy("hi").agg(F.min("lo").alias("p")).select(F.col("hi").alias("lo"), "p")
        large = e.join(low, "lo", "left").select("hi", F.coalesce("p", "lo").alias("lo"))
        near = large.groupBy("hi").agg(F.min("lo").alias("p"))
        small = large.join(near, "hi").select(F.explode(F.array(F.struct(F.col("hi").alias("hi"), F.col("p").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("p").alias("lo")))).alias("x")).select("x.*")
        e = keep(small.where("hi <> lo").distinct())
        ends = e.select(F.explode(F.array(F.struct(F.col("hi").alias("v"), F.lit(1).alias("up")), F.struct(F.col("lo").alias("v"), F.lit(0).alias("up")))).alias("x")).select("x.*")
        if ends.groupBy("v").agg(F.sum("up").alias("ups"), F.count("*").alias("n")).where("ups > 1 or (ups = 1 and n > 1)").isEmpty():
            return e.select(F.col("hi").alias("u"), F.col("lo").alias("root"))
