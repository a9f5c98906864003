"""Incremental ingest: only rows whose id hasn't been seen are kept, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unseen(batch: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return batch.dropDuplicates([key]).join(seen.select(key), key, "left_anti")


def append_new(stream: DataFrame, key: str, path: str, checkpoint: str):
    """A streaming query that appends each batch's unseen ids to a parquet log."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        seen = spark.createDataFrame([], batch.schema) if not _exists(spark, path) else spark.read.schema(batch.schema).parquet(path)
        unseen(batch, seen, key).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def first_seen_day(events: DataFrame) -> DataFrame:
    """Per day the number of users seen for the first time: what day-by-day incremental ingest would append."""
    first = events.groupBy("user_id").agg(F.min(F.to_date("ts")).alias("day"))
    return first.groupBy("day").agg(F.count("*").alias("new_users"))
