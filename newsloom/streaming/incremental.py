"""Structured Streaming forms of the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsloom.sources import sinks


def first_seen(stream: DataFrame, key: str, time: str, within: str = "7 days") -> DataFrame:
    """Each key once while its state is kept; state is dropped `within` after the latest time seen."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, by: str, time: str, width: str = "1 day", late: str = "3 days") -> DataFrame:
    """Rows of each value in each window; rows later than `late` are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"))


def append_new(stream: DataFrame, folder: str, checkpoint: str, key: str, order: list[str], buckets: int = 64) -> StreamingQuery:
    """Keeps a table of the first row of each key, in folders by a hash of the key (column bucket).

    Each micro-batch appends only the rows whose key is new: of what is there it reads the keys of the
    buckets that its own keys fall in, and never writes a row again. A batch that is repeated after a failure
    finds its own keys and appends what is missing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        new = sinks.insert_ignore(batch.limit(0), batch, key, order).withColumn("bucket", bucket)
        if sinks.exists(spark, folder):
            touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most `buckets` numbers
            known = spark.read.parquet(folder).where(F.col("bucket").isin(touched)).select("bucket", key)
            new = new.join(known, ["bucket", key], "left_anti")
        new.write.mode("append").partitionBy("bucket").parquet(folder)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def for_each_batch(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs a batch operator on what has come since the last run."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
