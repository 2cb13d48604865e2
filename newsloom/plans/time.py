"""Queries on mixed timestamp formats and zones."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import timestamps
from newsloom.plans.registry import core
from newsloom.session import small
from newsloom.sources import table

STAMPS = (("article_records", "record_id", "published_at"), ("crawl_queue", "queue_id", "discovered_at"), ("wp_posts", "post_id", "post_date"))


def _stamps(spark: SparkSession, folder: str) -> DataFrame:
    """src, row_id, value and its instant for the three dated tables.

    The zones of sources and those named in brackets are read to the driver: at most as many as the zone database has.
    """
    sources = table(spark, folder, "sources").select("source_id", "home_tz", "date_order")
    zones = [r[0] for r in sources.select("home_tz").where("home_tz IS NOT NULL").distinct().collect()]
    rows = [
        table(spark, folder, name).select(F.lit(name).alias("src"), F.col(key).alias("row_id"), "source_id", F.col(value).alias("value"))
        for name, key, value in STAMPS
    ]
    rows = reduce(DataFrame.unionByName, rows)
    zones += timestamps.named_zones(rows, "value")
    rows = rows.join(small(sources), "source_id", "left")
    return timestamps.attach(rows, "value", "home_tz", "date_order", timestamps.offset_intervals(spark, zones))


@core.query()
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """src, row_id, utc_us: each value that names exactly one instant."""
    return _stamps(spark, folder).where("utc_us IS NOT NULL").select("src", "row_id", "utc_us").distinct()


@core.query()
def p2_status(spark: SparkSession, folder: str) -> DataFrame:
    """How many values of each table were read, and why the others name no instant."""
    return _stamps(spark, folder).groupBy("src", F.col("utc_us_status").alias("status")).agg(F.count("*").alias("n"))
