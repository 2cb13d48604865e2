"""What is new in polled endpoints since the last poll."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators import windows

# The order in which endpoints are polled.
KINDS = {"rss": 0, "atom": 1, "news_sitemap": 2, "sitemap": 3, "wordpress_api": 4, "section": 5}
PRIORITIES = {"high": 0, "medium": 1, "low": 2}


def rank(c: Column, table: dict[str, int]) -> Column:
    """The rank of a name, 9 for an unknown one."""
    out = F.lit(9)
    for name, n in table.items():
        out = F.when(c == name, n).otherwise(out)
    return out


def ordered(endpoints: DataFrame, kind: str, priority: str) -> DataFrame:
    return endpoints.orderBy(rank(F.col(kind), KINDS), rank(F.col(priority), PRIORITIES))


def included(url: Column, title: Column, pattern: Column) -> Column:
    """Whether an entry's address and title match an endpoint's pattern; all do without one."""
    return pattern.isNull() | F.rlike(F.concat_ws(" ", url, title), pattern)


def walk(entries: DataFrame, cursors: DataFrame, key: str, most: int = 250) -> DataFrame:
    """Entries before the first that was seen, and whether each is kept or deferred.

    entries: key, position (as listed), url, at (number, null: undated). cursors: key, seen_url,
    seen_at. The walk stops at the cursor's own address or at an entry not newer than it; undated
    entries stop nothing. At most `most` are kept of each key.
    """
    held = entries.join(cursors, key, "left")
    seen = (F.col("url") == F.col("seen_url")) | (F.col("at") <= F.col("seen_at"))
    new = windows.take_while(held, key, "position", F.coalesce(seen, F.lit(False)))
    return windows.numbered(new, [key], "position", "url", 10_000).withColumn("kept", F.col("position") <= most).select(key, "url", "at", F.col("position").alias("number"), "kept")


def advance(walked: DataFrame, cursors: DataFrame, key: str) -> DataFrame:
    """The next cursors: the newest entry kept, but the oldest one where entries were deferred; keys without new entries keep theirs."""
    by = walked.groupBy(key).agg(
        F.min_by(F.struct("url", "at"), F.when(F.col("kept"), F.col("number"))).alias("newest"), F.max_by(F.struct("url", "at"), F.when(F.col("kept"), F.col("number"))).alias("oldest"),
        F.bool_or(~F.col("kept")).alias("capped"),
    )
    taken = by.select(key, F.when(F.col("capped"), F.col("oldest")).otherwise(F.col("newest")).alias("c"))
    held = cursors.join(taken, key, "full")
    return held.select(key, F.coalesce("c.url", "seen_url").alias("seen_url"), F.coalesce("c.at", "seen_at").alias("seen_at"))
