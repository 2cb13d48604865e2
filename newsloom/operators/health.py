"""State of sources from what was fetched of them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import codes


def fetch_metrics(fetches: DataFrame, key: str) -> DataFrame:
    """Attempts, successes and kinds of failure of each source. fetches: key, status (int), outcome."""
    count = lambda c: F.count(F.when(c, 1))
    status = F.col("status")
    return fetches.groupBy(key).agg(
        F.count("*").alias("attempted"), count(status.between(200, 299)).alias("succeeded"), count(status.isin(401, 403)).alias("blocked"), count(status == 429).alias("limited"),
        count(status.between(500, 599)).alias("server_errors"), F.max(F.unix_micros("fetched_at")).alias("last_us"),
    )


def assess(metrics: DataFrame) -> DataFrame:
    """The state of each source: the first of BLOCKED, BROKEN, STALE, DEGRADED that holds, else HEALTHY."""
    n, ok = F.col("attempted"), F.col("succeeded")
    share = lambda c: F.when(n > 0, F.col(c) / n).otherwise(0.0)
    state = (
        F.when((n >= 5) & (share("blocked") >= 0.5), "BLOCKED")
        .when((n >= 5) & (share("succeeded") < 0.2), "BROKEN")
        .when(n == 0, "STALE")
        .when(((n >= 5) & (share("succeeded") < 0.8)) | (share("limited") >= 0.2), "DEGRADED")
        .otherwise("HEALTHY")
    )
    return metrics.withColumn("state", F.when(ok.isNull(), "STALE").otherwise(state))


def failures(queue: DataFrame, key: str) -> DataFrame:
    """Recorded errors of each source by kind."""
    return queue.select(key, codes.failure_kind(F.col("last_error")).alias("kind")).where("kind IS NOT NULL").groupBy(key, "kind").agg(F.count("*").alias("n"))


def volume_alerts(current: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """key, median, current, level: critical if nothing came where the median is 5 or more, warning if less than a fifth of a median of 10 or more."""
    held = baseline.join(current, key, "left").fillna(0, ["current"])
    level = F.when((F.col("median") >= 5) & (F.col("current") == 0), "critical").when((F.col("median") >= 10) & (F.col("current") < 0.2 * F.col("median")), "warning")
    return held.select(key, "median", "current", level.alias("level")).where("level IS NOT NULL")


def drift_alerts(current: DataFrame, baseline: DataFrame, key: str, least: int = 10, rise: float = 0.3) -> DataFrame:
    """key, was, share: sources whose share of weak results (weak of all) rose by more than `rise` over its baseline, with at least `least` results now. Both: key, weak, all."""
    share = F.when(F.col("all") > 0, F.col("weak") / F.col("all")).otherwise(0.0)
    held = current.where(F.col("all") >= least).select(key, share.alias("share")).join(baseline.select(key, share.alias("was")), key, "left")
    return held.select(key, F.coalesce("was", F.lit(0.0)).alias("was"), "share").where(F.col("share") - F.col("was") > rise)
