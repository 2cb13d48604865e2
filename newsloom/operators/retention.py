"""What is kept, for how long, and what is handed back."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_expiry(df: DataFrame, now: Column, days: int = 10) -> DataFrame:
    """expires_at set where it is missing and nothing keeps the row; one that is set never moves."""
    fresh = F.when(F.col("keep_reason").isNull(), now + F.expr(f"INTERVAL {days} DAYS"))
    return df.withColumn("expires_at", F.coalesce("expires_at", fresh))


def purge(df: DataFrame, now: Column) -> DataFrame:
    """Rows that haven't expired; those without an end stay."""
    return df.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def release(df: DataFrame, now: Column, held: str, free: str, seconds: int) -> DataFrame:
    """Rows in the state `held` for more than some seconds are put back to `free`."""
    late = (F.col("status") == held) & (F.unix_micros(now) - F.unix_micros("updated_at") > seconds * 1_000_000)
    return df.withColumn("status", F.when(late, free).otherwise(F.col("status")))


def report(df: DataFrame, now: Column) -> DataFrame:
    """One row: deleted (what purge() takes), remaining, exempt (kept for a reason)."""
    gone = F.coalesce(F.col("expires_at") <= now, F.lit(False))
    return df.agg(F.count(F.when(gone, 1)).alias("deleted"), F.count(F.when(~gone, 1)).alias("remaining"), F.count("keep_reason").alias("exempt"))
