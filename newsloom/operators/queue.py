"""A queue of addresses as a table of states; each step gives the next table.

Which states there are, how many attempts are made and how long a wait is are the caller's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import codes
from newsloom.session import BROADCAST


def claim(queue: DataFrame, ready: Column, order: list[Column], most: int, state: str, now: Column) -> DataFrame:
    """queue with the first `most` ready rows put in `state`, their attempts one more."""
    taken = queue.where(ready).orderBy(*order).limit(most).select("queue_id").withColumn("__nl_taken", F.lit(True))
    held = queue.join(F.broadcast(taken) if most <= BROADCAST else taken, "queue_id", "left")
    own = F.coalesce("__nl_taken", F.lit(False))
    changed = {"status": F.when(own, state).otherwise(F.col("status")), "attempts": F.col("attempts") + own.cast("int"), "updated_at": F.when(own, now).otherwise(F.col("updated_at"))}
    return held.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in queue.columns])


def record(queue: DataFrame, outcomes: DataFrame, now: Column, states: dict[str, str], attempts: int = 5, base: int = 60, most: int = 3600) -> DataFrame:
    """queue with the last outcome of each row entered.

    outcomes: queue_id, at, status (of a response, null for none), error. states: what success,
    retry, permanent, blocked and exhausted are called. A retry waits (next_at) twice as long each
    time; after `attempts` the row is exhausted and its error says so.
    """
    last = outcomes.groupBy("queue_id").agg(F.max_by(F.struct("status", "error"), F.struct("at", F.coalesce("status", F.lit(0)))).alias("__nl_o"))
    held = queue.join(last, "queue_id", "left")
    seen, status, error = F.col("__nl_o").isNotNull(), F.col("__nl_o.status"), F.col("__nl_o.error")
    decision = F.coalesce(codes.http_decision(status), F.lit("retry"))
    over = (decision == "retry") & (F.col("attempts") >= attempts)
    name = F.when(over, states["exhausted"])
    for kind in ("success", "retry", "permanent", "blocked"):
        name = name.when(decision == kind, states[kind])
    reason = F.coalesce(error, F.when(decision != "success", F.coalesce(F.concat(F.lit("http-"), status.cast("string")), F.lit("unknown-error"))))
    wait = F.when((decision == "retry") & ~over, F.timestamp_micros(F.unix_micros(now) + codes.backoff(F.col("attempts"), base, most) * 1_000_000))
    changed = {
        "status": F.when(seen, name).otherwise(F.col("status")), "last_error": F.when(seen, F.when(over, F.concat(F.lit("attempts-exhausted: "), reason)).otherwise(reason)).otherwise(F.col("last_error")),
        "next_at": F.when(seen, wait).otherwise(F.col("next_at")), "updated_at": F.when(seen, now).otherwise(F.col("updated_at")),
    }
    return held.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in queue.columns])


def gate(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """df with rejected: the name of the first check that doesn't hold (null counts as not), null if all do."""
    reason = F.lit(None).cast("string")
    for name, holds in reversed(checks.items()):
        reason = F.when(~F.coalesce(holds, F.lit(False)), name).otherwise(reason)
    return df.withColumn("rejected", reason)


def run_counters(outcomes: DataFrame, run: Column, outcome: str, names: list[str]) -> DataFrame:
    """run, all, and a count of each named outcome."""
    return outcomes.groupBy(run.alias("run")).agg(F.count("*").alias("all"), *[F.count(F.when(F.col(outcome) == n, 1)).alias(n.replace("-", "_")) for n in names])
