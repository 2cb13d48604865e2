"""Ordered and windowed operators."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order, by an aggregate rather than a sort of the group.

    order: descending keys, most significant first; ties fall to the greatest row. Nulls are lowest.
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("__nl_row"))
    return best.select(*keys, *[F.col("__nl_row")[c].alias(c) for c in rest])


def latest_or(df: DataFrame, rows: DataFrame, key: str, order: list[Column], value: str, default: str) -> DataFrame:
    """df with the value of the latest row of each key, the default where there is none."""
    last = latest(rows.select(key, value, *[o.alias(f"__nl_{i}") for i, o in enumerate(order)]), [key], [F.col(f"__nl_{i}") for i in range(len(order))])
    return df.join(last.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key; a rank of at most k is kept by each partition before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def keep_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row of each key that comes first."""
    return latest(df, [key], [-F.col(c) for c in order])


def take_while(df: DataFrame, key: str, position: str, stop: Column) -> DataFrame:
    """Rows of each key before the first at which `stop` holds."""
    at = df.where(stop).groupBy(key).agg(F.min(position).alias("__nl_stop"))
    return df.join(at, key, "left").where(F.col("__nl_stop").isNull() | (F.col(position) < F.col("__nl_stop"))).drop("__nl_stop")


def budget(df: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """df and whether each row is among the first `most` of its key in order (ties by the whole order).

    A key's last row within the budget comes from the ranks that each partition keeps before the
    shuffle, so a hot key isn't sorted whole in one task.
    """
    first = top_k(df.select(key, *order), [key], [F.col(c) for c in order], most)
    last = first.groupBy(key).agg(F.max(F.struct(*[F.col(c) for c in order])).alias("__nl_last"))
    return df.join(last, key, "left").withColumn("kept", F.struct(*[F.col(c) for c in order]) <= F.col("__nl_last")).drop("__nl_last")


def range_pairs(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, within: int) -> DataFrame:
    """Pairs of rows with equal keys and times (in seconds) at most `within` apart.

    Times are put in bins of that width; the right side is put in its own bin and both next to it,
    so the join has equality keys and no pair is found twice.
    """
    bin_ = lambda t: F.floor(F.col(t) / within)
    a = left.withColumn("__nl_bin", bin_(left_time))
    b = right.withColumn("__nl_bin", F.explode(F.array(bin_(right_time) - 1, bin_(right_time), bin_(right_time) + 1)))
    return a.join(b, [*on, "__nl_bin"]).where(F.abs(F.col(left_time) - F.col(right_time)) <= within).drop("__nl_bin")


def daily_counts(df: DataFrame, key: str, day: str, days: int, until: Column) -> DataFrame:
    """Rows of each key on each of the `days` days before `until`, zeros included."""
    keys = df.select(key).distinct()
    calendar = keys.select(key, F.explode(F.sequence(F.date_sub(until, days), F.date_sub(until, 1))).alias(day))
    counts = df.groupBy(key, day).agg(F.count("*").alias("n"))
    return calendar.join(counts, [key, day], "left").fillna(0, ["n"])


def baseline(counts: DataFrame, key: str) -> DataFrame:
    """Median of the daily counts of each key."""
    return counts.groupBy(key).agg(F.median("n").alias("median"), F.sum("n").alias("total"))


def mode_value(df: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key, the smallest of several; nulls aren't counted."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    most = counts.groupBy(key).agg(F.max("n").alias("n"))
    return counts.join(most, [key, "n"]).groupBy(key).agg(F.min(value).alias(value))


def as_of(rows: DataFrame, keys: list[str], time: str, width: int = 7 * 86_400_000_000) -> DataFrame:
    """keys, time, id, of: for each row of side 1 the row of side 0 with equal keys that is last at or before its time.

    One pass over both sides in order of time instead of a join. Windows run within a key and a bin
    of `width`, so no key is sorted whole in one task; what a bin's first rows need from before is
    the last row of the bins before it, carried over a table of one row a bin. Rows of side 1
    without an earlier row of side 0 are left out; of several at one time the highest id is last.
    """
    held = rows.withColumn("bin", F.floor(F.col(time) / width))
    inside = Window.partitionBy(*keys, "bin").orderBy(time, "side", "id")
    own = F.last(F.when(F.col("side") == 0, F.struct(time, "id")), ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    ends = held.groupBy(*keys, "bin").agg(F.max(F.when(F.col("side") == 0, F.struct(time, "id"))).alias("end"))
    over = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "bin", F.last("end", ignorenulls=True).over(over).alias("before"))
    found = held.withColumn("own", own).where("side = 1").join(ends, [*keys, "bin"])
    return found.select(*keys, time, "id", F.coalesce("own.id", "before.id").alias("of")).where("of IS NOT NULL")


def numbered(df: DataFrame, keys: list[str], at: str, tie: str, width: int) -> DataFrame:
    """position (from 1) of each row of a key in order of the number `at`, then `tie`; at may not be null.

    Rows are numbered within a key and a bin of `width`; the rows of the bins before are added from
    a table of one row a bin, so no key is sorted whole in one task.
    """
    held = df.withColumn("__nl_bin", F.floor(F.col(at) / width))
    bins = held.groupBy(*keys, "__nl_bin").agg(F.count("*").alias("__nl_n"))
    before = F.sum("__nl_n").over(Window.partitionBy(*keys).orderBy("__nl_bin")) - F.col("__nl_n")
    bins = bins.select(*keys, "__nl_bin", before.alias("__nl_before"))
    rank = F.row_number().over(Window.partitionBy(*keys, "__nl_bin").orderBy(at, tie))
    return held.withColumn("__nl_rank", rank).join(bins, [*keys, "__nl_bin"]).withColumn("position", F.col("__nl_before") + F.col("__nl_rank")).drop("__nl_bin", "__nl_rank", "__nl_before")


def gaps(df: DataFrame, keys: list[str], at: str, tie: str, width: int) -> DataFrame:
    """gap of each row of a key to the row before it in order of `at`, null for the first; in bins as numbered()."""
    held = df.withColumn("__nl_bin", F.floor(F.col(at) / width))
    ends = held.groupBy(*keys, "__nl_bin").agg(F.max(at).alias("__nl_end"))
    ends = ends.select(*keys, "__nl_bin", F.lag("__nl_end").over(Window.partitionBy(*keys).orderBy("__nl_bin")).alias("__nl_before"))
    own = F.lag(at).over(Window.partitionBy(*keys, "__nl_bin").orderBy(at, tie))
    held = held.withColumn("__nl_own", own).join(ends, [*keys, "__nl_bin"])
    return held.withColumn("gap", F.col(at) - F.coalesce("__nl_own", "__nl_before")).drop("__nl_bin", "__nl_own", "__nl_before")
