"""Sources combined to target shares of tokens, with capped repeats.

Efraimidis-Spirakis sampling: each document gets the key -ln(u) / w, with u uniform from a hash of
its key and w its quality weight; the smallest keys are a weighted sample without replacement.
Documents sorted by key within their source are prefix-summed to the source's token budget: whole
epochs of a source come first, then the fraction that is left.

Prefix sums are made in two levels. A monotone map spreads the keys over buckets, bucket sums are
prefix-summed (as many rows as buckets), and only the one bucket of each source in which the
budget ends is sorted, so a source with a third of all documents is never sorted in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm import tokenizers
from newsloom.session import cut, small

#: Documents a bucket, about.
BUCKET = 2000


def quality(text: Column) -> Column:
    """A weight from 0.01 to 1 for running text: the share of letters and marks, by the share of characters in lines that end a sentence."""
    size = F.greatest(F.length(text), F.lit(1))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\p{M}]+", "")) / size
    ended = F.filter(F.split(text, "\n"), lambda line: F.right(line, F.lit(3)).rlike(r"[.!?।۔][\"'”’»)]*\s*$"))
    told = F.length(F.array_join(ended, "\n")) / size
    return F.greatest(F.lit(0.01), letters * (0.2 + 0.8 * F.least(F.lit(1.0), told)))


def uniform(*parts: Column) -> Column:
    """A number above 0 and below 1 from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11) + F.lit(0.5)) / F.lit(float(1 << 53))


def token_counts(df: DataFrame, text: str, tokenizer: str, keys: list[str], folder: str = tokenizers.FOLDER) -> DataFrame:
    """keys and n: the tokens of each text by the public tokenizer that the column `tokenizer` names; null and empty texts have none."""
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for n, k in zip(names, keys)], F.col(tokenizer).alias("z"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, texts = np.array(batch.column(len(names)).to_pylist(), object), batch.column(len(names) + 1).to_pylist()
            out = np.zeros(len(texts), np.int64)
            for name in dict.fromkeys(which):
                at = np.flatnonzero(which == name)
                out[at] = tokenizers.counter(name, folder)([texts[i] for i in at])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(out)], [*names, "n"])

    done = rows.mapInArrow(scan, f"{kinds}, n bigint")
    return done.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "n")


def mix(docs: DataFrame, targets: DataFrame, key: str, text: str, source: str, weight: Column | None = None, seed: int = 17, folder: str = tokenizers.FOLDER) -> DataFrame:
    """plan_id, source, key, repeats, tokens of each chosen document.

    weight: the quality weight of each document, above 0 (null: 1); quality() of its text if none is given.
    targets: plan_id, source, target_share, max_repeats, tokenizer, budget_ratio. A plan's size is
    budget_ratio times the tokens of its sources; if a source can't fill its share with
    max_repeats of all its documents, the plan is made smaller, so that the shares stay right.
    Documents without tokens are never chosen; a document is chosen at most max_repeats times; the
    fraction ends with the document that comes closest to the budget. Rows repeated under one key
    are separate documents only if they differ in text. A source without documents has no rows.
    """
    plans = targets.select("plan_id", "source", "target_share", "max_repeats", "tokenizer", "budget_ratio")
    wanted = small(plans.select(F.col("source").alias("s"), F.col("tokenizer").alias("z")).distinct())  # a source of a third of all rows is never one key of a shuffle
    own = quality(F.col(text)) if weight is None else F.greatest(F.lit(1e-9), F.coalesce(weight, F.lit(1.0)))
    rows = docs.select(F.col(key).alias("k"), F.col(source).alias("s"), F.col(text).alias("t"), own.alias("w")).where("t IS NOT NULL AND t != ''")
    rows = rows.withColumn("h", F.xxhash64("t")).join(wanted, "s")
    counted = cut(token_counts(rows, "t", "z", ["k", "s", "z", "w", "h"], folder).where("n > 0").dropDuplicates(["k", "s", "z", "h"]))
    totals = counted.groupBy("s", "z").agg(F.sum("n").alias("all"), F.count("*").alias("docs"), F.avg("w").alias("mean"))
    budget = plans.join(totals, (plans.source == totals.s) & (plans.tokenizer == totals.z))
    plan = Window.partitionBy("plan_id")  # as many rows as a plan has sources
    size = F.least(F.sum("all").over(plan) * F.col("budget_ratio"), F.min(F.col("all") * F.col("max_repeats") / F.col("target_share")).over(plan))
    budget = budget.withColumn("budget", F.col("target_share") * size)
    budget = budget.withColumn("epochs", F.least(F.floor(F.col("budget") / F.col("all") + 1e-9), F.col("max_repeats").cast("bigint")))
    budget = budget.withColumn("rest", F.when(F.col("epochs") >= F.col("max_repeats"), 0.0).otherwise(F.greatest(F.lit(0.0), F.col("budget") - F.col("epochs") * F.col("all"))))
    budget = budget.withColumn("buckets", F.ceil(F.col("docs") / BUCKET))
    budget = small(budget.select("plan_id", "s", "z", "epochs", "rest", "buckets", "mean"))
    keyed = counted.join(budget, ["s", "z"])
    keyed = keyed.withColumn("key", -F.log(uniform(F.lit(seed), "plan_id", "k", "h")) / F.col("w"))
    spread = F.lit(1.0) - F.exp(-F.col("key") * F.col("mean"))
    keyed = keyed.withColumn("bucket", F.least(F.floor(spread * F.col("buckets")), F.col("buckets") - 1))
    keyed = keyed.select("plan_id", "s", "k", "h", "n", "key", "epochs", "rest", "bucket")
    sums = keyed.groupBy("plan_id", "s", "bucket").agg(F.sum("n").alias("sum"))
    before = F.sum("sum").over(Window.partitionBy("plan_id", "s").orderBy("bucket")) - F.col("sum")
    sums = sums.select("plan_id", "s", "bucket", "sum", before.alias("before"))
    keyed = keyed.join(sums, ["plan_id", "s", "bucket"])
    crossed = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("sum") > F.col("rest"))
    within = F.col("before") + F.sum("n").over(Window.partitionBy("plan_id", "s", "bucket").orderBy("key", "k", "h"))
    part = keyed.where(crossed).withColumn("upto", within)
    part = part.withColumn("more", F.when(F.col("upto") - F.col("n") / 2 <= F.col("rest"), 1).otherwise(0)).drop("upto")
    whole = keyed.where(~crossed).withColumn("more", F.when((F.col("rest") > 0) & (F.col("before") + F.col("sum") <= F.col("rest")), 1).otherwise(0))
    chosen = whole.unionByName(part).withColumn("repeats", (F.col("epochs") + F.col("more")).cast("int")).where("repeats > 0")
    return chosen.select("plan_id", F.col("s").alias("source"), F.col("k").alias(key), "repeats", (F.col("n") * F.col("repeats")).alias("tokens"))


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """plan_id, source, target_share, actual_share, tokens, documents of a mix."""
    by = chosen.groupBy("plan_id", "source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    held = targets.select("plan_id", "source", "target_share", "max_repeats").join(by, ["plan_id", "source"], "left").fillna(0, ["tokens", "documents", "most_repeats"])
    total = F.sum("tokens").over(Window.partitionBy("plan_id"))
    return held.withColumn("actual_share", F.round(F.when(total > 0, F.col("tokens") / total).otherwise(0.0), 6))
