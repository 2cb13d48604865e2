"""Quality of labels and of clusters."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: str, said: str) -> DataFrame:
    """support, said and right of each label; rows whose truth is null count for what was said only."""
    t = df.groupBy(F.col(truth).alias("label")).agg(F.count("*").alias("support"))
    p = df.groupBy(F.col(said).alias("label")).agg(F.count("*").alias("said"))
    r = df.where(F.col(truth) == F.col(said)).groupBy(F.col(truth).alias("label")).agg(F.count("*").alias("right"))
    held = t.where("label IS NOT NULL").join(p.where("label IS NOT NULL"), "label", "full").join(r, "label", "left")
    return held.fillna(0, ["support", "said", "right"])


def scores(df: DataFrame, truth: str, said: str) -> DataFrame:
    """Precision, recall and F1 of each label; an empty denominator counts as 1."""
    c = confusion(df, truth, said)
    c = c.withColumn("precision", F.when(F.col("said") > 0, F.col("right") / F.col("said")).otherwise(1.0))
    c = c.withColumn("recall", F.when(F.col("support") > 0, F.col("right") / F.col("support")).otherwise(1.0))
    total = F.col("precision") + F.col("recall")
    return c.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))


def macro_f1(df: DataFrame, truth: str, said: str) -> DataFrame:
    return scores(df, truth, said).agg(F.avg("f1").alias("macro_f1"), F.count("*").alias("labels"))


def cluster_pairs(df: DataFrame, truth: str, said: str) -> DataFrame:
    """Pairs together in truth, in what was said, and in both, by counts of cells; no pair is listed."""
    pairs = lambda keys: df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("v"))
    names = {"truth": [truth], "said": [said], "both": [truth, said]}
    parts = [pairs(keys).select(F.lit(n).alias("name"), "v") for n, keys in names.items()]
    held = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy().pivot("name", list(names)).agg(F.first("v"))
    ratio = lambda d: F.when(F.col(d) > 0, F.round(F.col("both") / F.col(d), 6)).otherwise(1.0)
    return held.select("truth", "said", "both", ratio("said").alias("precision"), ratio("truth").alias("recall"))


def accuracy(df: DataFrame, truth: str, said: str) -> DataFrame:
    """right, n, accuracy over rows with a truth; 1 without any."""
    held = df.where(F.col(truth).isNotNull()).agg(F.count(F.when(F.col(truth) == F.col(said), 1)).alias("right"), F.count("*").alias("n"))
    return held.withColumn("accuracy", F.when(F.col("n") > 0, F.round(F.col("right") / F.col("n"), 3)).otherwise(1.0))


def binary(df: DataFrame, truth: Column, said: Column) -> DataFrame:
    """precision and recall of a yes-or-no answer, to three places; an empty denominator counts as 1."""
    count = lambda c: F.count(F.when(c, 1))
    ratio = lambda d: F.when(F.col(d) > 0, F.round(F.col("both") / F.col(d), 3)).otherwise(1.0)
    held = df.agg(count(truth & said).alias("both"), count(said).alias("said"), count(truth).alias("truth"))
    return held.select(ratio("said").alias("precision"), ratio("truth").alias("recall"))


def regressions(old: DataFrame, new: DataFrame, drop: float = 0.15, support: int = 2) -> DataFrame:
    """label, was, is: labels of at least `support` rows in new whose F1 fell by more than `drop`; a label that new hasn't got fell to 0."""
    held = old.select("label", F.col("f1").alias("was"), F.col("support").alias("n_old")).join(new.select("label", F.col("f1").alias("is"), F.col("support").alias("n")), "label", "left")
    held = held.withColumns({"is": F.coalesce("is", F.lit(0.0)), "n": F.coalesce("n", "n_old")})
    return held.where((F.col("n") >= support) & (F.col("was") - F.col("is") > drop)).select("label", "was", "is")


def report(parts: dict[str, DataFrame], least: float = 0.9) -> DataFrame:
    """metric, value, passed: the one row of each part, its columns as metrics named part.column."""
    rows = [df.select(F.explode(F.array(*[F.struct(F.lit(f"{name}.{c}").alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns])).alias("m")).select("m.*") for name, df in parts.items()]
    return reduce(DataFrame.unionByName, rows).withColumn("passed", F.col("value") >= least)
