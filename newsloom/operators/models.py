"""Term weights, classifiers over them and their cross-validation."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import IDF, HashingTF, NGram, Normalizer, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators import evaluate, windows
from newsloom.session import cut


def tfidf(df: DataFrame, key: str, terms: Column, most: int | None = None) -> DataFrame:
    """key, term, weight: (1 + ln tf) * (1 + ln((1 + n) / (1 + df))), each key's weights of length 1.

    most: only the terms that are most frequent in the corpus, the first in order of several.
    """
    counts = df.select(F.col(key).alias("k"), F.explode(terms).alias("term")).groupBy("k", "term").agg(F.count("*").alias("tf"))
    total = df.select(F.count("*").alias("total"))
    spread = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    if most is not None:
        spread = spread.orderBy(F.col("cf").desc(), "term").limit(most)
    held = counts.join(spread, "term").crossJoin(F.broadcast(total))  # the total is one row
    raw = held.select("k", "term", ((1 + F.log("tf")) * (1 + F.log((1 + F.col("total")) / (1 + F.col("df"))))).alias("w"))
    norm = raw.groupBy("k").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "k").select(F.col("k").alias(key), "term", (F.col("w") / F.col("norm")).alias("weight"))


def char_grams(c: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside words, with a space at both ends of each."""
    padded = F.transform(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{M}\p{N}]+)"), 1), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def grams(n: int) -> Column:
        return F.flatten(F.transform(F.filter(padded, lambda w: F.length(w) >= n), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, F.lit(n)))))

    return F.concat(*[grams(n) for n in range(low, high + 1)])


def balanced(df: DataFrame, label: str) -> DataFrame:
    """df with weight: all rows by labels times rows of the own label, so each label weighs the same in all."""
    counts = df.groupBy(label).agg(F.count("*").alias("__nl_n"))
    both = counts.agg(F.sum("__nl_n").alias("__nl_all"), F.count("*").alias("__nl_k"))  # one row
    held = df.join(counts, label).crossJoin(F.broadcast(both))
    return held.withColumn("weight", F.col("__nl_all") / (F.col("__nl_k") * F.col("__nl_n"))).drop("__nl_n", "__nl_all", "__nl_k")


def pipeline(text: str, label: str, kind: str = "logistic", features: int = 1 << 16, weight: str | None = None) -> Pipeline:
    """Words and pairs of words, hashed and weighted, under a linear model: logistic or svc (one against the rest); weight names a column of row weights."""
    own = {"weightCol": weight} if weight else {}
    model = LogisticRegression(labelCol="y", maxIter=25, regParam=0.01, **own) if kind == "logistic" else OneVsRest(classifier=LinearSVC(maxIter=25, regParam=0.01), labelCol="y", **own)
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="w1", pattern=r"[^\p{L}\p{M}\p{N}]+"), NGram(n=2, inputCol="w1", outputCol="w2"),
        HashingTF(inputCol="w1", outputCol="t1", numFeatures=features), HashingTF(inputCol="w2", outputCol="t2", numFeatures=features),
        VectorAssembler(inputCols=["t1", "t2"], outputCol="tf"), IDF(inputCol="tf", outputCol="weighted"), Normalizer(inputCol="weighted", outputCol="features"),
        StringIndexer(inputCol=label, outputCol="y", handleInvalid="keep", stringOrderType="alphabetAsc"), model,
    ])


#: The models that are compared: kind and whether labels are balanced.
CANDIDATES = {"logistic": ("logistic", False), "logistic-balanced": ("logistic", True), "svc": ("svc", False), "svc-balanced": ("svc", True)}


def folds_of(df: DataFrame, key: str, label: str, folds: int, seed: int = 7) -> DataFrame:
    """df with fold: the rows of each label dealt in turn, in the order of a hash of their keys, so each fold has its share of each label.

    The order within a label is numbered in bins of the hash, so no label is sorted whole in one task.
    """
    held = df.withColumn("__nl_h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 1))
    held = windows.numbered(held, [label], "__nl_h", key, 1 << 53)
    return held.withColumn("fold", ((F.col("position") - 1) % folds).cast("int")).drop("position", "__nl_h")


def predicted(df: DataFrame, key: str, text: str, label: str, folds: int = 5, candidate: str = "logistic", features: int = 1 << 16) -> DataFrame:
    """key, label, said, fold: each row judged by a model fitted on the other folds; folds=0 leaves one row out each time.

    Leaving one out fits as many models as there are rows: it is for reviewed sets of a few dozen, and more than 500 rows are refused.
    """
    kind, even = CANDIDATES[candidate]
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).alias("label")).where("text IS NOT NULL AND label IS NOT NULL")
    if not folds:
        folds = rows.count()
        if folds > 500:
            raise ValueError("one is left out of at most 500 rows")
        rows = windows.numbered(rows.withColumn("__nl_one", F.lit(0)), ["__nl_one"], "__nl_one", "key", 1).withColumn("fold", (F.col("position") - 1).cast("int")).drop("position", "__nl_one")
    else:
        rows = folds_of(rows, "key", "label", folds)
    rows, out = cut(rows), None
    for fold in range(folds):
        train = rows.where(F.col("fold") != fold)
        train = balanced(train, "label") if even else train
        fitted = pipeline("text", "label", kind, features, "weight" if even else None).fit(train)
        names = F.array(*[F.lit(x) for x in fitted.stages[-2].labels])
        said = fitted.transform(rows.where(F.col("fold") == fold)).select("key", "label", F.get(names, F.col("prediction").cast("int")).alias("said"), "fold")
        out = said if out is None else out.unionByName(said)
    return out


def cross_validate(df: DataFrame, key: str, text: str, label: str, folds: int = 5, candidate: str = "logistic", features: int = 1 << 16) -> DataFrame:
    """fold, macro_f1 of each fold of predicted(); with folds=0 one row, over all that were left out."""
    said = cut(predicted(df, key, text, label, folds, candidate, features))
    if not folds:
        return evaluate.macro_f1(said, "label", "said").select(F.lit(0).alias("fold"), "macro_f1")
    parts = [evaluate.macro_f1(said.where(F.col("fold") == k), "label", "said").select(F.lit(k).alias("fold"), "macro_f1") for k in range(folds)]
    return reduce(DataFrame.unionByName, parts)


def distribution(scores: Column) -> Column:
    """Scores (an array) as shares of 1: their exponentials by the sum of these."""
    most = F.array_max(scores)
    lifted = F.transform(scores, lambda x: F.exp(x - most))
    return F.transform(lifted, lambda x: x / F.aggregate(lifted, F.lit(0.0), lambda a, y: a + y))


def promoted(old: DataFrame, new: DataFrame, floor: float, drop: float = 0.15, support: int = 2) -> DataFrame:
    """One row: old_f1, new_f1, fallen (labels that lost more than `drop`), promote (the new mean reaches the floor and the old one, and no label has fallen). Both: label, support, f1."""
    mean = lambda df, n: df.agg(F.avg("f1").alias(n))
    fallen = evaluate.regressions(old, new, drop, support).agg(F.array_sort(F.collect_list("label")).alias("fallen"))  # one row each
    held = mean(old, "old_f1").crossJoin(mean(new, "new_f1")).crossJoin(fallen)
    return held.withColumn("promote", (F.col("new_f1") >= floor) & (F.col("new_f1") >= F.coalesce("old_f1", F.lit(0.0))) & (F.size("fallen") == 0))


def fuse(rule: Column, rule_confidence: Column, stat: Column, stat_confidence: Column, backed: Column) -> Column:
    """A struct of label, confidence and review from a rule's and a model's answer.

    Both agree: their mean, 0.05 more if entities back it, at most 0.95, reviewed under 0.60. A sure
    model (0.80) against an unsure rule (0.45) is taken at 0.60 and reviewed; else the rule stays at
    0.40. A rule that abstains (null) stays.
    """
    mean = F.least(F.lit(0.95), (rule_confidence + stat_confidence) / 2 + F.when(backed, 0.05).otherwise(0.0))
    agree, sure = F.coalesce(rule == stat, F.lit(False)), rule.isNotNull() & (stat_confidence >= 0.80) & (rule_confidence <= 0.45)
    return F.struct(
        F.when(agree, rule).when(sure, stat).otherwise(rule).alias("label"), F.when(agree, mean).when(sure, 0.60).otherwise(0.40).alias("confidence"), F.when(agree, mean < 0.60).otherwise(True).alias("review")
    )


def hybrid_gate(df: DataFrame, truth: str, rule: str, said: str, fused: str) -> DataFrame:
    """One row: macro F1 of a rule, of a model (judged on rows it wasn't fitted on) and of both fused, and whether the fusion is at least as good as the rule."""
    parts = [evaluate.macro_f1(df, truth, c).select(F.col("macro_f1").alias(n)) for n, c in (("rule", rule), ("model", said), ("fused", fused))]  # a row each
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2]).withColumn("pass", F.col("fused") >= F.col("rule"))
