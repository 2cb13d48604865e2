import os

import pytest

from newsloom.llm import mixing, tokenizers

pytestmark = pytest.mark.skipif(not os.path.exists(tokenizers.FOLDER), reason="no tokenizers here")
TARGETS = "plan_id int, source string, target_share double, max_repeats int, tokenizer string, budget_ratio double"


def test_shares_and_caps(spark):
    docs = [(i, "big" if i < 300 else "small", f"Text number {i} with some words in it " + "more words here " * (i % 7), "x") for i in range(330)]
    docs += [(900, "big", None, "x"), (901, "big", "", "x"), (902, None, "text", "x"), docs[0]]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string, n string")
    targets = spark.createDataFrame([(1, "big", 0.6, 1, "byte_bpe_50k", 0.3), (1, "small", 0.4, 5, "byte_bpe_50k", 0.3), (2, "small", 0.5, 2, "word_bpe_49k", 1.0), (2, "big", 0.5, 9, "word_bpe_49k", 1.0), (3, "none", 1.0, 1, "byte_bpe_50k", 1.0)], TARGETS)
    chosen = mixing.mix(df, targets, "doc_id", "text", "source")
    rows = chosen.collect()
    assert len({(r.plan_id, r.doc_id) for r in rows}) == len(rows) and not {r.doc_id for r in rows} & {900, 901, 902}
    caps = {(1, "big"): 1, (1, "small"): 5, (2, "small"): 2, (2, "big"): 9}
    assert all(1 <= r.repeats <= caps[r.plan_id, r.source] for r in rows)
    by = {(r.plan_id, r.source): r for r in mixing.shares(chosen, targets).collect()}
    for key in caps:
        assert abs(by[key].actual_share - by[key].target_share) < 0.02
    assert by[3, "none"].tokens == 0
    repeats = [r.repeats for r in rows if (r.plan_id, r.source) == (1, "small")]
    assert max(repeats) - min(repeats) <= 1  # whole epochs before the fraction
    again = {(r.plan_id, r.doc_id, r.repeats) for r in mixing.mix(df, targets, "doc_id", "text", "source").collect()}
    assert again == {(r.plan_id, r.doc_id, r.repeats) for r in rows}
    assert mixing.mix(df.limit(0), targets, "doc_id", "text", "source").count() == 0


def test_weights_decide_how_often(spark):
    """Better texts come first more often than poor ones of the same length."""
    docs = [(i, "s", ("words of a good text " * 12) if i % 2 else ("1 2 3 4 5 6 7 8 9 0 - " * 11 + "good text here")) for i in range(400)]
    df = spark.createDataFrame([(i, s, f"{t}{i}") for i, s, t in docs], "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([(1, "s", 1.0, 1, "byte_bpe_50k", 0.3)], TARGETS)
    rows = mixing.mix(df, targets, "doc_id", "text", "source").collect()
    good = sum(r.doc_id % 2 for r in rows)
    assert good > 0.65 * len(rows)


def test_weights_of_the_caller(spark):
    docs = [(i, "s", f"Text number {i} of the source.", 1.0 if i % 2 else 0.01) for i in range(400)] + [(900, "s", "No weight is given here.", None)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string, q double")
    targets = spark.createDataFrame([(1, "s", 1.0, 1, "byte_bpe_50k", 0.3)], TARGETS)
    from pyspark.sql import functions as F

    rows = mixing.mix(df, targets, "doc_id", "text", "source", F.col("q")).collect()
    assert sum(r.doc_id % 2 for r in rows) > 0.95 * len(rows) > 0


def test_counts(spark):
    df = spark.createDataFrame([(1, "a b", "byte_bpe_50k"), (2, None, "piece_bpe_32k"), (3, "", "word_bpe_49k"), (4, "hello world", "word_bpe_49k")], "k int, t string, z string")
    assert {r.k: r.n for r in mixing.token_counts(df, "t", "z", ["k"]).collect()} == {1: 2, 2: 0, 3: 0, 4: 2}
