"""Exact and near duplicates among articles, by the keys and sketches of functions.text and functions.hashing."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import hashing, languages, text
from newsloom.operators import cluster
from newsloom.session import cut


def with_keys(df: DataFrame, url: str, canonical: str, headline: str, body: str) -> DataFrame:
    """canonical_key, content_key and headline_key of each row."""
    return df.withColumns({
        "canonical_key": F.coalesce(F.nullif(F.col(canonical), F.lit("")), F.col(url)),
        "content_key": text.content_hash(F.col(body)),
        "headline_key": text.headline_hash(F.col(headline)),
    })


def exact_duplicates(new: DataFrame, known: DataFrame) -> DataFrame:
    """id, duplicate_of, rule of each new row that equals a known one.

    Rules in order: address, content, headline of the same source. Both sides have id, source_id and
    the columns of with_keys. Of several known rows the lowest id is named; nulls equal nothing.
    """
    first = lambda *keys: known.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).groupBy(*keys).agg(F.min("id").alias("of"))
    held = new.select("id", "source_id", "canonical_key", "content_key", "headline_key")
    for n, keys in enumerate((["canonical_key"], ["content_key"], ["source_id", "headline_key"])):
        held = held.join(first(*keys).withColumnRenamed("of", f"of{n}"), keys, "left")
    rule = F.when(F.col("of0").isNotNull(), "canonical_url").when(F.col("of1").isNotNull(), "content_hash").when(F.col("of2").isNotNull(), "headline_hash")
    return held.select("id", F.coalesce("of0", "of1", "of2").alias("duplicate_of"), rule.alias("rule")).where("rule IS NOT NULL")


def batch_duplicates(df: DataFrame) -> DataFrame:
    """id, duplicate_of: rows taken in order of id, each compared with the kept rows before it.

    A duplicate's own keys never make a later row a duplicate, so the result is a fixpoint: a row
    is kept if each earlier row that shares a key with it is a duplicate. Each round settles the
    rows whose earlier partners are all settled, at least the lowest open one, so the rounds end.
    Links between rows of one key are followed from one to the next kept row, not listed as pairs.
    """
    rows = df.select("id", F.explode(F.array_compact(F.array(
        F.when(F.col("canonical_key").isNotNull(), F.struct(F.lit(0).alias("rule"), F.xxhash64(F.lit("u"), "canonical_key").alias("key"))),
        F.when(F.col("content_key").isNotNull(), F.struct(F.lit(1).alias("rule"), F.xxhash64(F.lit("c"), "content_key").alias("key"))),
        F.when(F.col("headline_key").isNotNull(), F.struct(F.lit(2).alias("rule"), F.xxhash64(F.lit("h"), "source_id", "headline_key").alias("key"))),
    ))).alias("k"))
    rows = rows.select("id", "k.rule", "k.key")
    shared = rows.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key")
    all_ = cut(rows.join(shared, "key", "left_semi"))
    open_, owners = all_, None
    while not open_.isEmpty():
        held = open_.join(open_.groupBy("key").agg(F.min("id").alias("first")), "key")
        kept = held.groupBy("id").agg(F.min(F.col("first") == F.col("id")).alias("kept")).where("kept").select("id")  # first in each of its keys
        now = cut(held.join(kept, "id", "left_semi").select("key", F.col("id").alias("owner")))
        owners = now if owners is None else cut(owners.unionByName(now))
        settled = open_.join(now.select("key"), "key", "left_semi").select("id").distinct()  # the kept ones and their duplicates
        open_ = cut(open_.join(settled, "id", "left_anti"))
    if owners is None:
        return df.select("id", F.col("id").alias("duplicate_of")).limit(0)
    # kept rows share no key, so each key has one owner at most
    named = all_.join(owners, "key").where("id > owner").groupBy("id").agg(F.min(F.struct("rule", "owner")).alias("m"))
    return named.select("id", F.col("m.owner").alias("duplicate_of"))


def with_signature(df: DataFrame, body: str) -> DataFrame:
    """terms (without the function words of English and Hindi) and the unigram signature (of all words) of each row."""
    content = lambda w: ~w.isin(*languages.ENGLISH, *languages.HINDI)
    df = df.withColumn("terms", text.tokens(F.col(body))).withColumn("sig", hashing.minhash(F.array_distinct("terms")))
    return df.withColumn("terms", F.filter("terms", content))


#: Rows of a part, and rows of two parts that are multiplied at once.
PART, STEP = 8000, 500


def _compare(threshold: float, table: pd.DataFrame) -> pd.DataFrame:
    """Pairs of one block that share a band and have the cosine. Rows: id, words (hashes), counts, bands, own and other (the parts that the block compares)."""
    ids, own = table["id"].to_numpy(np.int64), table["own"].to_numpy(np.int64)
    words = [np.asarray(w, np.int64) for w in table["words"]]
    counts = [np.asarray(c, np.int64) for c in table["counts"]]
    bands = np.array(table["bands"].tolist(), np.int64)
    norms = np.sqrt(np.array([(c * c).sum() for c in counts], np.float64))
    kind = np.float32 if norms.max() < 4096 else np.float64  # whole numbers below 2**24 are exact
    low = own.min()
    one = (table["own"] == table["other"]).all()
    left = np.flatnonzero(own == low)
    right = left if one else np.flatnonzero(own != low)
    cut_ = lambda rows: [rows[at : at + STEP] for at in range(0, len(rows), STEP)]
    vocabulary = lambda rows: np.unique(np.concatenate([words[r] for r in rows]))

    def dense(rows: np.ndarray, known: np.ndarray) -> np.ndarray:
        w, c = np.concatenate([words[r] for r in rows]), np.concatenate([counts[r] for r in rows])
        row = np.repeat(np.arange(len(rows)), [len(words[r]) for r in rows])
        at = np.minimum(np.searchsorted(known, w), len(known) - 1)
        held = known[at] == w
        out = np.zeros((len(rows), len(known)), kind)
        out[row[held], at[held]] = c[held]
        return out

    found = [pd.DataFrame({"id_a": ids[:0], "id_b": ids[:0], "cosine": norms[:0]})]
    heads, tails = cut_(left), cut_(right)
    tail_words = [vocabulary(t) for t in tails]
    for n, a in enumerate(heads):
        head_words = vocabulary(a)
        for m in range(n if one else 0, len(tails)):
            b = tails[m]
            known = np.intersect1d(head_words, tail_words[m], assume_unique=True)
            if not len(known):
                continue
            cosine = np.round(dense(a, known) @ dense(b, known).T / (norms[a][:, None] * norms[b][None]), 3)
            x, y = np.nonzero(np.triu(cosine >= threshold, 1) if one and m == n else cosine >= threshold)
            for at in range(0, len(x), 20_000):
                i, j = x[at : at + 20_000], y[at : at + 20_000]
                share = (bands[a[i]] == bands[b[j]]).any(axis=1)
                i, j = i[share], j[share]
                found.append(pd.DataFrame({"id_a": np.minimum(ids[a[i]], ids[b[j]]), "id_b": np.maximum(ids[a[i]], ids[b[j]]), "cosine": cosine[i, j]}))
    return pd.concat(found)


def near_duplicates(df: DataFrame, threshold: float = 0.6, least_terms: int = 10, rows: int = 2) -> DataFrame:
    """id_a, id_b, cosine: rows that share a band of their signature and whose word counts have a cosine of at least `threshold`. df comes from with_signature.

    Rows with equal word counts and signatures are one class: its lowest id meets the others, and each
    of its other rows is paired with that id at a cosine of 1; so each row with a near one is named, and copies
    of one text add no pairs among themselves. Rows are put in parts by a hash and each two parts are compared in a block,
    so the work of a task doesn't depend on how many rows share a band.
    """
    held = df.where(F.size("terms") >= least_terms)
    words = F.array_sort(F.transform("terms", lambda w: F.xxhash64(w)))
    held = held.select("id", "sig", words.alias("all")).withColumn("words", F.array_distinct("all"))
    positions = F.transform("words", lambda w: F.array_position("all", w))
    counts = F.zip_with(positions, F.concat(F.slice(positions, 2, 1 << 30), F.array(F.size("all").cast("bigint") + 1)), lambda a, b: b - a)
    held = cut(held.select("id", "sig", "words", counts.cast("array<int>").alias("counts"), F.xxhash64("all").alias("text")))
    firsts = held.groupBy("sig", "text").agg(F.min_by(F.struct("words", "counts"), "id").alias("m"), F.min("id").alias("id"))
    classes = cut(firsts.select("id", "m.*", hashing.bands(F.col("sig"), rows).alias("bands"), "sig", "text"))
    members = held.select("id", "sig", "text").join(classes.select(F.col("id").alias("id_a"), "sig", "text"), ["sig", "text"]).where("id > id_a")
    members = members.select("id_a", F.col("id").alias("id_b"), F.lit(1.0).alias("cosine"))
    classes = classes.drop("sig", "text")
    parts = max(-(-(n := classes.count()) // PART), min(5, -(-n // STEP)), 1)
    split = classes.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(parts))).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("other", F.col("other").cast("bigint"))
    blocks = split.groupBy(F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    pairs = blocks.applyInPandas(lambda table: _compare(threshold, table), "id_a bigint, id_b bigint, cosine double")
    return pairs.unionByName(members)


def compare_texts(pairs: DataFrame, a: str, b: str, least: int = 10, threshold: float = 0.60) -> DataFrame:
    """pairs with verdict (insufficient, near or different), cosine of content words, estimate (shared runs of five words by their minimum hashes) and distance (bits of the words' SimHash).

    A text of fewer than `least` content words can't be judged; the estimate and the distance are told, not judged by.
    """
    words = lambda c: text.tokens(F.col(c))
    content = lambda c: F.filter(words(c), lambda w: ~w.isin(*languages.ENGLISH, *languages.HINDI))
    held = pairs.withColumns({"__nl_a": content(a), "__nl_b": content(b)})
    held = held.withColumn("cosine", hashing.word_cosine("__nl_a", "__nl_b"))
    held = held.withColumn("estimate", hashing.agreement(hashing.minhash(text.shingles(words(a), 5)), hashing.minhash(text.shingles(words(b), 5))))
    held = held.withColumn("distance", hashing.hamming(hashing.simhash(words(a)), hashing.simhash(words(b))))
    few = (F.size("__nl_a") < least) | (F.size("__nl_b") < least)
    return held.withColumn("verdict", F.when(few, "insufficient").when(F.col("cosine") >= threshold, "near").otherwise("different")).drop("__nl_a", "__nl_b")


def assign(new: DataFrame, known: DataFrame, near: DataFrame, stories: DataFrame, story_pairs: DataFrame, threshold: float = 0.60) -> DataFrame:
    """id, duplicate_of, rule, story_id of each new article.

    In order: an exact duplicate (exact_duplicates), a near one of the same source (the highest
    cosine, then the lowest id), else the best story of its pairs. near: id, known_id, source_id,
    known_source, cosine. stories: id, story_id of known articles. story_pairs: id, story_id, score.
    A duplicate takes the story of what it repeats.
    """
    exact = exact_duplicates(new, known)
    own = near.where("source_id = known_source").groupBy("id").agg(F.max_by("known_id", F.struct("cosine", (-F.col("known_id")).alias("first"))).alias("of"))
    held = new.select("id").join(exact, "id", "left").join(own, "id", "left")
    held = held.select("id", F.coalesce("duplicate_of", "of").alias("duplicate_of"), F.coalesce("rule", F.when(F.col("of").isNotNull(), "near")).alias("rule"))
    told = stories.select(F.col("id").alias("duplicate_of"), F.col("story_id").alias("__nl_told"))
    best = cluster.assign(story_pairs, "id", "story_id", "score", threshold).select("id", F.col("story_id").alias("__nl_best"))
    held = held.join(told, "duplicate_of", "left").join(best, "id", "left")
    return held.select("id", "duplicate_of", "rule", F.when(F.col("rule").isNull(), F.col("__nl_best")).otherwise(F.col("__nl_told")).alias("story_id"))
