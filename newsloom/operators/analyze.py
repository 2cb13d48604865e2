"""All that is known of an article after one pass: keys, language, scripts, signature, numbers, trust, labels and what it names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import hashing, languages, text
from newsloom.operators import dedup, evidence, lexicon


def enrich(articles: DataFrame) -> DataFrame:
    """articles (id, source_id, url, canonical_url, title, description, body) with the columns that need no other table."""
    held = dedup.with_keys(articles, "url", "canonical_url", "title", "body")
    words = text.tokens(F.col("body"))
    return held.withColumns({
        "detected": languages.detect(F.col("body")), "scripts": text.script_shares(F.col("body")), "fingerprint": hashing.simhash(words), "numbers": text.numbers(F.concat_ws(" ", "title", "body")),
        "headline": text.normalise_headline(F.col("title")), "summary": text.description(F.col("description")), "dateline": evidence.dateline(F.col("body")),
    })


def bundle(articles: DataFrame, lexicons: dict[str, tuple[DataFrame, float]], entities: DataFrame | None = None, caps: dict[str, int] | None = None) -> DataFrame:
    """enrich() and, for each lexicon (name: label, phrase, weight; least score), its label, and what each article names.

    lexicons gives the columns name and name_confidence; entities (entity, names, family) the column
    named: an array of entity, family, place and counted. An article without either keeps nulls.
    """
    held = enrich(articles)
    for name, (phrases, least) in lexicons.items():
        labels = lexicon.label(articles, phrases, "title", "body", "id", least)
        held = held.join(labels.select("id", F.col("label").alias(name), F.col("confidence").alias(f"{name}_confidence")), "id", "left")
    if entities is not None:
        found = evidence.collect(articles, entities, "id", "title", "body", caps)
        named = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("entity", "family", "place", "counted"))).alias("named"))  # what one text names
        held = held.join(named, "id", "left")
    return held
