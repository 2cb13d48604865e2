"""The headline that stands for a story."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text

# Points for how far an extraction and a source are trusted.
CONFIDENCE = {"high": 10, "medium": 5, "low": 0}
PRIORITY = {"high": 5, "medium": 2, "low": 0}


def _points(c: Column, table: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, n in table.items():
        out = F.when(c == name, n).otherwise(out)
    return out


def top_entities(members: DataFrame, story: str, entities: str, most: int = 3) -> DataFrame:
    """The entities that most members of a story name, the first in order of several, as an array."""
    counts = members.select(story, F.explode(entities).alias("e")).groupBy(story, F.lower("e").alias("e")).agg(F.count("*").alias("n"))
    listed = counts.groupBy(story).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "e"))), 1, most).alias("top"))
    return listed.select(story, F.transform("top", lambda x: x["e"]).alias("top"))


def points(headline: Column, confidence: Column, priority: Column, top: Column | None = None, actions: list[str] | None = None) -> Column:
    """Points of a headline: 10 for each top entity named, 20 for a word of `actions`, -25 for clickbait, conciseness, 10 from five distinct words, trust."""
    words = F.array_distinct(text.tokens(headline))
    total = text.conciseness(headline) + F.when(F.size(words) >= 5, 10).otherwise(0) - F.when(text.clickbait(headline), 25).otherwise(0)
    total = total + _points(confidence, CONFIDENCE) + _points(priority, PRIORITY)
    if actions:
        total = total + F.when(F.arrays_overlap(words, F.array(*[F.lit(a) for a in actions])), 20).otherwise(0)
    if top is not None:
        named = lambda e: F.arrays_overlap(words, F.filter(F.split(e, r"[-_\s]+"), lambda p: F.length(p) >= 3))
        total = total + 10 * F.size(F.filter(F.coalesce(top, F.array().cast("array<string>")), named))
    return total


def best(members: DataFrame, story: str, headline: str, score: Column, at: str) -> DataFrame:
    """story, headline, score: the headline with most points, the earliest, then the first in order; blank ones are left out."""
    rows = members.where(F.trim(headline) != "").select(story, F.struct((-score).alias("s"), F.col(at).alias("t"), F.trim(headline).alias("h")).alias("m"))
    won = rows.groupBy(story).agg(F.min("m").alias("m"))
    return won.select(story, F.col("m.h").alias("headline"), (-F.col("m.s")).alias("score"))
