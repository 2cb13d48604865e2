"""Reads over stories, articles and sources: timeline, search, archive, recount, detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import codes, text


def visible(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Articles of active sources whose extraction didn't fail."""
    active = sources.where("active").select("source_id")
    return articles.where(~F.coalesce(F.col("extraction_confidence"), F.lit("")).eqNullSafe("failed")).join(active, "source_id", "left_semi")


def rollup(articles: DataFrame) -> DataFrame:
    """A row a story: reports, sources, languages, first and latest report, headline and dating of the latest.

    articles: story_id, id, source_id, language, headline, published_us, seen_us (micros).
    """
    at = F.coalesce("published_us", "seen_us")
    newest = F.struct(at.alias("at"), F.col("id"))
    return articles.groupBy("story_id").agg(
        F.min(at).alias("first_report"), F.max(at).alias("latest_report"), F.count("*").alias("article_count"), F.count_distinct("source_id").alias("source_count"),
        F.array_sort(F.collect_set(F.upper("language"))).alias("languages"),
        F.max_by(F.col("published_us").isNotNull(), newest).alias("date_verified"), F.max_by("headline", newest).alias("latest_headline"),
    )


def timeline(stories: DataFrame, articles: DataFrame, now: Column, days: int = 6, page: int = 1, size: int = 90) -> DataFrame:
    """Stories with a report since midnight in India `days` days ago, newest first, one page of them; `now` is a timestamp."""
    micros = F.unix_micros(now)
    seen = articles.where((F.coalesce("published_us", "seen_us") <= micros) & (F.col("seen_us") <= micros))
    recent = rollup(seen).where(F.col("latest_report") >= F.unix_micros(codes.ist_midnight(now, days)))
    held = stories.select("story_id", "canonical_title", "primary_category", "event_type").join(recent, "story_id")
    return held.orderBy(F.col("latest_report").desc_nulls_last(), F.col("story_id").desc()).offset((page - 1) * size).limit(size)


def search(
    stories: DataFrame, members: DataFrame, tokens: list[str], *, category: str | None = None, event: str | None = None, source: str | None = None, language: str | None = None,
    year: int | None = None, limit: int | None = 20, offset: int = 0,
) -> DataFrame:
    """Stories that hold every distinct token somewhere: in title or category, in a member's headline, in an entity, in a member's source.

    members: story_id, headline, language, source_name, source_domain, entities. All tokens are
    tested in one scan of stories and one of members, whatever their number. Ordered by whether the
    title holds all of them, then newest, then highest id; `limit` is at most 100, null for all.
    """
    distinct = list(dict.fromkeys(tokens))
    rows = stories
    for column, value in (("primary_category", category), ("event_type", event)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if year is not None:
        edge = lambda y: F.to_utc_timestamp(F.lit(f"{y}-01-01 00:00:00").cast("timestamp"), "Asia/Kolkata")
        rows = rows.where((F.col("first_seen_at") >= edge(year)) & (F.col("first_seen_at") < edge(year + 1)))
    if source is not None:
        rows = rows.join(members.where(F.col("source_name") == source).select("story_id"), "story_id", "left_semi")
    if language is not None:
        rows = rows.join(members.where(F.col("language") == language).select("story_id"), "story_id", "left_semi")
    own = lambda t: text.matches_token(F.col("canonical_title"), t) | text.matches_token(F.col("primary_category"), t)
    theirs = lambda t: (
        text.matches_token(F.col("headline"), t) | text.matches_token(F.col("source_name"), t) | text.matches_token(F.col("source_domain"), t)
        | F.exists(F.coalesce("entities", F.array().cast("array<string>")), lambda e: text.search_norm(e).contains(text.search_norm(F.lit(t))))
    )
    if distinct:
        hits = members.groupBy("story_id").agg(*[F.bool_or(theirs(t)).alias(f"m{i}") for i, t in enumerate(distinct)])
        rows = rows.join(hits, "story_id", "left")
        for i, t in enumerate(distinct):
            rows = rows.where(own(t) | F.coalesce(F.col(f"m{i}"), F.lit(False)))
    title = F.lit(bool(distinct))
    for t in distinct:
        title = title & text.matches_token(F.col("canonical_title"), t)
    rows = rows.select("story_id", "canonical_title", "first_seen_at", title.alias("title_match"))
    if limit is None:
        return rows
    return rows.orderBy(F.col("title_match").desc(), F.col("first_seen_at").desc_nulls_last(), F.col("story_id").desc()).offset(max(0, offset)).limit(min(limit, 100))


def archive(stories: DataFrame, year: int | None = None, month: int | None = None, page: int = 1, size: int = 20) -> DataFrame:
    """A page of stories, newest first, of a year or month of India's calendar."""
    rows = stories
    if year is not None:
        start = f"{year}-{month or 1:02d}-01 00:00:00"
        end = f"{year + 1}-01-01 00:00:00" if month is None or month == 12 else f"{year}-{month + 1:02d}-01 00:00:00"
        edge = lambda s: F.to_utc_timestamp(F.lit(s).cast("timestamp"), "Asia/Kolkata")
        rows = rows.where((F.col("first_seen_at") >= edge(start)) & (F.col("first_seen_at") < edge(end)))
    return rows.orderBy(F.col("first_seen_at").desc_nulls_last(), F.col("story_id").desc()).offset((page - 1) * size).limit(size)


def recount(stories: DataFrame, articles: DataFrame) -> DataFrame:
    """Counts and times of each story from its members; a story without members keeps its own times."""
    at = F.coalesce("published_us", "seen_us")
    by = articles.groupBy("story_id").agg(F.count("*").alias("n"), F.count_distinct("source_id").alias("s"), F.min(at).alias("lo"), F.max(at).alias("hi"))
    held = stories.join(by, "story_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return held.select(
        "story_id", zero("n").alias("article_count"), zero("s").alias("source_count"),
        F.coalesce("lo", F.unix_micros("first_seen_at")).alias("first_seen_us"), F.coalesce("hi", F.unix_micros("last_seen_at")).alias("last_seen_us"),
    )


def unanimous(df: DataFrame, key: str, value: str) -> DataFrame:
    """The value of each key if all its non-null values are one, else null."""
    return df.groupBy(key).agg(F.when(F.count_distinct(value) == 1, F.min(value)).alias(value))


def distribution(df: DataFrame, by: str) -> DataFrame:
    """Count of each value, most first, nulls as one and last."""
    return df.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.col(by).isNull(), F.col("n").desc(), F.col(by))
