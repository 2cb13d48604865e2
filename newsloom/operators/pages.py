"""Whole pages of the read side: rows in order, exact totals, what may be seen, and the facts around a story, a place or a source.

Orders say where nulls go. Totals are one count a page; lists inside a row are bounded by a `most`
that is a feature of the page, never a guard against size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import codes, params


def page_of(df: DataFrame, order: list[Column], page: int = 1, size: int = 20) -> DataFrame:
    """A page of df in order, with total, page and pages; a page beyond the last is the last, and one of no rows is empty."""
    total = df.count()
    at = params.clamp(page, total, size)
    held = df.orderBy(*order).offset((at - 1) * size).limit(size)
    return held.withColumns({"total": F.lit(total).cast("bigint"), "page": F.lit(at), "pages": F.lit(params.pages(total, size))})


def snapshot(as_of: Column, now: Column) -> Column:
    """The instant that a reader sees: as_of if it lies between midnight in India and now, else now."""
    return F.when((as_of >= codes.ist_midnight(now)) & (as_of <= now), as_of).otherwise(now)


def public_view(articles: DataFrame, sources: DataFrame, stories: DataFrame, allowed: Column, granted: dict[str, list[str]]) -> dict[str, DataFrame]:
    """The rows and columns of each table that readers may see.

    Sources that are active; articles of those that `allowed` holds for (a null counts as allowed);
    stories with such an article. granted: the columns of each table that are shown.
    """
    open_sources = sources.where("active")
    open_articles = articles.where(F.coalesce(allowed, F.lit(True))).join(open_sources.select("source_id"), "source_id", "left_semi")
    open_stories = stories.join(open_articles.where("story_id IS NOT NULL").select("story_id"), "story_id", "left_semi")
    held = {"sources": open_sources, "articles": open_articles, "stories": open_stories}
    return {name: held[name].select(*columns) for name, columns in granted.items()}


def flagged(rows: DataFrame, members: DataFrame, key: str, flag: Column, name: str) -> DataFrame:
    """rows with whether any member of each is flagged; false without members, nulls don't flag."""
    by = members.groupBy(key).agg(F.bool_or(F.coalesce(flag, F.lit(False))).alias(name))
    return rows.join(by, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def hydrate(ids: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The rows of an array of ids in its order, with position (from 0); ids without a row are left out. ids: one row with the array `ids`."""
    listed = ids.select(F.posexplode("ids").alias("position", key))
    return listed.join(rows, key).orderBy("position")


def update_from(df: DataFrame, records: Column, schema: str, key: str, changes: dict[str, str]) -> DataFrame:
    """df with the columns of `changes` (column of df: field of a record) set from a JSON list of records with equal keys; other rows and null fields stay.

    Of several records of one key the first is taken.
    """
    spark = df.sparkSession
    listed = spark.range(1).select(F.posexplode(F.from_json(records, f"array<struct<{schema}>>")).alias("n", "r"))
    first = listed.groupBy(F.col(f"r.{key}").alias(key)).agg(F.min_by("r", "n").alias("__nl_r"))
    held = df.join(first, key, "left")
    return held.select(*[F.coalesce(F.col(f"__nl_r.{changes[c]}"), F.col(c)).alias(c) if c in changes else F.col(c) for c in df.columns])


def languages_of(members: DataFrame, key: str) -> DataFrame:
    """key and its languages in capitals, sorted."""
    return members.groupBy(key).agg(F.array_sort(F.collect_set(F.upper("language"))).alias("languages"))


def feed(stories: DataFrame, members: DataFrame, page: int = 1, size: int = 20) -> DataFrame:
    """A page of stories, last seen first, with their languages, sources and whether any report was curated. members: story_id, source, language, curated."""
    order = [F.col("last_seen_at").desc_nulls_last(), F.col("story_id").desc()]
    shown = page_of(stories, order, page, size)
    facts = members.join(F.broadcast(shown.select("story_id")), "story_id", "left_semi").groupBy("story_id").agg(  # a page of ids
        F.array_sort(F.collect_set(F.upper("language"))).alias("languages"), F.array_sort(F.collect_set("source")).alias("sources"), F.bool_or("curated").alias("curated")
    )
    none = F.array().cast("array<string>")
    held = shown.join(facts, "story_id", "left")
    held = held.withColumns({"languages": F.coalesce("languages", none), "sources": F.coalesce("sources", none), "curated": F.coalesce("curated", F.lit(False))})
    return held.orderBy(*order)


def mention_counts(members: DataFrame, key: str, names: str) -> DataFrame:
    """key, name, n: in how many members of a key a name is mentioned; a member counts once."""
    return members.select(key, F.explode(F.array_distinct(names)).alias("name")).groupBy(key, "name").agg(F.count("*").alias("n"))


def detail(story: DataFrame, members: DataFrame) -> DataFrame:
    """A story's row with its reports in order of time (unknown last, then by id), its languages, first and last report. members: story_id, id, source, headline, language, at."""
    reports = F.array_sort(F.collect_list(F.struct(F.col("at").isNull().alias("undated"), "at", "id", "source", "headline", "language")))
    by = members.join(story.select("story_id"), "story_id", "left_semi").groupBy("story_id").agg(
        reports.alias("reports"), F.array_sort(F.collect_set(F.upper("language"))).alias("languages"), F.min("at").alias("first_at"), F.max("at").alias("last_at")
    )
    return story.join(by, "story_id", "left")


def coverage(members: DataFrame, by: str) -> DataFrame:
    """Count of each value, most first, then by name."""
    return members.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col(by).asc_nulls_last())


def source_sample(articles: DataFrame, stories: DataFrame, source_id: int, most: int = 100) -> DataFrame:
    """Articles, stories and districts in a source's newest articles (undated ones last)."""
    order = [F.col("fetched_at").desc_nulls_last(), F.col("record_id").desc()]
    newest = articles.where(F.col("source_id") == source_id).orderBy(*order).limit(most)
    held = newest.join(stories.select("story_id", "district_names"), "story_id", "left").select("record_id", "story_id", F.explode_outer("district_names").alias("district"))
    return held.agg(F.count_distinct("record_id").alias("articles"), F.count_distinct("story_id").alias("stories"), F.count_distinct("district").alias("districts"))


def state_counts(keys: DataFrame, states: DataFrame, key: str, state: str) -> DataFrame:
    """How many keys are in each state; those without a state are UNKNOWN."""
    held = keys.select(key).distinct().join(states.select(key, state), key, "left")
    return held.groupBy(F.coalesce(state, F.lit("UNKNOWN")).alias(state)).agg(F.count("*").alias("n"))


def due(sources: DataFrame, checks: DataFrame, key: str, at: str, most: int | None = None) -> DataFrame:
    """Active sources, those never checked first, then the least recently checked."""
    last = checks.groupBy(key).agg(F.max(at).alias("last_check"))
    held = sources.where("active").select(key).join(last, key, "left").orderBy(F.col("last_check").asc_nulls_first(), F.col(key))
    return held if most is None else held.limit(most)


def guarded(df: DataFrame, most: int) -> DataFrame:
    """df, whose reading fails if it has more than `most` rows."""
    count = df.select(F.lit(1)).limit(most + 1).agg(F.count("*").alias("n"))
    check = count.select(F.when(F.col("n") > most, F.raise_error(F.lit(f"more than {most} rows"))).alias("__nl_over"))
    return df.join(F.broadcast(check), F.col("__nl_over").isNull(), "left").drop("__nl_over")  # one row
