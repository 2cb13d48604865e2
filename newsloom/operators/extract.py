"""Metadata of pages, and how far an extraction can be trusted, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text

TYPES = "NewsArticle|Article|BlogPosting|ReportageNewsArticle|AnalysisNewsArticle|BackgroundNewsArticle|OpinionNewsArticle|ReviewNewsArticle"
#: Characters that a body has at least.
LEAST = 50


def _json(c: Column, path: str) -> Column:
    return F.nullif(F.trim(F.get_json_object(c, path)), F.lit(""))


def _first(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def linked_data(page: Column) -> Column:
    """A struct of title, description, author, published, canonical and body from the first article node with a title."""
    scripts = F.regexp_extract_all(page, F.lit(r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""), 1)
    raw = lambda c: F.from_json(c, "array<string>")
    nodes = lambda s: F.when(F.trim(s).startswith("["), raw(s)).otherwise(F.coalesce(raw(F.get_json_object(s, "$['@graph']")), F.array(s)))
    held = F.flatten(F.transform(scripts, lambda s: F.coalesce(nodes(s), F.array().cast("array<string>"))))
    articles = F.filter(held, lambda n: F.coalesce(F.get_json_object(n, "$['@type']").rlike(rf'^\s*\[?.*"?(?<![A-Za-z])(?:{TYPES})(?![A-Za-z])'), F.lit(False)) & _json(n, "$.headline").isNotNull())
    one = F.try_element_at(articles, F.lit(1))
    author = _json(one, "$.author")
    people = F.transform(raw(author), lambda a: F.coalesce(_json(a, "$.name"), F.when(~a.startswith("{"), a)))
    named = F.when(author.startswith("["), F.nullif(F.array_join(F.array_compact(people), ", "), F.lit(""))).when(author.startswith("{"), _json(one, "$.author.name")).otherwise(author)
    where = _json(one, "$.mainEntityOfPage")
    where = F.when(where.startswith("{"), F.coalesce(_json(one, "$.mainEntityOfPage['@id']"), _json(one, "$.mainEntityOfPage.url"))).otherwise(where)
    body = _json(one, "$.articleBody")
    return F.struct(
        _json(one, "$.headline").alias("title"), _json(one, "$.description").alias("description"), named.alias("author"), _json(one, "$.datePublished").alias("published"),
        F.coalesce(where, _json(one, "$.url")).alias("canonical"), F.when(F.length(body) >= LEAST, body).alias("body"),
    )


def meta_tags(page: Column) -> Column:
    """Map of property, name or itemprop in lower case to content; the first of several."""
    tags = F.regexp_extract_all(page, F.lit(r"(?is)(<meta\s[^>]*>)"), 1)
    attribute = lambda t, names: F.coalesce(
        *[F.nullif(F.regexp_extract(t, rf"""(?is)\s(?:{names})\s*=\s*{q}([^{q}]*){q}""", 1), F.lit("")) for q in ('"', "'")]
    )
    pairs = F.transform(tags, lambda t: F.struct(F.lower(F.trim(attribute(t, "property|name|itemprop"))).alias("k"), F.trim(attribute(t, "content")).alias("v")))
    kept = F.filter(pairs, lambda p: p["k"].isNotNull() & p["v"].isNotNull())
    keys = F.array_distinct(F.transform(kept, lambda p: p["k"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("k"), F.filter(kept, lambda p: p["k"] == k)[0]["v"].alias("v"))))


def title_tag(page: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def canonical_link(page: Column) -> Column:
    tag = F.regexp_extract(page, r"""(?is)(<link\s[^>]*rel\s*=\s*["']?canonical["']?[^>]*>)""", 1)
    return F.nullif(F.regexp_extract(tag, r"""(?is)href\s*=\s*["']([^"']*)["']""", 1), F.lit(""))


def visible_length(page: Column) -> Column:
    """Characters of text outside scripts, styles and noscript."""
    bare = F.regexp_replace(page, r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " ")
    return F.length(F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->|<[^>]*>", " "), r"\s+", ""))


def confidence(title: Column, from_tag: Column, published: Column, description: Column, body: Column, titles: Column, canonical: Column, visible: Column) -> Column:
    """high, medium, low or failed from points for what was found and how it agrees; no body fails.

    from_tag: whether the title is the title tag's. titles: array of all titles found. visible: characters of the page's text.
    """
    n = F.length(F.trim(body))
    paragraphs = F.size(F.filter(F.split(body, r"\n+"), lambda p: F.trim(p) != ""))
    ratio = F.when(visible > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - n / visible))).otherwise(1.0)
    agreed = F.size(F.array_distinct(F.filter(F.transform(titles, text.normalise_title), lambda t: F.coalesce(t != "", F.lit(False)))))
    has = lambda c: F.coalesce(c != "", F.lit(False))
    points = (
        F.when(has(title), F.when(from_tag, 10).otherwise(20)).otherwise(0) + F.when(has(published), 15).otherwise(0) + F.when(has(description), 10).otherwise(0)
        + F.when(n >= 800, 20).when(n >= 400, 15).when(n >= 200, 10).otherwise(5) + F.when(paragraphs >= 5, 10).when(paragraphs >= 3, 6).otherwise(2)
        + F.when(ratio < 0.3, 10).when(ratio < 0.5, 5).otherwise(0) + F.when(agreed >= 2, 0).when(has(title), F.when(agreed == 1, 10).otherwise(3)).otherwise(0) + F.when(has(canonical), 5).otherwise(0)
    )
    band = F.when(points >= 75, "high").when(points >= 50, "medium").when(points >= 25, "low").otherwise("failed")
    return F.when(F.coalesce(n, F.lit(0)) < LEAST, "failed").otherwise(band)


# The references that pages use most.
_REFERENCES = {"&nbsp;": " ", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&"}


def _shown(c: Column) -> Column:
    """Text as shown: tags dropped, the common references resolved, space collapsed."""
    c = F.regexp_replace(c, r"(?s)<[^>]*>", "")
    for said, shown in _REFERENCES.items():
        c = F.replace(c, F.lit(said), F.lit(shown))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def paragraphs(page: Column, least: int = 25) -> Column:
    """The p elements of a page with at least so many characters, as shown, in order."""
    bare = F.regexp_replace(page, r"(?is)<(script|style|noscript|nav|footer|aside|header|form)\b.*?</\1\s*>", " ")
    return F.filter(F.transform(F.regexp_extract_all(bare, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)(?=</p\s*>|<p[\s>]|$)"), 1), _shown), lambda p: F.length(p) >= least)


_ADAPTERS: dict[str, str] = {}


def register_adapter(site: str, pattern: str) -> None:
    """For pages of a site the body is what the first group of a pattern holds; a pattern without a group is refused."""
    import re

    if re.compile(pattern).groups != 1:
        raise ValueError("a pattern has one group")
    _ADAPTERS[site.lower()] = pattern


def bodies(df: DataFrame, page: str, site: str) -> DataFrame:
    """df with body and stage of each page: linked data, else the paragraphs of its article element, else all its paragraphs; an adapter of its site where that gives more.

    A stage of fewer than LEAST characters gives nothing; no stage: null. Stages: ld, article, page, adapter.
    """
    c = F.col(page)
    joined = lambda x: F.array_join(paragraphs(x), "\n")
    stages = {"ld": linked_data(c)["body"], "article": joined(F.regexp_extract(c, r"(?is)<article\b[^>]*>(.*)</article\s*>", 1)), "page": joined(c)}
    held = F.coalesce(*[F.when(F.length(b) >= LEAST, F.struct(b.alias("body"), F.lit(n).alias("stage"))) for n, b in stages.items()])
    own = F.lit(None).cast("string")
    for name, pattern in _ADAPTERS.items():
        cut_ = F.regexp_extract(c, pattern, 1)
        text_ = F.when(cut_.rlike(r"(?i)<p[\s>]"), joined(cut_)).otherwise(_shown(cut_))
        own = F.when(F.lower(F.col(site)) == name, text_).otherwise(own)
    df = df.withColumn("__nl_b", held).withColumn("__nl_own", own)
    longer = (F.length("__nl_own") >= LEAST) & (F.length("__nl_own") > F.coalesce(F.length("__nl_b.body"), F.lit(0)))
    return df.withColumns({"body": F.when(longer, F.col("__nl_own")).otherwise(F.col("__nl_b.body")), "stage": F.when(longer, "adapter").otherwise(F.col("__nl_b.stage"))}).drop("__nl_b", "__nl_own")


def metadata(df: DataFrame, page: str) -> DataFrame:
    """df with meta: title, title_from_tag, description, author, published, canonical, titles and visible of each page, from linked data, then meta tags, then plain tags."""
    c = F.col(page)
    df = df.withColumn("__nl_ld", linked_data(c)).withColumn("__nl_meta", meta_tags(c))
    ld, tag = (lambda n: F.col(f"__nl_ld.{n}")), (lambda n: F.col("__nl_meta")[n])
    plain = title_tag(c)
    named = _first(ld("title"), tag("og:title"))
    fields = F.struct(
        F.coalesce(named, plain).alias("title"), (named.isNull() & plain.isNotNull()).alias("title_from_tag"), _first(ld("description"), tag("og:description"), tag("description")).alias("description"),
        _first(ld("author"), tag("article:author"), tag("author")).alias("author"), _first(ld("published"), tag("article:published_time"), tag("date"), tag("publish-date"), tag("publishdate")).alias("published"),
        _first(ld("canonical"), tag("og:url"), canonical_link(c)).alias("canonical"), F.array_compact(F.array(ld("title"), tag("og:title"), plain)).alias("titles"),
        visible_length(c).alias("visible"),
    )
    return df.withColumn("meta", fields).drop("__nl_ld", "__nl_meta")
