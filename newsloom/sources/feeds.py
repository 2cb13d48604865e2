"""Feeds, sitemaps and post lists as rows of links.

Each reader takes a column of whole documents and gives one row an entry: the keys, url, published
(as written), title, summary. Broken documents give no rows.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ATOM = "{http://www.w3.org/2005/Atom}"
_SITEMAP = "{http://www.sitemaps.org/schemas/sitemap/0.9}"
_NEWS = "{http://www.google.com/schemas/sitemap-news/0.9}"
_DC = "{http://purl.org/dc/elements/1.1/}"
Entry = tuple[str, str | None, str | None, str | None]


def _text(node: ET.Element | None) -> str | None:
    said = "".join(node.itertext()).strip() if node is not None else ""
    return said or None


def _tree(xml: str) -> ET.Element | None:
    if "<!ENTITY" in xml:  # entity bombs
        return None
    try:
        return ET.fromstring(xml.strip().encode() if xml.lstrip().startswith("<?xml") else xml.strip())
    except (ET.ParseError, ValueError):
        return None


def rss(xml: str, base: str) -> Iterator[Entry]:
    """RSS 2.0: the link, else the guid; pubDate, else the Dublin Core date."""
    tree = _tree(xml)
    for item in tree.iter("item") if tree is not None else ():
        link = _text(item.find("link")) or _text(item.find("guid"))
        if link:
            yield urljoin(base, link), _text(item.find("pubDate")) or _text(item.find(f"{_DC}date")), _text(item.find("title")), _text(item.find("description"))


def atom(xml: str, base: str) -> Iterator[Entry]:
    """Atom: the alternate link or one without a relation, else the first; published, else updated."""
    tree = _tree(xml)
    for entry in tree.iter(f"{_ATOM}entry") if tree is not None else ():
        links = [x for x in entry.findall(f"{_ATOM}link") if x.get("href")]
        best = [x for x in links if x.get("rel", "alternate") == "alternate"] or links
        if best:
            when = _text(entry.find(f"{_ATOM}published")) or _text(entry.find(f"{_ATOM}updated"))
            yield urljoin(base, best[0].get("href", "")), when, _text(entry.find(f"{_ATOM}title")), _text(entry.find(f"{_ATOM}summary"))


def sitemap(xml: str, base: str) -> Iterator[Entry]:
    """A sitemap's pages with the news date, else lastmod; an index's children of the same origin."""
    tree = _tree(xml)
    if tree is None:
        return
    origin = urlsplit(base)[:2]
    for kind in ("url", "sitemap"):
        for node in tree.iter(f"{_SITEMAP}{kind}"):
            link = _text(node.find(f"{_SITEMAP}loc"))
            if link and (kind == "url" or urlsplit(urljoin(base, link))[:2] == origin):
                news = node.find(f"{_NEWS}news")
                when = _text(news.find(f"{_NEWS}publication_date")) if news is not None else None
                yield urljoin(base, link), when or _text(node.find(f"{_SITEMAP}lastmod")), _text(news.find(f"{_NEWS}title")) if news is not None else None, None


def wordpress(body: str, base: str) -> Iterator[Entry]:
    """A list of WordPress posts: those with a link; date, else modified."""
    try:
        posts = json.loads(body)
    except ValueError:
        return
    for post in posts if isinstance(posts, list) else ():
        if isinstance(post, dict) and isinstance(post.get("link"), str) and post["link"]:
            title, summary = ((post.get(k) or {}).get("rendered") if isinstance(post.get(k), dict) else None for k in ("title", "excerpt"))
            yield urljoin(base, post["link"]), post.get("date") or post.get("modified"), title, summary


_LINK = re.compile(r"<a\s[^>]*?href\s*=\s*[\"']([^\"']+)[\"'][^>]*>(.*?)</a>", re.I | re.S)
_ASSET = re.compile(r"\.(?:jpe?g|png|gif|webp|svg|css|js|ico|mp[34]|zip|xml|json)(?:\?|$)", re.I)


#: Parts of a path that lists and services have, not articles.
LISTS = frozenset("tag tags category categories author authors topic topics page search login register subscribe about contact privacy terms feed rss gallery archive".split())
_ROW = re.compile(r"<tr\b.*?</tr\s*>", re.I | re.S)
_CELL = re.compile(r"<t[dh]\b[^>]*>(.*?)(?=</t[dh]\s*>|<t[dh]\b|</tr)", re.I | re.S)
_DATE = re.compile(r"\b(?:\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}|\d{1,2}\s+[A-Za-z]{3,9}\.?,?\s+\d{4})\b")


def _plain(markup: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"<[^>]*>", " ", markup)).strip()


def _row_facts(page: str) -> dict[str, tuple[str, str | None]]:
    """Of each address linked in a table's row: the row's longest other cell and its date."""
    facts: dict[str, tuple[str, str | None]] = {}
    for row in _ROW.findall(page):
        cells = [(c, _plain(c)) for c in _CELL.findall(row)]
        date = next((m.group() for _, t in cells if (m := _DATE.search(t))), None)
        for m in _LINK.finditer(row):
            others = [t for c, t in cells if m.group(1) not in c and not _DATE.fullmatch(t)]
            facts.setdefault(m.group(1).strip(), (max(others, key=len, default=""), date))
    return facts


def section(page: str, base: str, lists: frozenset[str] = LISTS, named: int = 12) -> Iterator[Entry]:
    """The links of a section page to pages of its own site: no assets, no lists, fragments dropped, each once, titles up to 300 characters.

    A link in a table's row takes the row's date, and its longest cell as title where its own text has fewer than `named` characters.
    """
    home = re.sub(r"^(?:www|m)\.", "", urlsplit(base).netloc.lower())
    seen, facts = set(), _row_facts(page)
    for m in _LINK.finditer(page):
        url = urljoin(base, m.group(1).strip()).split("#")[0]
        parts = urlsplit(url)
        there = re.sub(r"^(?:www|m)\.", "", parts.netloc.lower())
        inside = there == home or there.endswith("." + home)
        if parts.scheme in ("http", "https") and inside and parts.path.strip("/") and not _ASSET.search(url) and not lists & set(parts.path.lower().strip("/").split("/")) and url not in seen:
            seen.add(url)
            title, date = _plain(m.group(2)), None
            if m.group(1).strip() in facts:
                cell, date = facts[m.group(1).strip()]
                title = cell if len(title) < named and cell else title
            yield url, date, title[:300] or None, None


READERS: dict[str, Callable[[str, str], Iterator[Entry]]] = {"rss": rss, "atom": atom, "sitemap": sitemap, "wordpress": wordpress, "section": section}


def entries(df: DataFrame, kind: str, document: str, base: str, keys: list[str]) -> DataFrame:
    """One row an entry of each document of df, in place: keys, position, url, published, title, summary."""
    read = READERS[kind]
    names = [f"k{i}" for i in range(len(keys))]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                if row.document:
                    rows += [(*row[: len(names)], n, *entry) for n, entry in enumerate(read(row.document, row.base or ""))]
            yield pd.DataFrame(rows, columns=[*names, "position", "url", "published", "title", "summary"])

    held = df.select(*[F.col(k).alias(n) for n, k in zip(names, keys)], F.col(document).alias("document"), F.col(base).alias("base"))
    kinds = ", ".join(f"{n} {held.schema[n].dataType.simpleString()}" for n in names)
    done = held.mapInPandas(scan, f"{kinds}, position int, url string, published string, title string, summary string")
    return done.withColumnsRenamed(dict(zip(names, keys)))
