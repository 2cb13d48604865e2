"""Page furniture, and lines repeated across a source.

Furniture (site template removal): each element of a page is a subtree; its hash is made bottom-up of
its name, its class, its texts and the hashes of the elements in it, and counted a host over distinct
pages. Subtrees that recur across many pages of a host are deleted whole, with all text in them.
What is left is of one page: the article, and the teasers, captions, credits and comments that change
from page to page; of it the running text of the element with the main heading is kept.

Repeated lines: a source's lines are cut into chunks whose ends are set by a rolling hash of their
letters, chunks are counted by distinct records of the source, and a line all of whose chunks recur
is counted itself. A line that recurs has only chunks that recur as often, so no line is lost.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm import html
from newsloom.session import cut, small

#: A line recurs from so many records, and from such a share of its source's records.
LINE_RECORDS, LINE_SHARE = 4, 0.1
#: A subtree is a host's template from so many of its pages, and from such a share of them.
PAGES, PAGE_SHARE = 3, 0.05
#: A text that pages of any host show outside running text so often, and so many times as often as inside, is furniture in extracted lines too, whose place isn't known.
OUTSIDE, OUTSIDE_TIMES = 3, 4
WINDOW, MASK = 8, 31
_PRIME = np.uint32(0x01000193)


def letters(line: Column) -> Column:
    """Letters and combining marks of a line in lower case, in order."""
    return F.regexp_replace(F.lower(line), r"[^\p{L}\p{M}]+", "")


def chunk_hashes(lines: list[str]) -> list[np.ndarray]:
    """Hashes of the chunks of each line. A chunk ends where the rolling hash of the last WINDOW characters of the line is 0 modulo MASK + 1."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    codes = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32)
    n = len(codes)
    if not n:
        return [np.zeros(0, np.int64) for _ in lines]
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    place = np.arange(n) - np.repeat(starts, sizes)
    mixed = (codes * np.uint32(0x9E3779B1)) ^ (codes >> np.uint32(7))
    rolling, factor = np.zeros(n, np.uint32), np.uint32(1)
    for k in range(WINDOW):
        rolling[k:] += mixed[: n - k] * factor
        factor = np.uint32((int(factor) * int(_PRIME)) & 0xFFFFFFFF)
    rolling ^= rolling >> np.uint32(15)
    ends = (rolling & np.uint32(MASK)) == 0
    ends &= place >= WINDOW - 1
    begins = np.zeros(n, bool)
    begins[starts[sizes > 0]] = True
    begins[1:] |= ends[:-1]
    at = np.flatnonzero(begins)
    offset = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
    powers = np.cumprod(np.full(int(offset.max()) + 1, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
    spread = (codes.astype(np.uint64) + np.uint64(0x51ED27)) * np.uint64(0xBF58476D1CE4E5B9)
    spread ^= spread >> np.uint64(29)
    hashes = np.add.reduceat(spread * powers[offset], at).view(np.int64)
    counts = np.searchsorted(at, starts + sizes) - np.searchsorted(at, starts)
    return np.split(hashes, np.cumsum(counts)[:-1])


def _lines(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """k, s, n, h, chunks: each line with letters, by its hash and those of its chunks."""
    rows = df.select(F.col(key).alias("k"), F.col(source).alias("s"), F.posexplode(F.split(text, "\n")).alias("n", "line"))
    rows = rows.select("k", "s", "n", letters(F.col("line")).alias("line")).where("line != ''")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in "ks"}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            held = chunk_hashes(batch.column(3).to_pylist())
            ends = np.concatenate(([0], np.cumsum([len(x) for x in held]))).astype(np.int32)
            chunks = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(4), chunks], ["k", "s", "n", "h", "chunks"])

    rows = rows.withColumn("h", F.xxhash64("line"))
    return rows.mapInArrow(scan, f"k {kinds['k']}, s {kinds['s']}, n int, h bigint, chunks array<bigint>")


def repeated_lines(df: DataFrame, key: str, source: str, text: str, records: int = LINE_RECORDS, share: float = LINE_SHARE) -> DataFrame:
    """key, line_no (from 0), records: each line of `text` in at least `records` records and `share` of all records of its source.

    Lines are split at line feeds and compared by letters and marks in lower case; lines without
    letters are no case, nor are rows whose source is null. A record counts once however often it
    holds a line or is delivered.
    """
    rows = df.where(F.col(source).isNotNull() & F.col(key).isNotNull())
    lines = cut(_lines(rows, key, source, text))
    total = rows.groupBy(F.col(source).alias("s")).agg(F.greatest(F.lit(records), F.ceil(F.count_distinct(F.col(key)) * share - 1e-9)).alias("least"))
    total = small(total)
    chunks = lines.select("k", "s", F.explode(F.array_distinct("chunks")).alias("c"))
    often = chunks.groupBy("s", "c").agg(F.count_distinct("k").alias("r")).where(F.col("r") >= records)
    often = often.join(total, "s").where("r >= least").select("s", "c")
    parts = lines.select("k", "s", "n", "h", F.size(F.array_distinct("chunks")).alias("all"), F.explode(F.array_distinct("chunks")).alias("c"))
    held = parts.join(often, ["s", "c"]).groupBy("k", "s", "n", "h", "all").agg(F.count("*").alias("found")).where("found = all")
    counts = held.groupBy("s", "h").agg(F.count_distinct("k").alias("records")).join(total, "s").where("records >= least")
    return held.join(counts, ["s", "h"]).select(F.col("k").alias(key), F.col("n").cast("bigint").alias("line_no"), F.col("records")).distinct()


def without_lines(df: DataFrame, key: str, text: str, found: DataFrame) -> DataFrame:
    """df with the found lines taken out of `text`; rows without any stay as they are."""
    gone = found.groupBy(F.col(key).alias("__nl_k")).agg(F.collect_set("line_no").alias("__nl_gone"))
    held = df.join(gone, F.col(f"`{key}`") == F.col("__nl_k"), "left")
    kept = F.filter(F.split(F.col(f"`{text}`"), "\n"), lambda line, i: ~F.array_contains("__nl_gone", i.cast("bigint")))
    new = F.when(F.col("__nl_gone").isNull(), F.col(f"`{text}`")).otherwise(F.array_join(kept, "\n"))
    return held.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in df.columns])


@lru_cache(maxsize=1)
def _not_word():
    import regex

    return regex.compile(r"[^\p{L}\p{M}\p{N}]+")


def para_key(text: str) -> str:
    """The first 16 digits of the MD5 of a paragraph's letters, marks and numbers in lower case."""
    return hashlib.md5(_not_word().sub("", text.lower()).encode("utf-8", "surrogatepass")).hexdigest()[:16]


_NUMBER = re.compile(r"\d+")
_ENDED = re.compile(r"[.!?।۔؟…][\"'”’»)]*\s*$")


class Page(NamedTuple):
    hashes: list[int]  # of the subtrees: first one for each text, then one for each element around a text
    keys: list[str]  # para_key of each text
    loose: list[int]  # hash of each text with any number for any other
    running: list[bool]  # whether a text may be running text of the article
    paths: list[list[int]]  # the subtrees that hold each text: numbers in hashes


def _digest(said: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(said) - (1 << 63)


def _leaf(key: str, text: str, running: bool) -> tuple[int, int]:
    """The hash of a text alone, and that with any number for any other; outside running text the second stands for both."""
    own = _digest(key)
    loose = _digest(para_key(_NUMBER.sub("0", text))) if _NUMBER.search(text) else own
    return own if running else loose, loose


def page_subtrees(page: str) -> Page:
    """The subtrees of a page of HTML."""
    found, elements = html.tree(page)
    held = set(html.article(found))
    running = [k in held and html.prose(b) for k, b in enumerate(found)]
    keys = [para_key(b.text) for b in found]
    leaves = [_leaf(key, b.text, r) for key, b, r in zip(keys, found, running)]
    hashes = [h for h, _ in leaves]
    inside: dict[int, list[tuple[int, int]]] = {}  # of each element: the place of each of its texts and elements, and their hashes
    above: dict[int, int] = {}
    for k, b in enumerate(found):
        inside.setdefault(b.element, []).append((k, hashes[k]))
        chain = (*b.parents, b.element)
        above.update(zip(chain[1:], chain))
    number: dict[int, int] = {}
    for e in sorted({e for b in found for e in (*b.parents, b.element)}, reverse=True):  # an element's number is above that of the one around it
        parts = sorted(inside[e])
        number[e] = len(hashes)
        hashes.append(_digest(f"{elements[e]}{[h for _, h in parts]}"))
        if e in above:
            inside.setdefault(above[e], []).append((parts[0][0], hashes[-1]))
    paths = [[k, *(number[e] for e in (*b.parents, b.element))] for k, b in enumerate(found)]
    return Page(hashes, keys, [h for _, h in leaves], running, paths)


def line_subtrees(body: str) -> Page:
    """The same for extracted text, where each line is a text without an element."""
    lines = [line for line in body.split("\n") if line.strip()]
    keys = [para_key(line) for line in lines]
    running = [bool(_ENDED.search(line)) and line.strip().count(" ") >= 2 for line in lines]
    leaves = [_leaf(*x) for x in zip(keys, lines, running)]
    return Page([h for h, _ in leaves], keys, [h for _, h in leaves], running, [[k] for k in range(len(lines))])


def subtrees(pages: DataFrame) -> DataFrame:
    """src, row_id, host, page, uid (of a row with its text), markup, hashes, texts (key, loose, running, path) of each page; see Page."""
    rows = pages.where("text IS NOT NULL AND text != ''")
    rows = rows.select("src", "row_id", F.coalesce("host", F.lit("")).alias("host"), F.xxhash64("page").alias("page"), F.xxhash64("src", "row_id", "text").alias("uid"), "markup", "text")
    kind = pa.list_(pa.struct([("key", pa.string()), ("loose", pa.int64()), ("running", pa.bool_()), ("path", pa.list_(pa.int32()))]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                found = [page_subtrees(t) if m else line_subtrees(t) for t, m in zip(batch.column(6).to_pylist(), batch.column(5).to_pylist())]
                texts = [[{"key": k, "loose": h, "running": r, "path": p} for k, h, r, p in zip(x.keys, x.loose, x.running, x.paths)] for x in found]
                yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array([x.hashes for x in found], pa.list_(pa.int64())), pa.array(texts, kind)], ["src", "row_id", "host", "page", "uid", "markup", "hashes", "texts"])

    return rows.mapInArrow(scan, "src string, row_id bigint, host string, page bigint, uid bigint, markup boolean, hashes array<bigint>, texts array<struct<key: string, loose: bigint, running: boolean, path: array<int>>>")


def without_templates(found: DataFrame) -> DataFrame:
    """src, row_id, page, markup, texts (key, loose, running, gone: whether a recurring subtree holds it); found comes from subtrees."""
    sizes = small(found.groupBy("host").agg(F.count_distinct("page").alias("pages")))
    nodes = found.select("host", "page", "uid", F.posexplode("hashes").alias("n", "hash"))
    often = nodes.groupBy("host", "hash").agg(F.count_distinct("page").alias("on")).where(F.col("on") >= PAGES)
    often = often.join(sizes, "host").where(F.col("on") >= PAGE_SHARE * F.col("pages")).select("host", "hash")
    gone = nodes.join(often, ["host", "hash"], "left_semi").groupBy("uid").agg(F.collect_set("n").alias("gone"))  # at most as many as a page has subtrees
    lost = lambda t: F.coalesce(F.arrays_overlap(t["path"], F.col("gone")), F.lit(False))
    texts = F.transform("texts", lambda t: F.struct(t["key"].alias("key"), t["loose"].alias("loose"), t["running"].alias("running"), lost(t).alias("gone")))
    return found.join(gone, "uid", "left").select("src", "row_id", "page", "markup", texts.alias("texts"))


def main_paragraphs(pages: DataFrame) -> DataFrame:
    """src, row_id, para_key of each paragraph of running text.

    pages: src, row_id, host, page (what tells one page of a host from another), text, markup
    (whether text is HTML or extracted lines). Null and empty texts give no rows; a page delivered
    twice counts once for its template and is reported under each of its rows.
    """
    texts = without_templates(cut(subtrees(pages))).select("src", "row_id", "page", "markup", F.inline("texts")).withColumn("kept", F.col("running") & ~F.col("gone"))
    shown = texts.where("markup").groupBy("loose", "page").agg(F.max("kept").cast("int").alias("kept"))
    shown = shown.groupBy("loose").agg(F.sum("kept").alias("within"), (F.count("*") - F.sum("kept")).alias("without"))
    furniture = shown.where((F.col("without") >= OUTSIDE) & (F.col("without") >= OUTSIDE_TIMES * F.col("within"))).select("loose")
    kept = texts.where("kept AND markup").unionByName(texts.where("kept AND NOT markup").join(furniture, "loose", "left_anti").select(*texts.columns))
    return kept.select("src", "row_id", F.col("key").alias("para_key")).distinct()


def template_shares(pages: DataFrame) -> DataFrame:
    """src, texts, deleted (by recurring subtrees), kept (of the rest, as running text): how much of the pages each step takes."""
    held = without_templates(cut(subtrees(pages))).select("src", F.inline("texts"))
    count = lambda c: F.count(F.when(c, 1))
    return held.groupBy("src").agg(F.count("*").alias("texts"), count(F.col("gone")).alias("deleted"), count(F.col("running") & ~F.col("gone")).alias("kept"))
