"""Phrases of a lexicon found in texts.

A lexicon is a table of label, phrase and weight; it is the caller's parameter and is compiled once
a worker: one automaton of all phrases tells which occur in a text at all, and only those are matched at word limits. Longer phrases are looked for first and take their span, so a phrase inside another one
doesn't count twice. A hit in the title counts twice, in the body once, whatever its frequency.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.session import counted

_MOST = 100_000


def compile_phrase(phrase: str) -> re.Pattern:
    """Latin phrases match at word limits, letters of any case; others match as they are."""
    if phrase.isascii():
        return re.compile(r"(?<!\w)" + re.escape(phrase) + r"(?!\w)", re.I)
    return re.compile(re.escape(phrase))


class Finder:
    """Which of many phrases may occur in a text, in one pass over it."""

    def __init__(self, phrases: list[str]) -> None:
        self.phrases = phrases
        try:
            import ahocorasick
        except ImportError:  # then each phrase is looked for
            self.automaton = None
            return
        self.automaton = ahocorasick.Automaton()
        for i, phrase in enumerate(phrases):
            key = phrase.lower()
            self.automaton.add_word(key, (*self.automaton.get(key, ()), i))
        if phrases:
            self.automaton.make_automaton()

    def within(self, *texts: str | None) -> set[int]:
        """Numbers of the phrases that occur, letter case aside."""
        lower = [t.lower() for t in texts if t]
        if self.automaton is None:
            return {i for i, p in enumerate(self.phrases) if any(p.lower() in t for t in lower)}
        return {i for t in lower for _, held in (self.automaton.iter(t) if self.phrases else ()) for i in held}


def score(title: str, body: str, phrases: list[tuple[str, re.Pattern, float]]) -> float:
    """phrases: (phrase, pattern, weight), longest first."""
    total = 0.0
    for part, times in ((title or "", 2), (body or "", 1)):
        taken: list[tuple[int, int]] = []
        for _, pattern, weight in phrases:
            free = [m.span() for m in pattern.finditer(part) if not any(m.start() < b and a < m.end() for a, b in taken)]
            if free:
                total += weight * times
                taken += free
    return total


def label(df: DataFrame, lexicon: DataFrame, title: str, body: str, key: str, least: float) -> DataFrame:
    """key, label, score, confidence: the label with the highest score, the first in order of several; null below `least`.

    confidence: high from twice the next label's score and twice `least`, medium from 1.25 times, else low.
    """
    rows = [(r["label"], r["phrase"], float(r["weight"])) for r in lexicon.select("label", "phrase", "weight").limit(_MOST + 1).collect()]
    if len(rows) > _MOST:
        raise ValueError(f"a lexicon has at most {_MOST} phrases")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ordered = [(name, phrase, compile_phrase(phrase), weight) for name, phrase, weight in sorted(rows, key=lambda r: (-len(r[1]), r[1])) if phrase]
        finder, names = Finder([phrase for _, phrase, _, _ in ordered]), dict.fromkeys(name for name, _, _, _ in ordered)
        for batch in batches:
            out = []
            for t, b in zip(batch["title"], batch["body"]):
                by: dict[str, list] = {name: [] for name in names}
                for i in sorted(finder.within(t, b)):
                    by[ordered[i][0]].append(ordered[i][1:])
                ranked = sorted(((-score(t, b, phrases), name) for name, phrases in by.items()), key=lambda r: (r[0], r[1]))
                best, name = (-ranked[0][0], ranked[0][1]) if ranked else (0.0, None)
                second = -ranked[1][0] if len(ranked) > 1 else 0.0
                ratio = best / second if second else float("inf")
                if best < least:
                    out.append((None, best, "low"))
                else:
                    out.append((name, best, "high" if ratio >= 2 and best >= 2 * least else "medium" if ratio >= 1.25 else "low"))
            new = pd.DataFrame(out, columns=["label", "score", "confidence"])
            new.insert(0, "key", batch["key"].to_numpy())
            yield new

    held = df.select(F.col(key).alias("key"), F.col(title).alias("title"), F.col(body).alias("body"))
    done = held.mapInPandas(scan, f"key {held.schema['key'].dataType.simpleString()}, label string, score double, confidence string")
    return done.withColumnRenamed("key", key)


def mentions(df: DataFrame, names: DataFrame, key: str, text: str) -> DataFrame:
    """key, entity: each name of a dictionary (entity, name) that a text holds at word limits.

    Names and texts are cut into the same word runs, so this is an equality join of runs of up to
    the longest name's words, not a comparison of each name with each text. The names are broadcast
    by their count, never by an estimate; then no run is shuffled that is no name.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{M}\p{N}]+)"), 1)
    surfaces = names.select("entity", words(F.col("name")).alias("w")).where(F.size("w") > 0)
    surfaces = counted(surfaces.select("entity", F.array_join("w", " ").alias("surface"), F.size("w").alias("n")).distinct())
    sizes = sorted(r[0] for r in surfaces.select("n").distinct().collect())  # lengths of names in words
    texts = df.select(F.col(key).alias("k"), words(F.col(text)).alias("w"))

    def of(n: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))

    # one expression for all lengths, so the plan is as long for any dictionary
    fit = F.filter(F.array(*map(F.lit, sizes)).cast("array<int>"), lambda n: n <= F.size("w"))
    found = texts.select("k", F.explode(F.array_distinct(F.flatten(F.transform(fit, of)))).alias("surface")).join(surfaces.drop("n"), "surface")
    return found.select(F.col("k").alias(key), "entity").distinct()
