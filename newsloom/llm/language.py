"""Language of texts and of the segments in them, with confidence.

Word-first backoff: a word seen in training scores by its log frequency in each language; an unseen
word scores by the longest of its character n-grams that training saw, from N characters down to
one. A sentence takes the language with the highest sum; neighbouring sentences of one language are
one segment. Hindi in Latin letters is learnt as a class of its own and reported as hi.

The model is fitted on at most SAMPLE labelled texts, those with the lowest hashes of their keys.
Labels are partly wrong, so sentences are assigned again by the fitted model and the counts made
anew, ROUNDS times.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE, ROUNDS = 3000, 3
N = 5
#: A sentence has at least so many words; shorter ones (a credit with a year) are none.
WORDS = 4
#: Words at which the mean of all classes counts in each of them.
PRIOR = 1000.0
#: A sentence of which training saw a smaller share of the words is in none of the languages; an unseen word of whose runs of three characters at least half were seen counts half.
KNOWN = 0.25
# Names and codes of the languages.
NAMES = {
    "en": "en eng english",
    "hi": "hi hin hindi हिन्दी हिंदी",
    "ne": "ne nep npi nepali नेपाली",
    "bn": "bn ben bengali bangla বাংলা",
    "ur": "ur urd urdu اردو",
}
ABSENT = ("", "und", "unknown", "unk", "none", "null", "n/a", "na", "mul", "mis", "zxx", "?", "-", "other", "auto")
LATIN_HINDI = "hi-Latn"

_WORD = re.compile(r"[^\s\d!-/:-@\[-`{-~।॥۔،؛؟…“”‘’«»©–—​-‏﻿�]+")
_SENTENCE = re.compile(r"[^\n]*?[.।॥۔?!؟]+[\"”’'»)\]]*(?=\s|$)", re.M)
_ADDRESS = re.compile(r"\S+@\S+|https?://\S+|www\.\S+")


def label_code(label: Column) -> Column:
    """The code of a label in any spelling, null if it says nothing, else the label in lower case."""
    name = F.lower(F.trim(label))
    base = F.substring_index(F.substring_index(name, "-", 1), "_", 1)
    code = F.lit(None).cast("string")
    for lang, names in NAMES.items():
        code = F.when(base.isin(names.split()), lang).otherwise(code)
    return F.when(name.isin(*ABSENT), None).otherwise(F.coalesce(code, name))


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of each whole sentence; lines end sentences, but a line's unended rest is none."""
    return [m.span() for m in _SENTENCE.finditer(text)]


class Model:
    """Scores of words and n-grams by class."""

    def __init__(self, classes: list[str], words: dict[str, int], grams: dict[str, int], table: np.ndarray) -> None:
        self.classes, self.words, self.grams, self.table = classes, words, grams, table
        self.languages = [c.split("-")[0] for c in classes]

    @classmethod
    def count(cls, parts: list[tuple[str, list[str]]], classes: list[str]) -> Model:
        words: dict[str, Counter] = {c: Counter() for c in classes}
        for c, tokens in parts:
            words[c].update(tokens)
        grams: dict[str, Counter] = {c: Counter() for c in classes}
        for c, counts in words.items():
            for word, n in counts.items():
                for g in cls._grams(word):
                    grams[c][g] += min(n, 5)
        classes = [c for c in classes if words[c]]  # one without training words has no scores
        tables = []
        for counts, least in ((words, 2), (grams, 2)):
            total = {c: sum(counts[c].values()) for c in classes}
            names = [w for w, n in sum((counts[c] for c in classes), Counter()).items() if n >= least]
            found = np.array([[counts[c][w] for c in classes] for w in names], np.float64).reshape(len(names), len(classes))
            sizes = np.array([total[c] for c in classes], np.float64)
            # what a class hasn't seen has the mean share of all classes, at the weight of PRIOR words: a small class gains nothing by its size
            mean = (found / np.maximum(sizes, 1)).mean(axis=1, keepdims=True) if classes else found
            tables.append((names, np.log((found + PRIOR * mean) / (sizes + PRIOR)).tolist()))
        (names, scores), (pieces, rest) = tables
        table = np.array(scores + rest, np.float32).reshape(len(names) + len(pieces), len(classes))
        return cls(classes, {w: i for i, w in enumerate(names)}, {g: len(names) + i for i, g in enumerate(pieces)}, table)

    @staticmethod
    def _grams(word: str) -> Iterator[str]:
        padded = f"^{word}$"
        for n in range(1, N + 1):
            for i in range(len(padded) - n + 1):
                yield padded[i : i + n]

    def unseen(self, word: str) -> tuple[np.ndarray, float]:
        """The score of a word that training didn't see: of its longest known n-grams, at half a word's weight; and how far it is known."""
        padded = f"^{word}$"
        held = [padded[i : i + 3] in self.grams for i in range(len(padded) - 2)]
        for n in range(N, 0, -1):
            known = [at for i in range(len(padded) - n + 1) if (at := self.grams.get(padded[i : i + n])) is not None]
            if known:
                scores = self.table[known].mean(axis=0)
                return (scores - scores.max()) * 0.5, 0.5 if 2 * sum(held) >= len(held) else 0.0
        return np.zeros(len(self.classes), np.float32), 0.0

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """A model with the scores of the unseen words met so far."""

    LIMIT = 200_000

    def __init__(self, model: Model) -> None:
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.ids = dict(self.model.words)
        self.table = self.model.table[: len(self.model.words)]
        self.known = np.ones(len(self.table), np.float32)

    def scores(self, parts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """A row of scores for each list of words, and the share of its words that training saw."""
        if len(self.ids) > self.LIMIT:
            self.reset()
        ids, get, more = [], self.ids.get, []
        for words in parts:
            for w in words:
                at = get(w)
                if at is None:
                    at = self.ids[w] = len(self.table) + len(more)
                    more.append(self.model.unseen(w))
                ids.append(at)
        if more:
            self.table = np.vstack([self.table, np.array([x for x, _ in more], np.float32).reshape(len(more), -1)])
            self.known = np.append(self.known, np.array([x for _, x in more], np.float32))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        out, known = np.zeros((len(parts), len(self.model.classes)), np.float32), np.zeros(len(parts), np.float32)
        if ids:
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            full, ids = sizes > 0, np.array(ids)
            out[full] = np.add.reduceat(self.table[ids], starts[full])
            known[full] = np.add.reduceat(self.known[ids], starts[full]) / sizes[full]
        return out, known


def _tokens(text: str) -> list[str]:
    return _WORD.findall(_ADDRESS.sub(" ", text).lower() if "@" in text or "://" in text else text.lower())


def _latin(words: list[str]) -> bool:
    return sum(w.isascii() for w in words) * 2 > len(words)


def fit(labelled: list[tuple[str, str]]) -> Model:
    """A model from (code, text) pairs, some of them wrong."""
    classes = [*NAMES, LATIN_HINDI]
    parts = []
    for code, text in labelled:
        for a, b in sentences(text):
            words = _tokens(text[a:b])
            if len(words) >= WORDS and code in NAMES:
                parts.append((LATIN_HINDI if code == "hi" and _latin(words) else code, words))
    model = Model.count(parts, classes)
    for _ in range(ROUNDS):
        best = model.scorer().scores([words for _, words in parts])[0].argmax(axis=1) if parts else []
        parts = [(model.classes[k], words) for k, (_, words) in zip(best, parts)]
        model = Model.count(parts, classes)
    return model


def train(df: DataFrame, text: str, label: str, key: str, sample: int = SAMPLE) -> Model:
    """fit() on at most `sample` labelled rows of df."""
    rows = df.select(label_code(F.col(label)).alias("code"), F.col(text).alias("text"), F.xxhash64(F.col(key)).alias("h"))
    rows = rows.where(F.col("code").isin(list(NAMES)) & (F.length("text") > 0))
    last = rows.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]  # hashes first, so that tasks send no texts that aren't used
    if last is None:
        return fit([])
    rows = rows.where(F.col("h") <= last).limit(2 * sample)  # more than the sample only if a key is repeated
    return fit([(r["code"], r["text"]) for r in rows.select("code", "text").collect()])


def detect(df: DataFrame, text: str, keys: list[str], model: Model) -> DataFrame:
    """keys, language, confidence, languages, segments of each row of df.

    language: that of most letters in whole sentences, or of all words where there is no whole
    sentence; null for a null, empty or wordless text and for one in a language that training has not
    seen (less than KNOWN of its words), whose sentences count for none. confidence: 0 to 1, from the distance to the
    next language a word. languages: those with a whole sentence, sorted. segments: start, end (in
    code points), language (null: none of those in training) and confidence of each run of sentences; none without whole sentences.
    Repeated rows are judged each, long texts whole.
    """
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for n, k in zip(names, keys)], F.col(text).alias("t"))
    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    packed = df.sparkSession.sparkContext.broadcast(pickle.dumps((model.classes, model.words, model.grams, model.table)))  # bounded by the sample
    order = {lang: i for i, lang in enumerate(sorted(NAMES))}

    def sure(scores: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language of each row, and its share after a softmax of the scores a word."""
        by = np.full((len(scores), len(order)), -1e9, np.float32)
        for k, c in enumerate(model_languages):
            by[:, order[c]] = np.maximum(by[:, order[c]], scores[:, k])
        mean = (by - by.max(axis=1, keepdims=True)) / np.maximum(words, 1)[:, None]
        share = np.exp(mean * 0.5)
        return by.argmax(axis=1), 1 / share.sum(axis=1)

    model_languages = model.languages
    codes = [*sorted(NAMES), None]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Model(*pickle.loads(packed.value)).scorer()
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.iloc[at : at + 1000]
                yield judge(batch, scorer)

    def judge(batch: pd.DataFrame, scorer: Scorer) -> pd.DataFrame:
        parts, owner, spans = [], [], []
        for i, t in enumerate(batch["t"]):
            if not t:
                continue
            found = False
            for a, b in sentences(t):
                words = _tokens(t[a:b])
                if len(words) >= WORDS:
                    parts.append(words)
                    owner.append(i)
                    spans.append((a, b))
                    found = True
            if not found:
                words = _tokens(t)
                if words:
                    parts.append(words)
                    owner.append(i)
                    spans.append(None)
        scores, known = scorer.scores(parts)
        best, share = sure(scores, np.fromiter(map(len, parts), np.int64, len(parts)))
        best = np.where(known < KNOWN, len(order), best)
        held: dict[int, list] = defaultdict(list)
        for i, span, k, p in zip(owner, spans, best.tolist(), share.tolist()):
            held[i].append((span, k, p))
        out: dict[str, list] = {"language": [], "confidence": [], "languages": [], "segments": []}
        for i in range(len(batch)):
            rows = held.get(i)
            if not rows:
                values: tuple = (None, None, [], [])
            elif rows[0][0] is None:
                values = (codes[rows[0][1]], rows[0][2] if rows[0][1] < len(order) else None, [], [])
            else:
                weight: dict[int, float] = defaultdict(float)
                sum_p: dict[int, float] = defaultdict(float)
                segments: list[list] = []
                for (a, b), k, p in rows:
                    weight[k] += b - a
                    sum_p[k] += p * (b - a)
                    if segments and segments[-1][2] == k:
                        segments[-1][1] = b
                        segments[-1][3].append(p)
                    else:
                        segments.append([a, b, k, [p]])
                told = sorted(k for k in weight if k < len(order))
                top = max(told, key=weight.__getitem__, default=len(order))
                values = (
                    codes[top], sum_p[top] / weight[top] if told else None, [codes[k] for k in told],
                    [{"start": a, "end": b, "language": codes[k], "confidence": sum(p) / len(p)} for a, b, k, p in segments],
                )
            for name, x in zip(out, values):
                out[name].append(x)
        return pd.concat([batch[names].reset_index(drop=True), pd.DataFrame(out)], axis=1)

    segments = "array<struct<start: int, end: int, language: string, confidence: double>>"
    done = rows.mapInPandas(scan, f"{kinds}, language string, confidence double, languages array<string>, segments {segments}")
    return done.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "language", "confidence", "languages", "segments")
