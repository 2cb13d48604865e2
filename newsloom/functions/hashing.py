"""Sketches of texts, vectorised over Arrow batches.

The parameters of the minimum hash come from a linear congruential generator over the prime
2**61 - 1; a shingle's hash is its SHA-256 modulo that prime.
"""

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRIME = (1 << 61) - 1
_MULTIPLIER, _INCREMENT = 6364136223846793005, 1442695040888963407


@lru_cache(maxsize=4)
def parameters(count: int = 128, seed: int = 42) -> tuple[tuple[int, int], ...]:
    state, out = seed, []
    for _ in range(count):
        state = (state * _MULTIPLIER + _INCREMENT) % PRIME
        a = state % (PRIME - 1) + 1
        state = (state * _MULTIPLIER + _INCREMENT) % PRIME
        out.append((a, state))
    return tuple(out)


@lru_cache(maxsize=4)
def _arrays(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = zip(*parameters(count, seed))
    return np.array(a, np.uint64)[:, None], np.array(b, np.uint64)[:, None]


@lru_cache(maxsize=200_000)
def item_hash(item: str) -> int:
    return int.from_bytes(hashlib.sha256(item.encode()).digest()) % PRIME


def _multiply_add(a: np.ndarray, h: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(a * h + b) modulo 2**61 - 1 in 64 bits: factors are split at 31 bits, and 2**61 is 1."""
    low, half, prime = np.uint64((1 << 31) - 1), np.uint64(31), np.uint64(PRIME)
    a1, a0, h1, h0 = a >> half, a & low, h >> half, h & low
    middle = a1 * h0 + a0 * h1
    x = np.uint64(2) * (a1 * h1) + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << half) + a0 * h0 + b
    x = (x & prime) + (x >> np.uint64(61))
    return np.where(x >= prime, x - prime, x)


def signature(items: list[str], count: int = 128, seed: int = 42) -> list[int]:
    """Minimum of (a * h + b) modulo PRIME for each pair of parameters; all PRIME for no items."""
    if not items:
        return [PRIME] * count
    a, b = _arrays(count, seed)
    hashes = np.array([item_hash(x) for x in set(items)], np.uint64)[None]
    return _multiply_add(a, hashes, b).min(axis=1).astype(np.int64).tolist()


@F.pandas_udf(T.ArrayType(T.LongType()))
def minhash(items: pd.Series) -> pd.Series:
    return items.map(lambda x: signature([] if x is None else list(x)))


@F.pandas_udf(T.LongType())
def simhash(words: pd.Series) -> pd.Series:
    """64 bits, each set if the words' SHA-256 bits, weighted by frequency, sum above 0; as a signed number."""

    def one(items: list[str] | None) -> int:
        if items is None or not len(items):
            return 0
        held, counts = np.unique(np.asarray(items, object).astype(str), return_counts=True)
        digests = np.frombuffer(b"".join(hashlib.sha256(w.encode()).digest()[24:] for w in held.tolist()), np.uint8).reshape(-1, 8)
        ones = counts @ np.unpackbits(digests, axis=1).astype(np.int64)
        return int(np.packbits(2 * ones > counts.sum()).view(">i8")[0])

    return words.map(one)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def agreement(a: Column, b: Column) -> Column:
    """Share of equal positions of two signatures."""
    return F.size(F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: x["a"] == x["b"])) / F.size(a)


def bands(sig: Column, rows: int = 2) -> Column:
    """A hash of each band of a signature."""
    return F.transform(F.sequence(F.lit(1), F.size(sig), F.lit(rows)), lambda i: F.xxhash64(i, F.slice(sig, i, rows)))


@F.pandas_udf(T.DoubleType())
def word_cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    """Cosine of the word counts of two word lists, to three places; 0 if one is empty. In proportion to the words, where text.term_cosine grows with their square."""

    def one(x, y) -> float:
        if x is None or y is None or not len(x) or not len(y):
            return 0.0
        (u, m), (v, n) = (np.unique(np.asarray(w, object).astype(str), return_counts=True) for w in (x, y))
        _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
        return round(float((m[i] * n[j]).sum() / np.sqrt(float((m * m).sum()) * float((n * n).sum()))), 3)

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")
