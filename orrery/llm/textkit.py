"""Words of texts: as Spark columns, and as numpy hashes of whole Arrow batches.

A word is a run of ASCII letters, ASCII digits and any characters beyond ASCII, with A-Z lower-cased.
The numpy side hashes every word of a batch at once: each run of bytes becomes a polynomial in an odd
base modulo 2^64, divided by the power of its first position, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; lower() does the same, faster, where all is ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The words of a text in order; null has none."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), NOT_WORD), ""), F.array().cast("array<string>"))


_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    return mix(x + np.uint64((seed * _BASE + 0x1234567) % (1 << 64)))


@lru_cache(maxsize=1)
def _powers(log2: int) -> tuple[np.ndarray, np.ndarray]:
    def of(base: int) -> np.ndarray:
        out = np.full(1 << log2, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return of(_BASE), of(_BASE_INVERSE)


def _table(fold_case: bool, punctuation: bool) -> tuple[np.ndarray, np.ndarray]:
    """Class (0 separator, 1 word, 2 punctuation) and 64-bit value of each byte."""
    byte = np.arange(256)
    is_word = (byte >= 128) | np.isin(byte, np.frombuffer((UPPER + LOWER + "0123456789").encode(), np.uint8))
    kind = is_word.astype(np.uint8)
    if punctuation:
        kind[(byte > 32) & (byte < 127) & ~is_word] = 2
    folded = np.where((byte >= 65) & (byte <= 90) & fold_case, byte + 32, byte)
    value = mix(folded.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))
    value[kind == 0] = 0
    return kind, value


WORDS = _table(fold_case=True, punctuation=False)
TOKENS = _table(fold_case=False, punctuation=True)


def slices(texts: pa.Array, budget: int = 1 << 20, most: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo to hi of a string array with their bytes and offsets, about `budget` bytes and at most `most` rows at a time; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + budget, side="right")) - 1)
        hi = min(hi, lo + most, len(texts))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def runs(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, length and class of each run of one byte class, separators included; runs end with their text."""
    of = kind[data]
    edge = np.empty(data.size, bool)
    edge[:1] = True
    np.not_equal(of[1:], of[:-1], out=edge[1:])
    edge[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    first = np.flatnonzero(edge)
    return first, np.diff(first, append=data.size), of[first]


def token_hashes(data: np.ndarray, offsets: np.ndarray, table=WORDS) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each token, and where each text's tokens begin and end in that array."""
    if not data.size:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    kind, value = table
    first, _, of = runs(data, offsets, kind)
    power, inverse = _powers(max(20, int(data.size - 1).bit_length()))
    sums = np.add.reduceat(value[data] * power[: data.size], first)
    token = of != 0
    first = first[token]
    return mix(sums[token] * inverse[first]), np.searchsorted(first, offsets)


def ngrams(tokens: np.ndarray, bounds: np.ndarray, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n consecutive tokens and the text of each; `short`: a text of fewer tokens, but not none, has one of all its tokens."""
    count = np.diff(bounds)
    text = np.repeat(np.arange(count.size), count)
    m = max(0, tokens.size - n + 1)
    gram = np.zeros(m, np.uint64)
    for j in range(n):
        gram = mix(gram + tokens[j : j + m] + np.uint64(j + 1))
    inside = text[:m] == text[n - 1 : n - 1 + m] if m else np.zeros(0, bool)
    gram, of = gram[inside], text[:m][inside]
    if short and (few := np.flatnonzero((count > 0) & (count < n))).size:
        extra = []
        for i in few:
            g = np.zeros(1, np.uint64)
            for j, h in enumerate(tokens[bounds[i] : bounds[i + 1]]):
                g = mix(g + h + np.uint64(j + 1))
            extra.append(seeded(g, int(count[i])))
        gram, of = np.concatenate([gram, *extra]), np.concatenate([of, few])
    return gram, of
