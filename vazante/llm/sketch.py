"""Vectorised text sketches shared by the similarity operators.

Words are maximal runs of letters and numbers of the lower-cased text. Everything
below works on whole Arrow batches: words are hashed once per distinct spelling and
shingles, class keys and MinHash coordinates are NumPy reductions over flat arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd

# letters and numbers in the Unicode sense: what \w holds besides the underscore
WORD = re.compile(r"[^\W_]+")
COORDS = 128
MARKED = 64  # coordinates that the packed bits and nibbles show
SLICE_CHARS = 4_000_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (splitmix64) so that all bits depend on all bits."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def slices(texts: list) -> Iterator[tuple[int, int]]:
    """Row ranges of about SLICE_CHARS characters, so that long texts don't pile up in memory."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= SLICE_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Flat 64-bit hashes of all words and the number of words of each text (null: none)."""
    flat: list[str] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text:
            words = words_of(text)
            counts[i] = len(words)
            flat += words
    if not flat:
        return np.zeros(0, np.uint64), counts
    codes, uniques = pd.factorize(np.array(flat, dtype=object))
    return mix(pd.util.hash_array(np.asarray(uniques, dtype=object), categorize=False))[codes], counts


def class_keys(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit keys of each word sequence; every count must be positive."""
    starts = np.cumsum(counts) - counts
    place = np.arange(len(hashes), dtype=np.uint64) - np.repeat(starts, counts).astype(np.uint64)
    with np.errstate(over="ignore"):
        one = mix(hashes + place * _GOLD)
        two = mix(hashes ^ (place * _M1 + _M2))
        return mix(np.add.reduceat(one, starts)), mix(np.add.reduceat(two, starts))


def shingle_hashes(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside each text and their number by text."""
    number = np.maximum(counts - (width - 1), 0)
    starts = np.cumsum(counts) - counts
    first = np.repeat(starts - (np.cumsum(number) - number), number) + np.arange(number.sum())
    with np.errstate(over="ignore"):
        out = np.zeros(len(first), np.uint64)
        for k in range(width):
            out = mix(out * _GOLD + hashes[first + k] + np.uint64(k + 1))
    return out, number


def minhash(shingles: np.ndarray, number: np.ndarray, coords: int = COORDS, seed: int = 11) -> np.ndarray:
    """MinHash coordinates of each text, reduced to 16 bits; every number must be positive."""
    out = np.empty((len(number), coords), np.uint16)
    ends = np.cumsum(number)
    factors = mix(np.arange(1, coords + 1, dtype=np.uint64) * _GOLD + np.uint64(seed)) | np.uint64(1)
    row = 0
    while row < len(number):  # blocks that stay in the processor's cache
        base = ends[row] - number[row]
        last = max(row + 1, int(np.searchsorted(ends, base + 32_768, "right")))
        block, starts = shingles[base : ends[last - 1]], ends[row:last] - number[row:last] - base
        for k in range(coords):
            with np.errstate(over="ignore"):
                low = np.minimum.reduceat(block * factors[k], starts)
            out[row:last, k] = (mix(low) >> np.uint64(20)).astype(np.uint16)
        row = last
    return out


def bits(sig: np.ndarray) -> np.ndarray:
    """One bit of each of 64 coordinates, packed into a 64-bit integer."""
    return np.packbits((sig[:, :MARKED] & 1).astype(np.uint8), axis=1).view(">u8").ravel().astype(np.uint64)


def nibbles(sig: np.ndarray) -> np.ndarray:
    """Four bits of each of 64 coordinates, packed into four 64-bit integers a row."""
    low = (sig[:, :MARKED] & 15).astype(np.uint8)
    return ((low[:, 0::2] << 4) | low[:, 1::2]).copy().view(">u8").astype(np.uint64)


def shingle_set(text: str, width: int) -> set[tuple[str, ...]]:
    """The distinct runs of ``width`` words of a text, as the words themselves."""
    words = words_of(text)
    return set(zip(*(words[k:] for k in range(width))))


def jaccard(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 0.0
