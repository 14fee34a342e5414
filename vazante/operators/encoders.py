"""Vectors of texts by an outside encoder, and classifiers on top of them.

An encoder is made once in each task by a function without arguments and turns a list of texts into an array with one
row a text. Any network with such an interface fits; the one here projects hashed words and needs no file.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import plain_text
from .models import WORD, entry_text

Encoder = Callable[[list[str]], np.ndarray]


@dataclass(frozen=True)
class HashedWords:
    """Mean of a fixed random direction for each word, scaled to unit length; a text without words has all zeros."""

    width: int = 64
    seed: int = 2026

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width), np.float32)
        known: dict[str, np.ndarray] = {}
        for k, text in enumerate(texts):
            for word in WORD.findall(plain_text(text)):
                if word not in known:
                    known[word] = np.random.default_rng([self.seed, zlib.crc32(word.encode())]).normal(size=self.width)
                out[k] += known[word]
            out[k] /= np.linalg.norm(out[k]) or 1
        return out


def embed(docs: DataFrame, make: Callable[[], Encoder] = HashedWords, keep: Sequence[str] = ("link", "day"), batch: int = 64, words: int | None = None) -> DataFrame:
    """``keep, embedding array<float>`` of ``docs([title,] text)``, ``batch`` texts at a time (at most the first ``words``
    words of each, for encoders of bounded input). Null texts are encoded as empty ones."""
    shape = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", embedding array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                some = rows.slice(at, batch)
                texts = some.column(0).to_pylist()
                vectors = encoder([" ".join(t.split()[:words]) for t in texts] if words else texts)
                data = pa.array(list(np.asarray(vectors, np.float32)), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*(some.column(k + 1) for k in range(len(keep))), data], [*keep, "embedding"])

    return docs.select(entry_text(docs).alias("__entry"), *keep).mapInArrow(run, shape)


def as_features(vectors: DataFrame, keep: Sequence[str], width: int) -> DataFrame:
    """``keep, indices, data`` of ``embedding``, as the linear classifiers take them."""
    every = F.array(*(F.lit(k) for k in range(width)))
    return vectors.select(*keep, every.alias("indices"), F.col("embedding").alias("data"))
