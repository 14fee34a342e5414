"""Token ids of a corpus by a public byte-level tokenizer.

Texts are cut into pieces by the tokenizer's pattern. The most frequent pieces of a bounded sample of
documents are compiled with their ids into a minimal acyclic transducer, and the file is put into the
shared folder and distributed to every node, where workers map it into memory. A batch looks up each
distinct piece once; pieces the lexicon lacks are merged exactly by the ranks of the vocabulary (the
merging itself, for the lexicon too, is that of the public package that reads such rank files). Lists
are then gathered by array operations.

Null and empty texts give an empty list. The sample and the lexicon (bounded in entries and bytes)
only decide how often exact merging runs, never the ids. Every text is encoded as a whole.
"""

from __future__ import annotations

import base64
import os
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path
from .sketch import slices
from .transducer import Lexicon, compile_lexicon

TOKENIZER_DIR = os.environ.get("VAZANTE_TOKENIZERS", "/opt/tokenizers")
# The white space characters of Unicode, and the cutting pattern of the vocabulary.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECE = regex.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{_SPACE}\\p{{L}}\\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
COUNT_LIMIT = 300_000
CACHE_LIMIT = 200_000


@dataclass(frozen=True)
class Vocabulary:
    """A rank file of a public tokenizer; entries, entry_bytes: pieces that its lexicon holds at most, and bytes of
    one; sample, sample_tasks: documents whose pieces are counted for it, and partitions they are taken from."""

    name: str = "byte_bpe_50k"
    folder: str = TOKENIZER_DIR
    entries: int = 32_768
    entry_bytes: int = 64
    sample: int = 8_000
    sample_tasks: int = 64

    @property
    def path(self) -> str:
        return os.path.join(self.folder, f"{self.name}.tiktoken")


class Merger:
    """Exact ids of single pieces, by merging neighbours of least rank."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        import tiktoken

        self.core = tiktoken.Encoding("merger", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.cache: dict[str, list[int]] = {}

    def ids(self, piece: str) -> list[int]:
        known = self.cache.get(piece)
        if known is None:
            if len(self.cache) >= CACHE_LIMIT:
                self.cache.clear()
            known = self.cache[piece] = self.core.encode_ordinary(piece)
        return known


_loaded: dict[str, object] = {}


def _worker(kind: type, name: str):
    if name not in _loaded:
        _loaded[name] = kind(SparkFiles.get(name))
    return _loaded[name]


def _distribute(spark: SparkSession, data: bytes, name: str) -> str:
    """Write a file into the shared folder and hand it to every node; gives its name there."""
    path = f"{new_path(spark, 'lexicon')}/{uuid.uuid4().hex}-{name}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    for at in range(0, len(data), 1 << 20):
        stream.write(bytearray(data[at : at + (1 << 20)]))
    stream.close()
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def frequent_pieces(texts: DataFrame, vocabulary: Vocabulary) -> list[str]:
    """The most frequent pieces in a sample of the single text column: the first documents of evenly spaced partitions.

    Only those partitions are read, and only as far as needed; a task returns at most ``entries`` pieces.
    """
    rows = texts.rdd
    number = rows.getNumPartitions()
    chosen = sorted({k * number // vocabulary.sample_tasks for k in range(vocabulary.sample_tasks)}) if number else []
    each, entries, longest = -(-vocabulary.sample // max(1, len(chosen))), vocabulary.entries, vocabulary.entry_bytes

    def count(part: Iterator) -> list[tuple[str, int]]:
        held: Counter = Counter()
        for (text,) in islice(part, each):
            if text:
                held.update(PIECE.findall(text))
            if len(held) > COUNT_LIMIT:
                held = Counter(dict(held.most_common(entries)))
        return [x for x in held.most_common(entries) if len(x[0].encode()) <= longest]

    total: Counter = Counter()
    for piece, n in rows.context.runJob(rows, count, chosen) if chosen else []:
        total[piece] += n
    return [p for p, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:entries]]


def _spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Positions start..start+length-1 of each range, one after another."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())


def _encode(texts: list, lexicon: Lexicon, merger: Merger, ids: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after another (empty unless asked for), and the number of each text."""
    pieces: list[str] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text:
            found = PIECE.findall(text)
            counts[i] = len(found)
            pieces += found
    if not pieces:
        return np.zeros(0, np.int32), counts
    codes, uniques = pd.factorize(np.array(pieces, dtype=object))
    rank = lexicon.ranks([u.encode() for u in uniques])
    known = np.maximum(rank, 0)
    length = np.where(rank >= 0, lexicon.offset[np.minimum(known + 1, len(lexicon.offset) - 1)] - lexicon.offset[np.minimum(known, len(lexicon.offset) - 1)], 0)
    start = np.where(rank >= 0, lexicon.offset[np.minimum(known, len(lexicon.offset) - 1)], 0)
    unseen = np.flatnonzero(rank < 0)
    merged = [merger.ids(uniques[k]) for k in unseen]
    length[unseen] = [len(m) for m in merged]
    start[unseen] = len(lexicon.pool) + np.cumsum(length[unseen]) - length[unseen]
    each = length[codes]
    ends = np.concatenate([[0], np.cumsum(each)])[np.cumsum(counts)]
    number = np.diff(ends, prepend=0)
    if not ids:
        return np.zeros(0, np.int32), number
    pool = np.concatenate([lexicon.pool, np.array([i for m in merged for i in m], np.int64)]).astype(np.int32)
    return pool[_spread(start[codes], each)], number


def _with_lexicon(docs: DataFrame, vocabulary: Vocabulary) -> tuple[str, str]:
    spark = docs.sparkSession
    merger = Merger(vocabulary.path)
    common = frequent_pieces(docs.select(F.col("text").cast("string")), vocabulary)
    lexicon = compile_lexicon((p.encode(), merger.ids(p)) for p in common)
    with open(vocabulary.path, "rb") as ranks:
        return _distribute(spark, lexicon, "lexicon"), _distribute(spark, ranks.read(), "ranks")


def encode(docs: DataFrame, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """``id, ids`` of ``docs(id, text)``; other columns of docs are ignored."""
    lexicon_file, ranks_file = _with_lexicon(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, merger = _worker(Lexicon, lexicon_file), _worker(Merger, ranks_file)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in slices(texts):
                ids, number = _encode(texts[lo:hi], lexicon, merger, True)
                offsets = pa.array(np.concatenate([[0], np.cumsum(number)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], ["id", "ids"])

    return docs.select(F.col("id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "id long, ids array<int>")


def token_counts(docs: DataFrame, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """``id, source, tokens`` of ``docs(id, source, text)``."""
    lexicon_file, ranks_file = _with_lexicon(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, merger = _worker(Lexicon, lexicon_file), _worker(Merger, ranks_file)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for lo, hi in slices(texts):
                _, number = _encode(texts[lo:hi], lexicon, merger, False)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(number)], ["id", "source", "tokens"]
                )

    return docs.select(F.col("id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")).mapInArrow(
        run, "id long, source string, tokens long"
    )
