"""Subject areas of documents, from hand labels of some of them.

The model is linear over averaged embeddings: a word is the mean of the vectors of itself and its
letter sequences (hashed), a passage the mean of its words, and every subject has a logistic output
of its own. It is trained by synchronous steps: the units lie in partitions; in every step each
partition sums the gradients of its part of the step's batch at the common parameters, and the sums
of all partitions make one step. So the result does not depend on the number of partitions but for
which units share a batch.

Training has two stages. First whole labelled documents are the units. The model then tells, within
each labelled document, which sentences speak of its labels; in the second stage these sentences are
the units, so that the outputs apply to single sentences. Last, each output gets a bound of its own,
the middle of those that serve best on the labelled documents. Every document is scored: a sentence
speaks of every subject whose output is above its bound (of none, one or several), and a document
has the subjects of at least a quarter of its sentences.

Training takes at most ``most_labelled`` labelled documents (those with the least random keys); scoring
covers all documents and all their sentences. Null and blank texts and texts of fewer than
``min_words`` words have no subject. Without any label no document has a subject. Unlabelled subjects
are never predicted; labels of unknown documents and null subjects are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from ..operators.sampling import random_key
from .sketch import slices, words_of

END = re.compile(r"(?<=[.!?…])[\"”»)']*\s+")
WORD_CACHE = 200_000
CACHED_LENGTH = 60
MOST_SHARDS = 32
BOUNDS = np.arange(-12, 13) / 8  # candidates for the outputs' bounds
_rows: dict[str, list[int]] = {}


@dataclass(frozen=True)
class SubjectSettings:
    """most_labelled: bound of the training sample; buckets, width: size of the embedding table;
    shard_units: units a partition holds at least, if there are as many cores; document_passes, sentence_passes: times
    each stage goes through its units; document_batches, sentence_batches: steps of a pass; rate, out_rate: first step
    sizes, which fall to zero; sure: least logit for a sentence to train on for its subject."""

    most_labelled: int = 3_000
    buckets: int = 1 << 15
    width: int = 16
    shard_units: int = 200
    document_passes: int = 6
    document_batches: int = 4
    sentence_passes: int = 6
    sentence_batches: int = 5
    rate: float = 0.7
    out_rate: float = 0.05
    sure: float = -1.0
    least_share: float = 0.25
    min_words: int = 20


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence. Passages without full stops are taken by lines, or by even parts."""
    out: list[list[str]] = []
    for passage in END.split(text):
        words = words_of(passage)
        if len(words) > 30:
            lines = [w for w in map(words_of, passage.splitlines()) if w]
            if len(lines) > 1 and len(words) >= 8 * len(lines):
                out += lines
                continue
        if len(words) > 45:
            parts = round(len(words) / 18)
            ends = [len(words) * k // parts for k in range(parts + 1)]
            out += [words[a:b] for a, b in zip(ends, ends[1:])]
        elif words:
            out.append(words)
    return out


def word_rows(word: str, buckets: int) -> list[int]:
    """Rows of the embedding table of a word: itself and its sequences of 3 to 5 letters."""
    known = _rows.get(word)
    if known is None:
        if len(_rows) >= WORD_CACHE:
            _rows.clear()
        marked = f"<{word}>"
        grams = {marked, *(marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1))}
        known = [zlib.crc32(g.encode()) for g in sorted(grams)]
        if len(word) <= CACHED_LENGTH:
            _rows[word] = known
    return [k % buckets for k in known]


@dataclass
class Model:
    """Embedding table, outputs, biases and the bound of each output."""

    table: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    bounds: np.ndarray

    @classmethod
    def new(cls, settings: SubjectSettings, subjects: int) -> Model:
        out = np.random.default_rng(5).normal(0, 1, (settings.width, subjects)) / np.sqrt(settings.width)
        return cls(np.zeros((settings.buckets, settings.width), np.float32), out.astype(np.float32), np.full(subjects, -2, np.float32), np.zeros(subjects))

    def gradients(self, units: list[list[str]], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the table that the units touch and the sums of their gradients, and those of outputs and biases."""
        codes, words = pd.factorize(np.array([w for u in units for w in u], dtype=object))
        size = np.array([len(u) for u in units])
        lists = [word_rows(w, len(self.table)) for w in words]
        length = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.concatenate(lists)
        vectors = np.add.reduceat(self.table[flat], np.cumsum(length) - length, axis=0) / length[:, None].astype(np.float32)
        hidden = np.add.reduceat(vectors[codes], np.cumsum(size) - size, axis=0) / size[:, None].astype(np.float32)
        error = 1 / (1 + np.exp(-(hidden @ self.out + self.bias))) - wanted
        back = (error @ self.out.T) / size[:, None]
        by_word = _summed(codes, np.repeat(np.arange(len(units)), size), back)[1] / length[:, None]
        rows, by_row = _summed(flat, np.repeat(np.arange(len(words)), length), by_word)
        return rows, by_row.astype(np.float32), (hidden.T @ error).astype(np.float32), error.sum(0).astype(np.float32)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """What each word adds to the logits, before averaging."""
        lists = [word_rows(w, len(self.table)) for w in words]
        length = np.fromiter(map(len, lists), np.int64, len(lists))
        sums = np.add.reduceat(self.table[np.concatenate(lists)], np.cumsum(length) - length, axis=0)
        return (sums / length[:, None].astype(np.float32)) @ self.out


def _summed(keys: np.ndarray, source: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and, for each, the sum of ``values[source]`` of its places."""
    order = np.argsort(keys, kind="stable")
    there = keys[order]
    starts = np.flatnonzero(np.diff(there, prepend=-1))
    return there[starts], np.add.reduceat(values[source[order]], starts, axis=0)


class Moments:
    """Steps by running means of gradients and of their squares (one a row of the table), of falling size."""

    def __init__(self, model: Model, settings: SubjectSettings, steps: int) -> None:
        self.model, self.settings, self.steps, self.done = model, settings, steps, 0
        arrays = (model.table, model.out, model.bias)
        self.mean = [np.zeros_like(a) for a in arrays]
        self.square = [np.zeros((len(model.table), 1), np.float32), *(np.zeros_like(a) for a in arrays[1:])]

    def step(self, gradients: list[np.ndarray]) -> None:
        keep, keep_square = 0.9, 0.98
        size = 1 - self.done / self.steps
        self.done += 1
        for k, (value, g) in enumerate(zip((self.model.table, self.model.out, self.model.bias), gradients)):
            square = (g**2).mean(1, keepdims=True) if k == 0 else g**2
            self.mean[k] = keep * self.mean[k] + (1 - keep) * g
            self.square[k] = keep_square * self.square[k] + (1 - keep_square) * square
            root = np.sqrt(self.square[k] / (1 - keep_square**self.done)) + 1e-8
            rate = size * (self.settings.out_rate if k else self.settings.rate) / (1 - keep**self.done)
            value -= (rate * self.mean[k] / root).astype(np.float32)


def _train(units: DataFrame, model: Model, settings: SubjectSettings, passes: int, batches: int) -> Model:
    """Synchronous steps over ``units(words array<string>, targets array<float>)``, which are partitioned once."""
    spark = units.sparkSession
    held = cut(units.filter("size(words) > 0"), "units")
    shards = max(1, min(MOST_SHARDS, spark.sparkContext.defaultParallelism, held.count() // settings.shard_units))
    batch = F.pmod(F.xxhash64("words"), F.lit(batches)).cast("int")
    spread = cut(held.withColumn("batch", batch).repartition(shards, F.xxhash64("words", F.lit(1))), "shards").persist()  # bounded; what is lost is read again
    moments = Moments(model, settings, passes * batches)
    for k in range(passes * batches):
        sent = spark.sparkContext.broadcast(model)

        def run(rows: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            words: list = []
            wanted: list = []
            for some in rows:
                words += some.column(0).to_pylist()
                wanted += some.column(1).to_pylist()
            if words:
                place, *sums = sent.value.gradients(words, np.array(wanted, np.float32))
                data = [pa.array([x.tobytes()], pa.binary()) for x in (place.astype(np.int32), *sums)]
                yield pa.RecordBatch.from_arrays([pa.array([len(words)]), *data], ["units", "place", "rows", "out", "bias"])

        parts = spread.filter(F.col("batch") == k % batches).select("words", "targets").mapInArrow(run, "units long, place binary, rows binary, out binary, bias binary").collect()
        total = sum(p["units"] for p in parts)
        sums = [np.zeros_like(a) for a in (model.table, model.out, model.bias)]
        for p in parts:
            sums[0][np.frombuffer(p["place"], np.int32)] += np.frombuffer(p["rows"], np.float32).reshape(-1, settings.width)
            sums[1] += np.frombuffer(p["out"], np.float32).reshape(model.out.shape)
            sums[2] += np.frombuffer(p["bias"], np.float32)
        if total:
            moments.step([x / np.float32(total) for x in sums])
        sent.unpersist()
    spread.unpersist()
    return model


def _with_bounds(sample: DataFrame, model: Model, subjects: list[str], settings: SubjectSettings) -> Model:
    """The model with the bound of each output that gives the best F1 on the labelled documents (of several in a row
    that do, the middle one)."""
    sent = sample.sparkSession.sparkContext.broadcast(model)
    shape = (3, len(subjects), len(BOUNDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(shape, np.int64)
        for batch in batches:
            for text, names in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                parts = sentences(text)
                if sum(map(len, parts)) < settings.min_words:
                    continue
                logits = np.array([sent.value.word_scores(w).mean(0) + sent.value.bias for w in parts])
                said = (logits[:, :, None] > BOUNDS).sum(0) >= len(parts) * settings.least_share
                true = np.isin(subjects, names)[:, None]
                counts += np.stack([said & true, said & ~true, ~said & true])
        yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()], pa.binary())], ["counts"])

    tp, fp, fn = sum(np.frombuffer(r[0], np.int64).reshape(shape) for r in sample.mapInArrow(run, "counts binary").collect())
    score = 2 * tp / np.maximum(2 * tp + fp + fn, 1)
    for k, row in enumerate(score):
        best = np.flatnonzero(row >= row.max() - 1e-12)
        runs = np.split(best, np.flatnonzero(np.diff(best) > 1) + 1)
        longest = max(runs, key=lambda r: (len(r), -abs(BOUNDS[r].mean())))
        model.bounds[k] = BOUNDS[longest].mean() if row.max() > 0 else 0.0
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, settings: SubjectSettings) -> tuple[DataFrame, list[str]]:
    """``text, subjects`` of at most ``most_labelled`` labelled documents, and all subjects in order."""
    known = labels.filter("id is not null and subject is not null").select(F.col("id").cast("long"), "subject")
    subjects = [r[0] for r in known.select("subject").distinct().orderBy("subject").limit(10_001).collect()]
    if len(subjects) > 10_000:
        raise ValueError("more than 10000 subjects")
    each = known.groupBy("id").agg(F.collect_set("subject").alias("subjects"))
    some = each.orderBy(random_key(F.col("id"), "subjects"), "id").limit(settings.most_labelled)
    return docs.join(F.broadcast(some), "id").filter("text is not null").select("id", "text", "subjects"), subjects


def train(docs: DataFrame, labels: DataFrame, settings: SubjectSettings = SubjectSettings()) -> tuple[Model, list[str]]:
    """A model of the subjects in ``labels(id, subject)`` of ``docs(id, text)``."""
    sample, subjects = labelled_sample(docs, labels, settings)
    sample = cut(sample, "labelled")
    place = {s: k for k, s in enumerate(subjects)}
    unit = "words array<string>, targets array<float>"

    def vector(names: list[str]) -> list[float]:
        out = [0.0] * len(place)
        for name in names:
            out[place[name]] = 1.0
        return out

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        words, wanted = zip(*rows) if rows else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.string())), pa.array(wanted, pa.list_(pa.float32()))], ["words", "targets"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = ((words_of(t), vector(s)) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            yield batch_of([r for r in rows if len(r[0]) >= settings.min_words])

    model = Model.new(settings, len(subjects))
    if not subjects:
        return model, subjects
    model = _train(sample.mapInArrow(whole, unit), model, settings, settings.document_passes, settings.document_batches)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def spoken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, names in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = {place[n] for n in names}
                parts = sentences(text)
                if sum(map(len, parts)) < settings.min_words:
                    continue
                for words in parts:
                    logits = sent.value.word_scores(words).mean(0) + sent.value.bias
                    best = int(logits.argmax())
                    if best in own and logits[best] > settings.sure:
                        rows.append((words, vector([subjects[best]])))
                    elif logits[best] <= 0:
                        rows.append((words, vector([])))
            yield batch_of(rows)

    units = sample.mapInArrow(spoken, unit)
    model = _train(units, Model.new(settings, len(subjects)), settings, settings.sentence_passes, settings.sentence_batches)
    return _with_bounds(sample, model, subjects, settings), subjects


def score(docs: DataFrame, model: Model, subjects: list[str], settings: SubjectSettings = SubjectSettings()) -> DataFrame:
    """``id, subject, sentences, of_sentences`` for every subject that a sentence of a document speaks of."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    shape = "id long, subject string, sentences long, of_sentences long"
    names = np.array(subjects, dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        table = np.zeros((0, len(subjects)), np.float32)
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for lo, hi in slices(texts):
                flat: list[str] = []
                sizes: list[int] = []
                owner: list[int] = []
                for k in range(lo, hi):
                    parts = sentences(texts[k]) if texts[k] else []
                    if sum(map(len, parts)) < settings.min_words:
                        continue
                    for words in parts:
                        flat += words
                        sizes.append(len(words))
                    owner += [k] * len(parts)
                if not flat:
                    continue
                if len(known) > WORD_CACHE:
                    known, table = {}, table[:0]
                codes, words = pd.factorize(np.array(flat, dtype=object))
                fresh = [w for w in words if w not in known]
                if fresh:
                    known.update(zip(fresh, range(len(known), len(known) + len(fresh))))
                    table = np.concatenate([table, sent.value.word_scores(fresh)])
                scores = table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]
                size = np.array(sizes)
                logits = np.add.reduceat(scores[codes], np.cumsum(size) - size, axis=0) / size[:, None] + sent.value.bias
                said, about = np.nonzero(logits > sent.value.bounds)
                doc = np.array(owner)
                total = np.bincount(doc - lo, minlength=hi - lo)
                key, number = np.unique(doc[said] * len(subjects) + about, return_counts=True)
                row, subject = key // len(subjects), key % len(subjects)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row]), pa.array(names[subject], pa.string()), pa.array(number), pa.array(total[row - lo])],
                    ["id", "subject", "sentences", "of_sentences"],
                )

    if not subjects:
        return docs.sparkSession.createDataFrame([], shape)
    return docs.select(F.col("id").cast("long"), F.col("text").cast("string")).mapInArrow(run, shape)


def subjects_of(docs: DataFrame, labels: DataFrame, settings: SubjectSettings = SubjectSettings()) -> DataFrame:
    """``id, subject`` of every subject that at least the least share of a document's sentences speak of."""
    scored = score(docs, *train(docs, labels, settings), settings)
    return scored.filter(F.col("sentences") >= F.col("of_sentences") * settings.least_share).select("id", "subject")
