"""Text classifiers, their grid search on a fixed split, and hooks for outside models.

Features are words and word pairs: counted by logarithm, weighed by the inverse of their document frequency and
scaled to unit length. Both families are trained one against the rest, so every class has a score: probabilities
for logistic regression, margins for the linear support vector machine.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_class, first_words, plain_text, rendered, title_and_text
from ..session import cut
from . import linear

WORD = re.compile(r"\w\w+")
TABLE_LIMIT = 400_000
WHOLE = 24_000_000  # entries of a fold that a task may hold, some 40 bytes each


@dataclass(frozen=True)
class Config:
    """family ``logreg`` or ``svm``; c: inverse of the regularisation; balanced: weigh classes by their rarity."""

    family: str = "logreg"
    c: float = 1.0
    balanced: bool = False
    vocabulary: int = 100_000
    min_df: int = 5
    iterations: int = 30


GRID = tuple((c, balanced) for c in (0.1, 1.0, 10.0) for balanced in (False, True))
MOST_CLASSES = 1_000


def entry_text(docs: DataFrame) -> Column:
    """What a classifier reads of a document: title and text, or the text alone; never null."""
    return title_and_text(F.col("title"), F.col("text")) if "title" in docs.columns else F.coalesce("text", F.lit(""))


def terms_of(text: str) -> list[str]:
    """Words of at least two letters or numbers, without accents, and pairs of neighbours."""
    words = WORD.findall(plain_text(text))
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


@dataclass(frozen=True)
class Features:
    """Terms in order of their column, and their weights."""

    terms: list[str]
    weights: np.ndarray

    def of(self, docs: DataFrame, keep: Sequence[str]) -> DataFrame:
        """``keep``, ``indices array<int>, data array<float>`` of ``docs``: a vector of unit length, or empty."""
        sent = docs.sparkSession.sparkContext.broadcast(({t: k for k, t in enumerate(self.terms)}, self.weights))
        shape = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place, weights = sent.value
            for batch in batches:
                vectors = []
                for text in batch.column(0).to_pylist():
                    counts = Counter(filter(None.__ne__, map(place.get, terms_of(text))))
                    index = np.array(sorted(counts), np.int32)
                    data = (1 + np.log([counts[k] for k in index.tolist()])) * weights[index] if len(index) else np.zeros(0)
                    vectors.append((index, (data / (np.sqrt((data**2).sum()) or 1)).astype(np.float32)))
                columns = [pa.array([v[k] for v in vectors], pa.list_(t)) for k, t in enumerate((pa.int32(), pa.float32()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(k + 1) for k in range(len(keep))), *columns], [*keep, "indices", "data"])

        return docs.select(entry_text(docs).alias("__entry"), *keep).mapInArrow(run, (shape + ", " if keep else "") + "indices array<int>, data array<float>")


def fit_features(docs: DataFrame, config: Config = Config()) -> Features:
    """The ``vocabulary`` most frequent terms (ties alphabetically) of at least ``min_df`` documents ``docs([title,] text)``."""
    return fit_parts(docs.withColumn("parts", F.lit(1)), 1, config)[0]


def fit_parts(docs: DataFrame, number: int, config: Config = Config()) -> list[Features]:
    """The features of several parts of ``docs([title,] text, parts int)``, each text read once: a document is in part k
    if bit k of ``parts`` is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, where, documents = defaultdict(Counter), defaultdict(Counter), Counter()

        def given() -> pa.RecordBatch:
            columns = [
                pa.array([*documents, *(parts for parts, own in total.items() for _ in own)], pa.int32()), pa.array([*(None for _ in documents), *(t for own in total.values() for t in own)], pa.string()),
                pa.array([*(0 for _ in documents), *(n for own in total.values() for n in own.values())], pa.int64()),
                pa.array([*documents.values(), *(where[parts][t] for parts, own in total.items() for t in own)], pa.int64()),
            ]
            for table in (total, where, documents):
                table.clear()
            return pa.RecordBatch.from_arrays(columns, ["parts", "term", "n", "df"])

        for batch in batches:
            for text, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                terms = terms_of(text)
                documents[parts] += 1
                total[parts].update(terms)
                where[parts].update(set(terms))
                if sum(map(len, total.values())) > TABLE_LIMIT:
                    yield given()
        yield given()

    counts = docs.select(entry_text(docs), "parts").mapInArrow(run, "parts int, term string, n long, df long").groupBy("parts", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    counts = cut(counts, "vocabulary")
    out = []
    for k in range(number):
        own = counts.filter(F.col("parts").bitwiseAND(1 << k) != 0).groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
        documents = own.filter("term is null").agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
        kept = own.filter(F.col("term").isNotNull() & (F.col("df") >= config.min_df)).orderBy(F.desc("n"), "term").limit(config.vocabulary).collect()
        out.append(Features([r["term"] for r in kept], 1 + np.log((1 + documents) / (1 + np.array([r["df"] for r in kept], float)))))
    return out


def counted_terms(docs: DataFrame, terms: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``keep, places array<int>, counts array<int>`` of ``docs``: which of ``terms`` a document has, and how often."""
    sent = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(terms)})
    shape = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = sent.value
        for batch in batches:
            places, counts, ends = array("i"), array("i"), array("i", [0])
            for text in batch.column(0).to_pylist():
                found = Counter(map(place.get, terms_of(text)))
                found.pop(None, None)
                places.extend(found)
                counts.extend(found.values())
                ends.append(len(places))
            columns = [pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32)), pa.array(np.frombuffer(v, np.int32))) for v in (places, counts)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k + 1) for k in range(len(keep))), *columns], [*keep, "places", "counts"])

    return docs.select(entry_text(docs).alias("__entry"), *keep).mapInArrow(run, shape + ", places array<int>, counts array<int>")


def _places(terms: Sequence[str], features: Features) -> np.ndarray:
    """The column of each of ``terms``, -1 if it has none."""
    known = {t: k for k, t in enumerate(features.terms)}
    return np.array([known.get(t, -1) for t in terms], np.int32)


def _vectors(batch: pa.RecordBatch, column: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, indices and weights of the vectors of a batch that begins with places and counts; ``column`` is each place's or -1."""
    n = batch.num_rows
    row = np.repeat(np.arange(n), np.diff(batch.column(0).offsets.to_numpy()))
    index = column[batch.column(0).flatten().to_numpy(zero_copy_only=False)]
    there = index >= 0
    row, index = row[there], index[there]
    data = (1 + np.log(batch.column(1).flatten().to_numpy(zero_copy_only=False)[there])) * weights[index]
    data /= np.sqrt(np.bincount(row, data**2, n))[row]
    return np.bincount(row, minlength=n), index, data.astype(np.float32)


def weighed(counted: DataFrame, terms: Sequence[str], features: Features, keep: Sequence[str]) -> DataFrame:
    """The columns of :meth:`Features.of` from those of :func:`counted_terms`, whose terms hold all of the features'."""
    sent = counted.sparkSession.sparkContext.broadcast((_places(terms, features), features.weights))
    shape = ", ".join(f"`{c}` {counted.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column, weights = sent.value
        for batch in batches:
            sizes, *vectors = _vectors(batch, column, weights)
            offsets = pa.array(np.cumsum([0, *sizes]), pa.int32())
            columns = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in vectors]
            yield pa.RecordBatch.from_arrays([*(batch.column(k + 2) for k in range(len(keep))), *columns], [*keep, "indices", "data"])

    return counted.select("places", "counts", *keep).mapInArrow(run, shape + ", indices array<int>, data array<float>")


@dataclass(frozen=True)
class Classifier:
    """Features (None if rows come with theirs), classes in the order of the scores, and weights of each."""

    features: Features | None
    weights: np.ndarray
    classes: list[str]
    family: str

    def predict(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``y_pred`` and a map ``scores`` of every class."""
        return self.scored(self.features.of(docs, docs.columns), docs.columns)

    def scored(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        """The same from rows that have their vector; logistic margins become shares that add up to 1."""
        sent = rows.sparkSession.sparkContext.broadcast(self.weights.astype(np.float32))
        names, logistic = np.array(self.classes, dtype=object), self.family == "logreg"
        shape = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns) + ", y_pred string, margins array<double>"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                parts = [linear.margins(row, index, data, at.stop - at.start, sent.value) for at, row, index, data in linear.slices(batch, 0)]
                m = np.concatenate(parts).astype(float)
                m = np.concatenate([-m, m], axis=1) if m.shape[1] < len(names) else m
                best = names[m.argmax(1)]
                if logistic:
                    m = 1 / (1 + np.exp(-m))
                    m /= m.sum(1, keepdims=True)
                yield pa.RecordBatch.from_arrays([*(batch.column(k + 2) for k in range(len(columns))), pa.array(best, pa.string()), pa.array(list(m))], [*columns, "y_pred", "margins"])

        out = rows.select("indices", "data", *columns).mapInArrow(run, shape)
        return out.select(*columns, "y_pred", F.map_from_arrays(F.array(*map(F.lit, self.classes)), F.col("margins")).alias("scores"))


def _labelled(rows: DataFrame) -> tuple[DataFrame, list[str], list[int]]:
    """``label, indices, data`` of rows with ``y``, the classes in order and their sizes."""
    sizes = rows.groupBy("y").agg(F.count("*").alias("n")).orderBy("y").limit(MOST_CLASSES + 1).collect()
    classes = [r["y"] for r in sizes]
    _checked(classes)
    label = F.array_position(F.array(*map(F.lit, classes)), F.col("y")).cast("int") - 1
    return rows.select(label.alias("label"), "indices", "data"), classes, [r["n"] for r in sizes]


def _checked(classes: Sequence[str]) -> None:
    if len(classes) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    if len(classes) < 2:
        raise ValueError("fewer than two classes")


def _problems(sizes: list[int], config: Config) -> list[linear.Problem]:
    """One a class, or one in all (the second against the first) of two classes."""
    total = sum(sizes)
    weight = [total / (len(sizes) * n) if config.balanced else 1.0 for n in sizes]
    loss = {"logreg": "log", "svm": "hinge"}[config.family]
    if len(sizes) == 2:
        return [linear.Problem(loss, 1, config.c, weight[1], weight[0])]
    return [linear.Problem(loss, k, config.c, w) for k, w in enumerate(weight)]


def fit_all(rows: DataFrame, features: Features | None, width: int, configs: Sequence[Config]) -> list[Classifier]:
    """A classifier for each configuration, trained together, on ``rows(y, indices, data)``."""
    known, classes, sizes = _labelled(rows)
    problems = [_problems(sizes, c) for c in configs]
    weights = linear.fit(known, width, [p for own in problems for p in own], max(c.iterations for c in configs))
    ends = np.cumsum([0, *map(len, problems)])
    return [Classifier(features, weights[:, a:b], classes, c.family) for a, b, c in zip(ends, ends[1:], configs)]


def train(docs: DataFrame, config: Config = Config()) -> Classifier:
    """Fit on ``docs([title,] text, y)``; rows without class are left out, fewer than two classes are an error."""
    known = docs.filter("y is not null")
    features = fit_features(known, config)
    return fit_all(cut(features.of(known, ["y"]), "train"), features, len(features.terms), [config])[0]


@dataclass(frozen=True)
class Split:
    """``y, indices, data`` of both parts of a fixed split, by features fitted on the first."""

    inner: DataFrame
    valid: DataFrame
    width: int


def featured_split(train_docs: DataFrame, valid_docs: DataFrame, config: Config = Config()) -> Split:
    known = train_docs.filter("y is not null")
    features = fit_features(known, config)
    return Split(cut(features.of(known, ["y"]), "inner-train"), cut(features.of(valid_docs, ["y"]), "inner-valid"), len(features.terms))


def featured_splits(docs: DataFrame, number: int, config: Config = Config()) -> Iterator[Split]:
    """The splits of ``number`` folds from ``docs([title,] text, y, train int, valid int)``, each text read twice in all:
    bit k of ``train`` and of ``valid`` says that a document is in that part of fold k."""
    yield from _splits(*_counted_folds(docs, number, config))


def _counted_folds(docs: DataFrame, number: int, config: Config) -> tuple[list[Features], list[str], DataFrame]:
    """The features of each fold, the terms of all, and :func:`counted_terms` of these."""
    each = fit_parts(docs.filter("y is not null and train <> 0").withColumnRenamed("train", "parts"), number, config)
    terms = sorted({t for f in each for t in f.terms})
    return each, terms, cut(counted_terms(docs.filter("train <> 0 or valid <> 0"), terms, ["y", "train", "valid"]), "counted-terms")


def _splits(each: list[Features], terms: list[str], counted: DataFrame) -> Iterator[Split]:
    cores = counted.sparkSession.sparkContext.defaultParallelism
    for k, features in enumerate(each):
        own, other = (counted.filter(F.col(c).bitwiseAND(1 << k) != 0) for c in ("train", "valid"))
        inner = weighed(own.filter("y is not null"), terms, features, ["y"])
        inner = inner if inner.rdd.getNumPartitions() >= cores else inner.repartition(cores)
        yield Split(cut(inner, "inner-train"), cut(weighed(other, terms, features, ["y"]), "inner-valid"), len(features.terms))


@dataclass(frozen=True)
class Tried:
    """``(tp, fp, fn)`` of each configuration that was tried on a split."""

    found: dict[Config, tuple[int, int, int]]


def tried_splits(docs: DataFrame, number: int, positive: str, configs: Sequence[Config]) -> Iterator[Split | Tried]:
    """The folds of :func:`featured_splits` with ``configs`` tried on each: a task a fold holds its vectors and trains all
    of them. If a fold has more than ``WHOLE`` entries the splits come untried, for distributed passes."""
    each, terms, counted = _counted_folds(docs, number, configs[0])
    entries, known = [0] * number, [Counter() for _ in range(number)]
    for r in counted.groupBy("y", "train", "valid").agg(F.count("*").alias("n"), F.sum(F.size("places")).alias("entries")).collect():
        for k in range(number):
            entries[k] += r["entries"] * bool((r["train"] | r["valid"]) & 1 << k)
            if r["train"] & 1 << k and r["y"] is not None:
                known[k][r["y"]] += r["n"]
    for own in known:
        _checked(own)
    if max(entries) > WHOLE:
        yield from _splits(each, terms, counted)
        return
    parts = [_tried(counted, k, terms, each[k], sorted(known[k].items()), positive, configs) for k in range(number)]
    rows = counted.sparkSession.sparkContext.union([part.rdd for part in parts]).collect()  # a union of frames of one partition may be one task
    found = {(r["fold"], r["config"]): (r["tp"], r["fp"], r["fn"]) for r in rows}
    for k in range(number):
        yield Tried({c: found[k, j] for j, c in enumerate(configs)})


def _tried(counted: DataFrame, fold: int, terms: list[str], features: Features, known: list[tuple[str, int]], positive: str, configs: Sequence[Config]) -> DataFrame:
    """``fold, config, tp, fp, fn`` from one task."""
    sent = counted.sparkSession.sparkContext.broadcast((_places(terms, features), features.weights))
    classes, width = [c for c, _ in known], len(features.terms)
    problems = [_problems([n for _, n in known], c) for c in configs]
    ends = np.cumsum([0, *map(len, problems)]).tolist()
    said, iterations = classes.index(positive) if positive in classes else -1, max(c.iterations for c in configs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = []  # the smaller part, packed when the training rows are

        def parts() -> Iterator[tuple]:
            for batch in batches:
                sizes, index, data = _vectors(batch, *sent.value)
                for k in (2, 3):
                    there = batch.column(k).is_valid().to_numpy(zero_copy_only=False)
                    entry = np.repeat(there, sizes)
                    own = batch.column(k).drop_null().to_numpy(zero_copy_only=False), sizes[there], index[entry], data[entry]
                    if k == 2:
                        yield own
                    else:
                        kept.append(own)

        inner = linear.Packed(parts(), width)
        valid = linear.Packed(kept, width)
        kept.clear()
        weights = linear.descend(inner.sums, width, [p for own in problems for p in own], iterations)
        counts = np.zeros((len(configs), 3), np.int64)
        for at, m, _ in valid.margins(weights):
            is_pos = valid.labels[at] == 1
            for k, (a, b) in enumerate(zip(ends, ends[1:])):
                own = m[:, a:b] if b - a > 1 else np.concatenate([-m[:, a:b], m[:, a:b]], axis=1)
                yes = own.argmax(1) == said
                counts[k] += (is_pos & yes).sum(), (~is_pos & yes).sum(), (is_pos & ~yes).sum()
        columns = [pa.array([fold] * len(configs), pa.int32()), pa.array(range(len(configs)), pa.int32()), *(pa.array(c, pa.int64()) for c in counts.T)]
        yield pa.RecordBatch.from_arrays(columns, ["fold", "config", "tp", "fp", "fn"])

    bit = lambda c: F.col(c).bitwiseAND(1 << fold) != 0
    inner = F.when(bit("train"), F.array_position(F.array(*map(F.lit, classes)), F.col("y")).cast("int") - 1)
    valid = F.when(bit("valid"), (F.col("y") == positive).cast("int"))
    rows = counted.filter(bit("train") | bit("valid")).select("places", "counts", inner.alias("inner"), valid.alias("valid"))
    return rows.coalesce(1).mapInArrow(run, "fold int, config int, tp long, fp long, fn long")


def search_all(split: Split | Tried, positive: str, configs: Sequence[Config]) -> list[tuple]:
    """``(tp, fp, fn, f1)`` on the second part of each configuration, all trained and judged together."""
    if isinstance(split, Tried):
        return [_rated(*split.found[c]) for c in configs]
    models = fit_all(split.inner, None, split.width, configs)
    out = []
    for k, model in enumerate(models):
        is_pos, said = F.col("y") == positive, F.col("y_pred") == positive
        counted = model.scored(split.valid, ["y"]).agg(F.count_if(is_pos & said).alias("tp"), F.count_if(~is_pos & said).alias("fp"), F.count_if(is_pos & ~said).alias("fn"))
        counted = counted.withColumn("k", F.lit(k))
        out = counted if k == 0 else out.union(counted)
    found = {r["k"]: (r["tp"], r["fp"], r["fn"]) for r in out.collect()}
    return [_rated(*found[k]) for k in range(len(models))]


def _rated(tp: int, fp: int, fn: int) -> tuple[int, int, int, float]:
    return tp, fp, fn, 2 * tp / (2 * tp + fp + fn) if tp else 0.0


def search(train_docs: DataFrame | Split | Tried, valid_docs: DataFrame | None, positive: str, config: Config = Config(), grid: Sequence[tuple[float, bool]] = GRID) -> tuple[list[tuple], int]:
    """``(c, balanced, tp, fp, fn, f1)`` of each configuration on the fixed split, and the place of the best
    (the first among equals). ``train_docs`` may be a split whose features are there already, or one that was tried."""
    split = train_docs if isinstance(train_docs, Split | Tried) else featured_split(train_docs, valid_docs, config)
    rows = [(*g, *found) for g, found in zip(grid, search_all(split, positive, [replace(config, c=c, balanced=b) for c, b in grid]))]
    return rows, best_of([r[-1] for r in rows])


def best_of(values: Sequence[float]) -> int:
    """Place of the greatest value, the first among equals."""
    return max(range(len(values)), key=lambda k: (values[k], -k))


def score_batches(docs: DataFrame, make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Run an outside model over Arrow batches; ``make`` loads it once in each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            yield model(batch)

    return docs.mapInPandas(run, schema)


def zero_shot(docs: DataFrame, classes: list[str], prompt: str, make: Callable[[], Callable[[list[str]], list[str]]], fallback: str, words: int = 1500) -> DataFrame:
    """``id, resposta, y_pred, fora_do_rotulo`` by a text generator: render, generate, parse; ``fallback`` where
    the answer's first term is no class. ``make`` gives a function from prompts to answers. The prompt gets the
    first ``words`` words of title and text (of the text alone where ``docs`` has no title)."""
    asked = docs.select("id", rendered(prompt, first_words(entry_text(docs), words)).alias("pergunta"))

    def loaded() -> Callable[[pd.DataFrame], pd.DataFrame]:
        generate = make()
        return lambda batch: pd.DataFrame({"id": batch["id"], "resposta": generate(batch["pergunta"].tolist())})

    parsed = first_class(F.col("resposta"), classes)
    return score_batches(asked, loaded, "id long, resposta string").select("id", "resposta", F.coalesce(parsed, F.lit(fallback)).alias("y_pred"), parsed.isNull().alias("fora_do_rotulo"))
