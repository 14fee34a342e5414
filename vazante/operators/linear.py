"""Linear classifiers, one against the rest, trained for many configurations at once.

Rows have ``label int, indices array<int>, data array<float>``: a sparse vector of weights and its class.
Every (configuration, class) is a problem of its own: least ``|w|^2 / 2 + C * sum of weighted losses``, with the
intercept as the weight of a constant feature. All problems share the passes over the rows: a pass sends the
current weights to the tasks, which add up losses and gradients of all problems; sums are merged by blocks of
features. The driver holds a few gradients of all problems and takes the steps (limited-memory quasi-Newton, each
problem with its own step length). The number of features and problems is bounded; rows may be any number. Rows that
one task can hold are packed there once (:class:`Packed`) and take all passes in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

SLICE = 40_000  # weights of rows that are worked on together
BLOCK = 16_384  # features of one message
MEMORY = 6
ROWS = 2_000  # rows and most frequent features of a dense block, and entries of the lists beside it that are worked on together
DENSE = 2_048
RUN = 4_000
DRIVER_BYTES = 64_000_000  # up to which the tasks' sums go to the driver unmerged


@dataclass(frozen=True)
class Problem:
    """loss ``log`` or ``hinge`` (squared); positive: the class; c: inverse of the regularisation; weights of the rows
    of the class and of the others."""

    loss: str
    positive: int
    c: float = 1.0
    own_weight: float = 1.0
    other_weight: float = 1.0


def slices(batch: pa.RecordBatch, first: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Of the vectors in columns ``first`` and the next: rows, their row numbers (one a weight), indices and weights."""
    lists = batch.column(first)
    ends = np.cumsum(np.diff(lists.offsets.to_numpy()))
    index, data = lists.flatten().to_numpy(zero_copy_only=False), batch.column(first + 1).flatten().to_numpy(zero_copy_only=False)
    at = 0
    while at < len(ends):
        begin = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, begin + SLICE, "right")))
        sizes = np.diff(ends[at:to], prepend=begin)
        yield slice(at, to), np.repeat(np.arange(to - at), sizes), index[begin : ends[to - 1]], data[begin : ends[to - 1]]
        at = to


def margins(row: np.ndarray, index: np.ndarray, data: np.ndarray, rows: int, weights: np.ndarray) -> np.ndarray:
    """Rows times problems; the last row of ``weights`` holds the intercepts."""
    out = np.zeros((rows, weights.shape[1]), np.float32)
    if len(row):
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        out[row[starts]] = np.add.reduceat(data[:, None] * weights[index], starts, axis=0)
    return out + weights[-1]


def _pass(rows: DataFrame, problems: Sequence[Problem], weights: np.ndarray, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """Loss sums and their gradients (without the penalty) of all problems."""
    sent = rows.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    positive = np.array([p.positive for p in problems])
    own, other = (np.array([getattr(p, n) * p.c for p in problems]) for n in ("own_weight", "other_weight"))
    hinge = np.array([p.loss == "hinge" for p in problems])
    shape = weights.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        loss, gradient = np.zeros(shape[1]), np.zeros(shape)
        for batch in batches:
            labels = batch.column(0).to_numpy(zero_copy_only=False)
            for at, row, index, data in slices(batch, 1):
                label = labels[at]
                m = margins(row, index, data, len(label), w).astype(float)
                is_own = label[:, None] == positive
                sign, weight = np.where(is_own, 1.0, -1.0), np.where(is_own, own, other)
                z = sign * m
                gap = np.maximum(1 - z, 0)
                e = np.exp(-np.abs(z))
                soft = np.log1p(e) + np.maximum(-z, 0)
                loss += (weight * np.where(hinge, gap * gap, soft)).sum(0)
                slope = -sign * weight * np.where(hinge, 2 * gap, np.where(z > 0, e, 1.0) / (1 + e))
                gradient[-1] += slope.sum(0)
                if len(index):
                    order = np.argsort(index, kind="stable")
                    there = index[order]
                    starts = np.flatnonzero(np.diff(there, prepend=-1))
                    gradient[there[starts]] += np.add.reduceat(data[order, None] * slope[row[order]], starts, axis=0)
        blocks = [loss[None], *(gradient[k : k + BLOCK] for k in range(0, len(gradient), BLOCK))]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary())], ["block", "sums"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b, float) for b in pdf["sums"])
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "sums": [total.tobytes()]})

    parts = rows.select("label", "indices", "data").mapInArrow(run, "block int, sums binary")
    if tasks * weights.size * 8 > DRIVER_BYTES:  # merged by tasks, else by the driver
        parts = parts.groupBy("block").applyInPandas(merge, "block int, sums binary")
    sums: dict[int, np.ndarray] = {}
    for r in parts.collect():
        sums[r["block"]] = sums.get(r["block"], 0) + np.frombuffer(r["sums"], float)
    sent.unpersist()
    if not sums:
        return np.zeros(shape[1]), np.zeros(shape)
    return sums[0], np.concatenate([sums[k].reshape(-1, shape[1]) for k in sorted(sums) if k])


class Packed:
    """Rows of one task in memory, packed once for many passes: blocks of rows of like labels, whose most frequent features
    are multiplied as a dense matrix, the rest as lists. ``parts`` have labels, sizes, indices and weights."""

    def __init__(self, parts: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], features: int):
        self.width, self.blocks = min(features, DENSE), []
        labels: list[np.ndarray] = []
        far: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        number = 0
        for own, sizes, index, data in parts:
            labels.append(own[self._add(number, own, sizes, index, data, features, far)])
            number += len(own)
        self.shape, self.labels = (number, features), np.concatenate(labels) if labels else np.zeros(0, np.int32)
        feature, row, rest = (np.concatenate([f[k] for f in far]) if far else np.zeros(0, t) for k, t in enumerate((np.int32, np.int32, np.float32)))
        del far
        order = np.argsort(feature, kind="stable")
        self.rest = list(_runs(feature[order], row[order], rest[order]))

    def _add(self, number: int, labels: np.ndarray, sizes: np.ndarray, index: np.ndarray, data: np.ndarray, features: int, far: list) -> np.ndarray:
        """Pack a part's rows after ``number`` others; its order."""
        begins = np.cumsum(sizes) - sizes
        order = np.argsort(labels, kind="stable")
        for at in range(0, len(order), ROWS):
            rows = order[at : at + ROWS]
            own = sizes[rows]
            row = np.repeat(np.arange(len(rows), dtype=np.int32), own)
            entry = np.arange(len(row)) + np.repeat(begins[rows] - (np.cumsum(own) - own), own)
            feature, value = index[entry], data[entry]
            often = np.bincount(feature, minlength=features)
            dense = np.sort(np.argpartition(often, features - self.width)[features - self.width :])
            place = np.full(features, -1, np.int32)
            place[dense] = np.arange(self.width, dtype=np.int32)
            place = place[feature]
            near = place >= 0
            row, feature, rest = row[~near], feature[~near], value[~near]
            places = np.repeat(np.arange(len(rows), dtype=np.int32), own)[near] * np.int32(self.width) + place[near]
            self.blocks.append((slice(number + at, number + at + len(rows)), dense, places, value[near], list(_runs(row, feature, rest))))
            far.append((feature, row + np.int32(number + at), rest))
        return order

    def margins(self, weights: np.ndarray) -> Iterator[tuple[slice, np.ndarray, tuple[np.ndarray, np.ndarray]]]:
        """Of each block: its rows, these times problems, and the dense part (features, matrix)."""
        matrix = np.zeros((ROWS, self.width), np.float32)
        for at, dense, places, values, runs in self.blocks:
            own = matrix[: at.stop - at.start]
            own.reshape(-1)[places] = values
            m = own @ weights[dense]
            m += weights[-1]
            for rows, starts, other, value in runs:
                m[rows] += np.add.reduceat(value[:, None] * weights[other], starts, axis=0)
            yield at, m, (dense, own)
            own.reshape(-1)[places] = 0

    def sums(self, problems: Sequence[Problem], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Loss sums and their gradients (without the penalty), one column a problem."""
        positive, own, other, hinge = _columns(problems)
        loss, gradient = np.zeros(len(problems)), np.zeros((self.shape[1] + 1, len(problems)), np.float32)
        slopes = np.empty((self.shape[0], len(problems)), np.float32)
        for at, m, (dense, matrix) in self.margins(weights):
            lost, slope = _losses(self.labels[at], m, positive, own, other, hinge)
            loss += lost
            slopes[at] = slope
            gradient[dense] += matrix.T @ slopes[at]
        for features, starts, rows, value in self.rest:
            gradient[features] += np.add.reduceat(value[:, None] * slopes[rows], starts, axis=0)
        gradient[-1] = slopes.sum(0, dtype=float)
        return loss, gradient


def _runs(key: np.ndarray, other: np.ndarray, value: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Pieces of a list that is sorted by ``key``: keys, where each begins, the other side and the weights."""
    for at in range(0, len(key), RUN):
        own = key[at : at + RUN]
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        yield own[starts], starts, other[at : at + RUN], value[at : at + RUN]


def _columns(problems: Sequence[Problem]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    own, other = (np.array([getattr(p, n) * p.c for p in problems], np.float32) for n in ("own_weight", "other_weight"))
    return np.array([p.positive for p in problems]), own, other, np.array([p.loss == "hinge" for p in problems])


def _losses(labels: np.ndarray, m: np.ndarray, positive: np.ndarray, own: np.ndarray, other: np.ndarray, hinge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss sums and slopes at margins ``m``."""
    is_own = labels[:, None] == positive
    sign, weight = np.where(is_own, np.float32(1), np.float32(-1)), np.where(is_own, own, other)
    z = np.multiply(m, sign, out=m)
    loss, slope = np.zeros(len(positive)), np.empty_like(z)
    edges = [0, *(np.flatnonzero(np.diff(hinge)) + 1).tolist(), len(hinge)]
    for at in map(slice, edges, edges[1:]):
        y, w = z[:, at], weight[:, at]
        if hinge[at.start]:
            gap = np.maximum(1 - y, 0)
            bent = w * gap
            loss[at] = np.einsum("ij,ij->j", bent, gap, dtype=float)
            np.multiply(bent, -2, out=slope[:, at])
        else:
            e = np.exp(-np.abs(y))
            loss[at] = np.einsum("ij,ij->j", w, np.log1p(e) + np.maximum(-y, 0), dtype=float)
            np.divide(-w * np.where(y > 0, e, np.float32(1)), 1 + e, out=slope[:, at])
    slope *= sign
    return loss, slope


class _Descent:
    """Weights of one problem and its next step."""

    def __init__(self, value: float, gradient: np.ndarray, tolerance: float):
        self.w = np.zeros(len(gradient), np.float32)
        self.value, self.gradient = value, gradient
        size = max(_norm(gradient), 1e-12)
        self.least, self.direction = tolerance * size, -gradient / np.float32(size)
        self.steps: list[np.ndarray] = []
        self.changes: list[np.ndarray] = []
        self.length, self.going = np.float32(1), _norm(gradient) > self.least

    def trial(self) -> np.ndarray:
        return self.w + self.length * self.direction

    def tried(self, trial: np.ndarray, value: float, gradient: np.ndarray) -> None:
        """Take the step if it lowers the objective enough, else halve it."""
        if value <= self.value + 1e-4 * float(self.length) * _dot(self.gradient, self.direction):
            self.steps.append(trial - self.w)
            self.changes.append(gradient - self.gradient)
            del self.steps[:-MEMORY], self.changes[:-MEMORY]
            self.going = self.value - value >= 1e-6 * abs(self.value)
            self.w, self.value, self.gradient, self.length = trial, value, gradient, np.float32(1)
            fresh = self._fresh()
            self.direction = fresh if _dot(fresh, gradient) < 0 else -gradient
        else:
            self.length /= 2
        self.going = self.going and _norm(self.gradient) > self.least and self.length > 1 / 64

    def _fresh(self) -> np.ndarray:
        """The quasi-Newton direction by the two-loop recursion."""
        q, used = self.gradient.copy(), []
        for s, y in zip(reversed(self.steps), reversed(self.changes)):
            curve = _dot(s, y)
            rho = 1 / curve if curve > 1e-10 else 0.0
            a = rho * _dot(s, q)
            q -= np.float32(a) * y
            used.append((rho, a, s, y))
        s, y = self.steps[-1], self.changes[-1]
        scale = _dot(s, y) / max(_dot(y, y), 1e-300)
        q *= np.float32(scale if scale > 0 else 1)
        for rho, a, s, y in reversed(used):
            q += np.float32(a - rho * _dot(y, q)) * s
        return -q


def _dot(a: np.ndarray, b: np.ndarray) -> float:
    """Sums of at most 4096 products in single precision, added up in double."""
    whole = len(a) // 4096 * 4096
    return float(np.einsum("ij,ij->i", a[:whole].reshape(-1, 4096), b[:whole].reshape(-1, 4096)).sum(dtype=float) + np.dot(a[whole:], b[whole:]))


def _norm(a: np.ndarray) -> float:
    return float(np.sqrt(_dot(a, a)))


def descend(at: Callable[[Sequence[Problem], np.ndarray], tuple[np.ndarray, np.ndarray]], features: int, problems: Sequence[Problem], iterations: int = 30, tolerance: float = 1e-3) -> np.ndarray:
    """Weights (features + 1 rows, one column a problem) from ``at(problems, weights)``, the loss sums and gradients.

    A problem is done when its gradient is ``tolerance`` times that at zero, when a step no longer lowers its objective
    by a millionth, or when six halvings of a step do not lower it; passes are for those not done yet. At most
    ``iterations`` steps are tried.
    """
    loss, gradient = at(problems, np.zeros((features + 1, len(problems)), np.float32))
    each = [_Descent(loss[k], np.ascontiguousarray(gradient[:, k], np.float32), tolerance) for k in range(len(problems))]
    for _ in range(iterations):
        going = [k for k, d in enumerate(each) if d.going]
        if not going:
            break
        trials = [each[k].trial() for k in going]
        loss, gradient = at([problems[k] for k in going], _turned(np.stack(trials)))
        for k, trial, lost, slope in zip(going, trials, loss, _turned(gradient)):
            each[k].tried(trial, lost + _dot(trial, trial) / 2, slope.astype(np.float32) + trial)
    return np.stack([d.w for d in each], axis=1)


def _turned(a: np.ndarray) -> np.ndarray:
    """The transposed matrix, by pieces that fit the cache."""
    out = np.empty(a.shape[::-1], a.dtype)
    for i in range(0, a.shape[0], 256):
        for j in range(0, a.shape[1], 256):
            out[j : j + 256, i : i + 256] = a[i : i + 256, j : j + 256].T
    return out


def fit(rows: DataFrame, features: int, problems: Sequence[Problem], iterations: int = 30, tolerance: float = 1e-3) -> np.ndarray:
    """:func:`descend` on ``rows(label, indices, data)`` of any number, a distributed pass each time; no rows give zeros."""
    tasks = rows.rdd.getNumPartitions()
    return descend(lambda own, weights: _pass(rows, own, weights, tasks), features, problems, iterations, tolerance)
