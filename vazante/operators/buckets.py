"""Compare the members of buckets that a hash join has filled, however full a bucket is.

An entry is a member of a bucket with a bit sketch; two members of a bucket are a candidate pair if their
sketches differ in few bits. Entries are sorted by bucket and streamed: a bucket of at most ``small``
members is compared where it lies, the members of a larger one are handed on. Those are dealt into blocks
of bounded size, and every pair of blocks is a bucket of its own, so no task ever holds or joins a whole
large bucket, and no pair of its members is left out.

Entries have ``node long, item long``, sketch columns ``sk...`` and, where only members of different sides
are to be compared, ``side int``. Repeated entries count once. Null nodes are not allowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MET = "large boolean, a long, b long, side int"
BLOCK = 1024


def _met(large: bool, a: np.ndarray, b: np.ndarray, side: np.ndarray | None) -> pa.RecordBatch:
    last = pa.nulls(len(a), pa.int32()) if side is None else pa.array(side, pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), large)), pa.array(a), pa.array(b), last], ["large", "a", "b", "side"])


def _pairs(node: np.ndarray, item: np.ndarray, sketches: list[np.ndarray], side: np.ndarray | None, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates among neighbours of sorted entries; with sides the lower side comes first, else the lower item."""
    at = np.arange(len(node))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = 1
    while len(at := at[at + step < len(node)]) and len(at := at[node[at] == node[at + step]]):
        apart = sum(np.bitwise_count(s[at] ^ s[at + step]) for s in sketches)
        near = at[apart <= most_bits]
        if side is not None:
            near = near[side[near] != side[near + step]]
        left.append(near)
        right.append(near + step)
        step += 1
    x, y = np.concatenate(left), np.concatenate(right)
    swap = side[x] > side[y] if side is not None else item[x] > item[y]
    return item[np.where(swap, y, x)], item[np.where(swap, x, y)]


def compare(entries: DataFrame, most_bits: int, small: int | None) -> DataFrame:
    """MET rows: a candidate pair of items ``a, b``, or (``large``) a node ``a`` and its member ``b`` with its side.

    Without ``small`` every bucket is compared here; only :func:`in_blocks` bounds them then.
    """
    sided = "side" in entries.columns
    sketches = sorted(c for c in entries.columns if c.startswith("sk"))
    names = ["node", "item", *sketches, *(["side"] if sided else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        passing = None  # the large bucket whose members are being handed on
        for batch in _then_end(batches):
            if batch is not None:
                if not batch.num_rows:
                    continue
                own = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(names))]
                own = [c.view(np.uint64) if name.startswith("sk") else c for name, c in zip(names, own)]
                held = own if held is None else [np.concatenate(x) for x in zip(held, own)]
            if held is None or not len(held[0]):
                continue
            new = np.ones(len(held[0]), bool)
            new[1:] = np.any([held[k][1:] != held[k][:-1] for k in (0, 1, *([len(names) - 1] if sided else []))], axis=0)
            held = [c[new] for c in held]
            node = held[0]
            starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            sizes = np.diff(np.append(starts, len(node)))
            over = sizes > small if small else np.zeros(len(sizes), bool)
            if passing is not None:
                over[0] |= node[0] == passing
            # the last bucket may go on in the next batch: hold it unless it is known to be large
            wait = batch is not None and not over[-1]
            passing = node[-1] if over[-1] else None
            end = starts[-1] if wait else len(node)
            big = np.repeat(over, sizes)[:end]
            done = [c[:end] for c in held]
            if big.any():
                yield _met(True, done[0][big], done[1][big], done[-1][big] if sided else None)
            rest = [c[~big] for c in done]
            a, b = _pairs(rest[0], rest[1], rest[2 : 2 + len(sketches)], rest[-1] if sided else None, most_bits)
            if len(a):
                yield _met(False, a, b, None)
            held = [c[end:] for c in held]

    order = ["node", "item", *(["side"] if sided else [])]
    return entries.select(*names).repartition("node").sortWithinPartitions(*order).mapInArrow(run, MET)


def _then_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def in_blocks(large: DataFrame, block: int) -> DataFrame:
    """Entries of the block pairs of large buckets, from entries ``node, item, sk..., [side]``.

    Without sides the members of two different blocks are the two sides of their bucket, and each block is
    also a bucket by itself. With sides the blocks of one side are paired with those of the other.
    """
    sketches = [c for c in large.columns if c.startswith("sk")]
    number = lambda n: F.greatest(F.ceil(n / block), F.lit(1)).cast("int")
    if "side" in large.columns:
        sizes = large.groupBy("node").agg(number(F.count_if(F.col("side") == 0)).alias("n0"), number(F.count_if(F.col("side") != 0)).alias("n1"))
        first = F.col("side") == 0
        own = F.pmod(F.xxhash64("item"), F.when(first, F.col("n0")).otherwise(F.col("n1"))).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.when(first, F.col("n1")).otherwise(F.col("n0")) - 1))
        spread = large.join(sizes, "node").withColumn("own", own).withColumn("other", other)
        low, high = F.when(first, F.col("own")).otherwise(F.col("other")), F.when(first, F.col("other")).otherwise(F.col("own"))
        return spread.select(F.xxhash64("node", low, high).alias("node"), "item", *sketches, "side")
    sizes = large.groupBy("node").agg(number(F.count("*")).alias("n"))
    spread = large.join(sizes, "node").withColumn("own", F.pmod(F.xxhash64("item"), F.col("n")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    # within a block every member is a side of its own: the item's place in a pair of equal blocks does not matter
    side = F.when(F.col("own") < F.col("other"), 0).when(F.col("own") > F.col("other"), 1).otherwise(F.lit(2))
    return spread.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "item", *sketches, side.alias("side"))


def compare_blocks(large: DataFrame, most_bits: int, block: int | None = None) -> DataFrame:
    """``a, b`` of all candidate pairs in the large buckets ``large``."""
    entries = in_blocks(large, block or BLOCK)
    if "side" in large.columns:
        return compare(entries, most_bits, None).select("a", "b")
    across = compare(entries.filter("side < 2"), most_bits, None).select("a", "b")
    within = compare(entries.filter("side = 2").drop("side"), most_bits, None).select("a", "b")
    return across.union(within).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
