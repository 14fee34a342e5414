"""Near-duplicate texts by a chosen-path similarity join.

A record is a set of word shingles. Sets are split recursively on sampled shared
tokens: a node's members are sent to children named by one MinHash coordinate (a
uniformly sampled token of the set), so that two sets of similarity s stay together
with probability s at each step. Nodes that have become small are compared by brute
force; the whole splitting is repeated in independent runs until a pair at the
threshold is met with the target probability. Every candidate is verified exactly on
the words of both texts.

How it is laid out on Spark:

* one Arrow pass over the texts gives fixed-size fingerprints; they are the only
  per-document data that is shuffled until verification;
* equal word sequences share a class key and enter the splitting once, so copies
  never fill a node (a class that holds a third of the rows counts as one record);
* the first levels, which cannot yield a small node, are taken in one step; after that
  one shuffle a level sorts nodes, compares the small ones in place and passes on the
  members of the large ones, each to several children;
* a node still large at the last level holds sets that are nearly all similar: its
  members are dealt into blocks and the block pairs spread over tasks.

Null and blank texts, and texts of fewer than ``min_words`` words, have no similarity
to anything: they are in no pair and form a class of their own in the groups.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import buckets
from ..operators.graph import connected_components
from ..session import cut
from . import sketch

FINGERPRINT = (
    "id long, c1 long, c2 long, words long, sk long, n0 long, n1 long, n2 long, n3 long, sig binary"
)
ENTRY = "node long, item long, sk long"
SEEN_LIMIT = 1_000_000
MOST_RUNS = 1 << 16
EXPANDED = 1_000  # rows of a class that one part of its pairs starts from


@dataclass(frozen=True)
class JoinSettings:
    """Parameters of the join.

    width, threshold, min_words: shingle length, least similarity, fewest words of a text.
    target_recall: probability with which a pair exactly at the threshold is met.
    small: members up to which a node is compared by brute force.
    background: similarity assumed between unrelated texts, which sets the first depth.
    more_levels: levels after the first depth before dense nodes are cut into blocks.
    children: children of a large node that each of its members goes to.
    """

    width: int = 3
    threshold: float = 0.7
    min_words: int = 20
    target_recall: float = 0.999
    small: int = 512
    background: float = 0.1
    more_levels: int = 2
    children: int = 4

    def depth(self, sets: int) -> int:
        """Levels that surely leave more than ``small`` members, so no node is counted there."""
        return max(1, int(math.log(max(sets / self.small, 2)) / math.log(1 / self.background)))

    def runs(self, depth: int) -> int:
        """Runs for the target recall when nodes stay large and split on: a pair whose signatures agree in ``k``
        coordinates meets in one with the probability that all of a path agree, times the probability that
        ``children`` fresh coordinates a level do not part it for good in ``more_levels`` levels, after which all
        members of a node are compared."""

        def kept(k: int) -> float:
            t, lost = k / sketch.COORDS, 0.0
            for _ in range(self.more_levels):
                lost = (1 - t + t * lost) ** self.children
            return 1 - lost

        return max(4, self.least_runs(depth, kept))

    def least_runs(self, depth: int, kept: Callable[[int], float] = lambda k: 1.0) -> int:
        """Fewest runs that meet a pair at the threshold with the target recall, averaged over the number ``k`` of
        its agreeing coordinates. All runs draw from the same signature, so they are independent only given ``k``.
        """
        every, t = sketch.COORDS, self.threshold
        odds = [(math.comb(every, k) * t**k * (1 - t) ** (every - k), math.comb(k, depth) / math.comb(every, depth) * kept(k)) for k in range(every + 1)]
        missed = lambda runs: sum(p * (1 - met) ** runs for p, met in odds)
        high = 1
        while missed(high) > 1 - self.target_recall:
            high *= 2
            if high > MOST_RUNS:
                raise ValueError("the target recall takes too many runs")
        return next(r for r in range(high // 2, high + 1) if missed(r) <= 1 - self.target_recall)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x)


def fingerprints(docs: DataFrame, settings: JoinSettings) -> DataFrame:
    """FINGERPRINT rows of ``docs(id, text)``; sketches are null where a task has already given
    them for the same class (a map-side combine of copies)."""
    width, least = settings.width, max(settings.min_words, settings.width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for lo, hi in sketch.slices(texts):
                hashes, counts = sketch.word_hashes(texts[lo:hi])
                keep = counts >= least
                hashes = hashes[np.repeat(keep, counts)]
                counts = counts[keep]
                if not len(counts):
                    continue
                c1, c2 = sketch.class_keys(hashes, counts)
                if len(seen) > SEEN_LIMIT:
                    seen.clear()
                fresh = np.zeros(len(c1), bool)
                for i, key in enumerate(c1.tolist()):
                    if key not in seen:
                        seen.add(key)
                        fresh[i] = True
                number = counts[fresh]
                sig = np.zeros((0, sketch.COORDS), np.uint16)
                if len(number):
                    shingles, number = sketch.shingle_hashes(hashes[np.repeat(fresh, counts)], number, width)
                    sig = sketch.minhash(shingles, number)
                place = np.cumsum(fresh) - 1

                def spread(values: np.ndarray) -> pa.Array:
                    full = values[np.maximum(place, 0)] if len(values) else np.zeros(len(c1), np.uint64)
                    return pa.array(full.view(np.int64), mask=~fresh)

                low = sketch.nibbles(sig) if len(sig) else np.zeros((0, 4), np.uint64)
                rows = [sig[p].tobytes() if f else None for p, f in zip(place, fresh)]
                yield pa.RecordBatch.from_arrays(
                    [_signed(ids[lo:hi][keep]), _signed(c1), _signed(c2), _signed(counts)]
                    + [spread(sketch.bits(sig) if len(sig) else np.zeros(0, np.uint64))]
                    + [spread(np.ascontiguousarray(low[:, k])) for k in range(4)]
                    + [pa.array(rows, pa.binary())],
                    ["id", "c1", "c2", "words", "sk", "n0", "n1", "n2", "n3", "sig"],
                )

    return docs.select(F.col("id").cast("long"), F.col("text").cast("string")).mapInArrow(run, FINGERPRINT)


def _sig(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, sketch.COORDS)


def _child(node: np.ndarray, choice: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """Key of the child that a set goes to by the coordinate ``choice`` of its node."""
    token = sig[np.arange(len(sig)), choice].astype(np.uint64)
    return sketch.mix(node ^ sketch.mix(token + (choice.astype(np.uint64) << np.uint64(20))))


def _entries(batch: pa.RecordBatch, first: int, nodes: list[np.ndarray]) -> pa.RecordBatch:
    """ENTRY rows that put each row of ``batch`` (item, sk, [side] from column ``first``) into each of ``nodes``."""
    names = batch.schema.names[first:]
    kept = [batch.column(k) for k in range(first, batch.num_columns) if batch.schema.names[k] != "sig"]
    names = [n for n in names if n != "sig"]
    times = len(nodes)
    return pa.RecordBatch.from_arrays(
        [_signed(np.concatenate(nodes)), *(pa.concat_arrays([c] * times) for c in kept)], ["node", *names]
    )


def _with_side(sets: DataFrame) -> tuple[list[str], str]:
    sided = "side" in sets.columns
    return ["item", "sk", "sig", *(["side"] if sided else [])], ENTRY + (", side int" if sided else "")


def first_nodes(sets: DataFrame, depth: int, runs: int) -> DataFrame:
    """ENTRY rows of all runs at the first depth: one path a run, a coordinate a level."""
    rng = np.random.default_rng(20)
    paths = np.stack([rng.choice(sketch.COORDS, depth, replace=False) for _ in range(runs)])
    columns, shape = _with_side(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _sig(batch.column(2))
            nodes = []
            for r, path in enumerate(paths):
                node = np.full(len(sig), np.uint64(r + 1))
                for level in path:
                    node = _child(node, np.full(len(sig), level), sig)
                nodes.append(node)
            yield _entries(batch, 0, nodes)

    return sets.select(*columns).mapInArrow(run, shape)


def next_nodes(members: DataFrame, children: int) -> DataFrame:
    """ENTRY rows of the children, by different coordinates that the node's key samples, of each member."""
    columns, shape = _with_side(members)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            sig = _sig(batch.column(3))
            draw = sketch.mix(node + np.uint64(977))
            start = (draw % np.uint64(sketch.COORDS)).astype(np.int64)
            gap = 2 * ((draw >> np.uint64(32)) % np.uint64(sketch.COORDS // 2)).astype(np.int64) + 1  # odd: no coordinate comes twice
            yield _entries(batch, 1, [_child(node, (start + k * gap) % sketch.COORDS, sig) for k in range(children)])

    return members.select("node", *columns).mapInArrow(run, shape)


def bit_bound(threshold: float) -> int:
    """Bits of 64 that may differ: 3.8 standard deviations above what a pair at the threshold shows."""
    p = (1 - threshold) / 2
    return int(64 * p + 3.8 * math.sqrt(64 * p * (1 - p)))


def candidates(sets: DataFrame, settings: JoinSettings) -> DataFrame:
    """Distinct pairs ``a, b`` of items of ``sets(item, sk, sig, [side])`` that met in a node and look alike.

    Without sides ``a < b``; with sides ``a`` is of side 0 and ``b`` of side 1, and nodes that hold one side
    only go no further. An item may be on both sides.
    """
    depth = settings.depth(sets.count())
    most = bit_bound(settings.threshold)
    sided = "side" in sets.columns
    entries = first_nodes(sets, depth, settings.runs(depth))
    found = []
    for level in range(settings.more_levels + 1):
        done = cut(buckets.compare(entries, most, settings.small), f"nodes{level}")
        found.append(done.filter("not large").select("a", "b"))
        large = done.filter("large").select(F.col("a").alias("node"), F.col("b").alias("item"), *(["side"] if sided else []))
        if large.isEmpty():
            break
        if sided:
            mixed = large.groupBy("node").agg(F.min("side").alias("x"), F.max("side").alias("y")).filter("x < y").select("node")
            large = large.join(mixed, "node", "left_semi")
        own = sets.groupBy("item").agg(F.any_value("sk").alias("sk"), F.any_value("sig").alias("sig"))
        if level < settings.more_levels:
            entries = next_nodes(large.join(own, "item"), settings.children)
        else:
            found.append(cut(buckets.compare_blocks(cut(large.join(own.drop("sig"), "item"), "dense"), most), "blocks"))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def same_nibbles(a: str, b: str) -> F.Column:
    """How many of the 64 coordinates agree in four bits, from the packed columns of two aliases."""
    total = F.lit(0)
    for k in range(sketch.MARKED // 16):
        x = F.col(f"{a}.n{k}").bitwiseXOR(F.col(f"{b}.n{k}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        total = total + 16 - F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def nibble_bound(threshold: float) -> int:
    """Coordinates of 64 that agree at least: four standard deviations below a pair at the threshold."""
    p = threshold + (1 - threshold) / 16
    return int(64 * p - 4 * math.sqrt(64 * p * (1 - p)))


def sets_of(prints: DataFrame) -> DataFrame:
    """One row a task and class: ``item, sk, sig``."""
    return prints.filter("sig is not null").select(F.col("c1").alias("item"), "sk", "sig")


def classes_of(prints: DataFrame) -> DataFrame:
    """One row for each distinct word sequence: its keys, smallest id, number of rows and sketch."""
    return prints.groupBy("c1", "c2").agg(
        F.min("id").alias("rep"),
        F.count("*").alias("rows"),
        *(F.max(f"n{k}").alias(f"n{k}") for k in range(4)),
    )


def verify(pairs: DataFrame, docs: DataFrame, settings: JoinSettings) -> DataFrame:
    """``rep_a, rep_b, similarity`` of the pairs (of ids) whose texts reach the threshold, exactly."""
    width, least = settings.width, settings.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, set())
        for batch in batches:
            ids, others = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[tuple] = []
            for a, b, x, y in zip(ids, others, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if last[0] != b:
                    last = (b, sketch.shingle_set(y, width))
                s = sketch.jaccard(sketch.shingle_set(x, width), last[1])
                if s >= least:
                    out.append((a, b, s))
            a, b, s = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], ["rep_a", "rep_b", "similarity"]
            )

    text = docs.select(F.col("id").cast("long"), "text")
    both = (
        pairs.join(text.select(F.col("id").alias("rep_a"), F.col("text").alias("text_a")), "rep_a")
        .join(text.select(F.col("id").alias("rep_b"), F.col("text").alias("text_b")), "rep_b")
        .select("rep_a", "rep_b", "text_a", "text_b")
    )
    return both.mapInArrow(run, "rep_a long, rep_b long, similarity double")


@dataclass(frozen=True)
class NearDuplicates:
    """links: rep_a < rep_b, similarity, between classes; classes: c1, c2, rep, rows; members: id, c1, c2."""

    links: DataFrame
    classes: DataFrame
    members: DataFrame


def near_duplicates(docs: DataFrame, settings: JoinSettings = JoinSettings()) -> NearDuplicates:
    """Chosen-path join of ``docs(id, text)``; ids are unique."""
    prints = cut(fingerprints(docs, settings), "prints")
    classes = cut(classes_of(prints), "classes")
    a, b = classes.alias("a"), classes.alias("b")
    pairs = (
        candidates(sets_of(prints), settings)
        .join(a, F.col("a") == F.col("a.c1"))
        .join(b, F.col("b") == F.col("b.c1"))
        .filter(same_nibbles("a", "b") >= nibble_bound(settings.threshold))
        .select(F.least("a.rep", "b.rep").alias("rep_a"), F.greatest("a.rep", "b.rep").alias("rep_b"))
    )
    links = cut(verify(pairs, docs, settings), "links")
    return NearDuplicates(links, classes.select("c1", "c2", "rep", "rows"), prints.select("id", "c1", "c2"))


def duplicate_pairs(found: NearDuplicates) -> DataFrame:
    """``id_a < id_b`` for all pairs of rows: within classes and across the links between classes.

    Only rows of classes that have a link or a copy are expanded; the number of rows of the
    result is that of the pairs asked for.
    """
    linked = found.links.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).distinct()
    own = found.classes.select("c1", "c2", "rep", "rows")
    useful = own.join(linked.withColumn("linked", F.lit(True)), "rep", "left").filter("rows > 1 or linked")
    rows = cut(found.members.join(useful, ["c1", "c2"]).select("rep", "id", "rows"), "members")
    # the rows of a large class are dealt into parts, each paired with all its rows, so that many tasks expand it
    parts = F.ceil(F.col("rows") / EXPANDED).cast("int")
    several = rows.filter("rows > 1")
    inside = (
        several.select("rep", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), F.col("id").alias("id_a"))
        .join(several.select("rep", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("id").alias("id_b")), ["rep", "part"])
        .filter("id_a < id_b")
        .select("id_a", "id_b")
    )
    across = (
        found.links.join(rows.select(F.col("rep").alias("rep_a"), F.col("id").alias("x")), "rep_a")
        .join(rows.select(F.col("rep").alias("rep_b"), F.col("id").alias("y")), "rep_b")
        .select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    )
    return inside.union(across)


def duplicate_groups(docs: DataFrame, found: NearDuplicates) -> DataFrame:
    """One row per row of ``docs``: id, group (smallest id of its component), rows of equal words, links.

    Texts without similarity (null, blank, short) are groups of their own with no link.
    """
    degree = (
        found.links.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    )
    parts = connected_components(found.links.select(F.col("rep_a").alias("id_a"), F.col("rep_b").alias("id_b")))
    label = (
        found.classes.join(parts.select(F.col("id").alias("rep"), "component"), "rep", "left")
        .join(degree, "rep", "left")
        .select("c1", "c2", F.coalesce("component", "rep").alias("group_id"), F.col("rows").alias("equal_rows"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    known = found.members.join(label, ["c1", "c2"]).select("id", "group_id", "equal_rows", "links")
    return (
        docs.select(F.col("id").cast("long"))
        .join(known, "id", "left")
        .select(
            "id",
            F.coalesce("group_id", "id").alias("group_id"),
            F.coalesce("equal_rows", F.lit(1).cast("long")).alias("equal_rows"),
            F.coalesce("links", F.lit(0).cast("long")).alias("links"),
        )
    )
