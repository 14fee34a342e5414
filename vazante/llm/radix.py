"""Records that are equal but for formatting, collapsed by radix partitioning of canonical bytes.

The canonical form of a record is a byte string. Tasks first combine equal strings of their own
rows (a group of copies that holds a third of all rows becomes one entry a task). The strings
are then partitioned by their leading bytes: buckets with too many entries are split by further
bytes, level by level, until each fits or its strings end. A path-compressed trie with terminal
counters counts each bucket. Rows find their group by a 128-bit key of the canonical bytes.

A level reads the leading bytes only, which are stored apart, and skips what all strings of a bucket
share; what it finds is a bounded table of split prefixes. Each string then finds its bucket by one
walk down that table and is shuffled once. Null fields count as empty. An empty table gives no groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import letters_and_numbers
from ..session import cut

COMBINED = "id long, h1 long, h2 long, head binary, rest binary, length long, copies long"
BUCKETED = ["bucket", "key", "copies", "id", "h1", "h2"]
COMBINE_BYTES = 16_000_000
TABLE_LIMIT = 100_000
MOST_SPLITS = 1_000_000  # a few hundred bytes each are broadcast
HEAD, PEEK = 192, 64
TASK_BYTES, MOST_TASKS = 32_000_000, 50_000  # a task streams its buckets, so it may hold more bytes than that
PIECE = 16


@dataclass(frozen=True)
class RadixSettings:
    """fits: entries a bucket may hold (more, in proportion, from 250 million strings on); step: bytes by which an oversized bucket is split further."""

    fits: int = 2_000
    step: int = 4


def canonical_link(link: Column) -> Column:
    """Letters and numbers of a link; what follows ``?`` is cut at ``&`` and sorted."""
    link = F.coalesce(link, F.lit(""))
    query = F.instr(link, "?")
    base = F.when(query > 0, F.substr(link, F.lit(1), query - 1)).otherwise(link)
    arguments = F.transform(F.split(F.substr(link, query + 1), "&"), letters_and_numbers)
    return F.concat(
        letters_and_numbers(base),
        F.when(query > 0, F.array_join(F.sort_array(arguments), "")).otherwise(F.lit("")),
    )


def canonical_record(link: Column, title: Column, text: Column) -> Column:
    """Canonical bytes of a record: link, then title and text in either order."""
    a, b = letters_and_numbers(title), letters_and_numbers(text)
    return F.concat_ws("\x01", canonical_link(link), F.least(a, b), F.greatest(a, b)).cast("binary")


class Trie:
    """Path-compressed trie over pieces of PIECE bytes; a lone suffix is kept whole at its branch.

    A terminal is ``[key, copies, least id, h1, h2]``.
    """

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, entry: list) -> None:
        key, node, at = entry[0], self.root, 0
        while True:
            piece = key[at : at + PIECE]
            there = node.get(piece)
            if there is None:
                node[piece] = entry
                return
            at += PIECE
            if isinstance(there, dict):
                node = there
            elif there[0] == key:
                there[1] += entry[1]
                there[2] = min(there[2], entry[2])
                return
            else:
                below = {there[0][at : at + PIECE]: there}
                node[piece] = node = below

    def terminals(self) -> Iterator[list]:
        stack = [self.root]
        while stack:
            for child in stack.pop().values():
                if isinstance(child, dict):
                    stack.append(child)
                else:
                    yield child


def combine(records: DataFrame) -> DataFrame:
    """From ``records(id, key)``: a row with the group key of each record (no copies), and entries with
    the canonical bytes, the copies a task has seen and their least id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size = 0

        def entries() -> pa.RecordBatch:
            keys = list(held)
            ids, copies, h1, h2 = map(list, zip(*held.values())) if held else ([], [], [], [])
            held.clear()
            return batch_of(ids, h1, h2, [k[:HEAD] for k in keys], [k[HEAD:] for k in keys], [len(k) for k in keys], copies)

        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            one, two = [], []
            for i, key in zip(ids, keys):
                entry = held.get(key)
                if entry is None:
                    h = xxhash.xxh3_128_intdigest(key)
                    entry = held[key] = [i, 0, (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)]
                    size += len(key)
                entry[1] += 1
                entry[0] = min(entry[0], i)
                one.append(entry[2])
                two.append(entry[3])
            none = [None] * len(ids)
            yield batch_of(ids, one, two, none, none, none, none)
            if size > COMBINE_BYTES:
                yield entries()
                size = 0
        yield entries()

    def batch_of(*columns: list) -> pa.RecordBatch:
        kinds = [pa.binary() if c.split()[1] == "binary" else pa.int64() for c in COMBINED.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], [c.split()[0] for c in COMBINED.split(", ")])

    return records.select(F.col("id").cast("long"), "key").mapInArrow(run, COMBINED)


def walk(head: bytes, length: int, splits: dict[bytes, int]) -> tuple[bytes, bool]:
    """The bucket of a string that begins with ``head`` and has ``length`` bytes, and whether it could be split further.

    ``splits`` gives, for the prefix of each bucket found too full, the length of its children's prefixes.
    """
    at = 0
    while length > at:
        prefix = head[:at]
        after = splits.get(prefix)
        if after is None:
            return prefix, True
        at = after
    return head[:length], False


def _level(entries: DataFrame, splits: dict[bytes, int], deepest: int, peek: int) -> DataFrame:
    """``bucket, n, low, high`` of the buckets of all strings that could be split further: how many there are, and the
    least and greatest of their next ``peek`` bytes. ``deepest`` is the longest prefix in ``splits``."""
    within = deepest + peek <= HEAD
    sent = entries.sparkSession.sparkContext.broadcast(splits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}

        def given() -> pa.RecordBatch:
            columns = [pa.array(list(held), pa.binary()), *(pa.array([v[k] for v in held.values()], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary())))]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, ["bucket", "n", "low", "high"])

        known = sent.value
        for batch in batches:
            heads, lengths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rests = [b""] * len(heads) if within else batch.column(2).to_pylist()
            for head, length, rest in zip(heads, lengths, rests):
                key = head + rest
                bucket, more = walk(key, length, known)
                if not more:
                    continue
                piece = key[len(bucket) : len(bucket) + peek]
                own = held.get(bucket)
                if own is None:
                    held[bucket] = [1, piece, piece]
                    if len(held) > TABLE_LIMIT:
                        yield given()
                else:
                    own[0] += 1
                    own[1] = min(own[1], piece)
                    own[2] = max(own[2], piece)
        yield given()

    columns = ["head", "length"] if within else ["head", "length", "rest"]
    return (
        entries.select(*columns)
        .mapInArrow(run, "bucket binary, n long, low binary, high binary")
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    )


def split_table(entries: DataFrame, fits: int, step: int) -> dict[bytes, int]:
    """Buckets to split, level by level, until each fits or its strings end.

    A level is one pass over the leading bytes of the strings (over all their bytes only where a bucket shares more
    than HEAD of them). The bytes that all strings of a bucket share are skipped; where they share all that a level
    looks at, the next looks four times as far, so levels grow with the logarithm of what is shared.
    """
    splits: dict[bytes, int] = {}
    deepest, peek = 0, PEEK
    while True:
        full = _level(entries, splits, deepest, peek).filter(F.col("n") > fits).limit(MOST_SPLITS + 1).collect()
        if len(splits) + len(full) > MOST_SPLITS:
            raise ValueError(f"more than {MOST_SPLITS} buckets to split: raise fits")
        if not full:
            return splits
        stuck = False
        for row in full:
            bucket, low, high = bytes(row["bucket"]), bytes(row["low"]), bytes(row["high"])
            shared = next((k for k, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))
            stuck |= shared == peek
            splits[bucket] = len(bucket) + shared + step
        deepest, peek = max(splits.values()), peek * 4 if stuck else peek


def bucketed(entries: DataFrame, settings: RadixSettings) -> DataFrame:
    """``bucket, key, copies, id, h1, h2`` of entries: the bucket is the prefix at which it fits or its strings end."""
    number = entries.count()
    fits = max(settings.fits, -(-number * 8 // MOST_SPLITS))  # so that the table stays small, beyond some hundred million strings
    splits = split_table(entries, fits, settings.step) if number > fits else {}
    sent = entries.sparkSession.sparkContext.broadcast(splits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [h + r for h, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            names = [walk(k, len(k), sent.value)[0] for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(keys, pa.binary()), *(batch.column(k) for k in range(2, 6))], BUCKETED)

    return entries.select("head", "rest", *BUCKETED[2:]).mapInArrow(run, "bucket binary, key binary, copies long, id long, h1 long, h2 long")


def count_buckets(entries: DataFrame, tasks: int) -> DataFrame:
    """``h1, h2, first_id, copies`` of each group, by a trie a bucket; buckets are dealt out to ``tasks`` tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, bucket, held = Trie(), None, 0
        out: list[list] = []

        def given() -> pa.RecordBatch:
            columns = [pa.array([e[k] for e in out], pa.int64()) for k in (3, 4, 2, 1)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["h1", "h2", "first_id", "copies"])

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for b, key, copies, i, h1, h2 in zip(*columns):
                if b != bucket:
                    out.extend(trie.terminals())
                    trie, bucket = Trie(), b
                    if len(out) > 50_000:
                        yield given()
                trie.add([key, copies, i, h1, h2])
        out.extend(trie.terminals())
        yield given()

    return (
        entries.select(*BUCKETED)
        .repartition(tasks, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(run, "h1 long, h2 long, first_id long, copies long")
    )


@dataclass(frozen=True)
class FormatDuplicates:
    """groups: h1, h2, first_id, copies; members: id, h1, h2."""

    groups: DataFrame
    members: DataFrame


def format_duplicates(records: DataFrame, settings: RadixSettings = RadixSettings()) -> FormatDuplicates:
    """Groups of ``records(id, key)`` with equal canonical bytes ``key``."""
    both = cut(combine(records), "combined")
    entries = both.filter("copies is not null")
    size = entries.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, -(-size // TASK_BYTES)))
    return FormatDuplicates(cut(count_buckets(bucketed(entries, settings), tasks), "groups"), both.filter("copies is null").select("id", "h1", "h2"))


def copies_of(found: FormatDuplicates) -> DataFrame:
    """``id_a, id_b``: the least id of each group with each of its other rows."""
    several = found.groups.filter("copies > 1").select("h1", "h2", F.col("first_id").alias("id_a"))
    return (
        found.members.join(several, ["h1", "h2"])
        .filter("id <> id_a")
        .select("id_a", F.col("id").alias("id_b"))
    )
