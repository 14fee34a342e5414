"""Exact and near duplicates of single fields, their groups and reports."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.minhash import banded, signatures
from ..functions.text import shortened, squeezed
from ..session import cut
from . import buckets
from .graph import connected_components

SMALL = 256  # members up to which a bucket of equal bands is compared in one piece


def digest(column: str) -> Column:
    """A 256-bit key of a value, so that long texts are not shuffled to be compared."""
    return F.sha2(F.col(column), 256)


def exact_groups(df: DataFrame, column: str) -> DataFrame:
    """``chave, n, primeiro`` (least id) of the values that occur more than once; nulls never group."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(digest(column).alias("chave"))
        .agg(F.count("*").alias("n"), F.min("id").alias("primeiro"))
        .filter("n > 1")
    )


def exact_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each column: groups, rows beyond the first of their group, and their share of all rows."""
    total = df.agg(F.count("*").alias("total"))
    parts = None
    for column in columns:
        one = exact_groups(df, column).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("linhas_duplicadas"), F.count("*").alias("grupos"))
        one = one.select(F.lit(column).alias("tipo"), "linhas_duplicadas", "grupos")
        parts = one if parts is None else parts.union(one)
    return parts.join(F.broadcast(total)).select("tipo", "linhas_duplicadas", "grupos", F.coalesce(F.try_divide("linhas_duplicadas", "total"), F.lit(0.0)).alias("pct_corpus"))


def exact_examples(df: DataFrame, column: str, number: int = 5, ids: int = 10) -> DataFrame:
    """The largest groups (ties by value) with their first ids: ``valor, n_ocorrencias, ids``.

    The rank filter is applied within each task before the shuffle (a window group limit), so of a
    group of any size a task passes on at most ``ids`` rows.
    """
    shown = shortened(F.col(column))
    groups = df.filter(F.col(column).isNotNull()).groupBy(digest(column).alias("chave"), shown.alias("valor")).agg(F.count("*").alias("n"))
    top = groups.filter("n > 1").orderBy(F.desc("n"), "valor", "chave").limit(number)
    rank = F.row_number().over(W.partitionBy("chave").orderBy("id"))
    rows = df.select("id", digest(column).alias("chave")).withColumn("rank", rank).filter(F.col("rank") <= ids)
    listed = rows.join(F.broadcast(top), "chave").groupBy("chave", "valor", "n").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return listed.select("valor", F.col("n").alias("n_ocorrencias"), "ids")


def exact_affected(df: DataFrame, columns: list[str]) -> DataFrame:
    """Ids of rows that repeat, in any of the columns, a value of a row with a smaller id."""
    out = None
    for column in columns:
        groups = exact_groups(df, column)
        rows = df.select("id", digest(column).alias("chave")).join(groups, "chave").filter("id > primeiro").select("id")
        out = rows if out is None else out.union(rows)
    return out.distinct()


@dataclass(frozen=True)
class NearPairs:
    """pairs: id_a < id_b, jaccard_estimado, between representatives; members: id, rep (least id of equal texts)."""

    pairs: DataFrame
    members: DataFrame


def near_pairs(texts: DataFrame, threshold: float = 0.85, coordinates: int = 128, bands: int = 16, width: int = 5) -> NearPairs:
    """Pairs of ``texts(id, text)`` whose MinHash signatures agree in at least ``threshold`` of the coordinates.

    Texts that are equal once squeezed form a class; only its representative (least id) is banded and
    joined, so copies don't fill a bucket. A bucket of many different texts is compared block by block.
    Null and blank texts are in no pair and no class.
    """
    rows = texts.select(F.col("id").cast("long"), squeezed(F.col("text")).alias("text")).filter("text <> ''")
    prints = cut(signatures(rows, coordinates, width), "prints")
    classes = cut(prints.groupBy("digest").agg(F.min("id").alias("id"), F.max("sig").alias("sig")), "signatures")
    members = cut(prints.select("id", "digest").join(classes.select("digest", F.col("id").alias("rep")), "digest").select("id", "rep"), "near-members")
    most = coordinates - math.ceil(threshold * coordinates)  # bits in which a pair that agrees enough may differ
    marked = cut(banded(classes, bands), "bands")
    entries = marked.select(F.explode("bands").alias("node"), F.col("id").alias("item"), "sk0", "sk1")
    small = cut(buckets.compare(entries, most, SMALL), "band-buckets")
    met = small.filter("not large").select("a", "b")
    large = small.filter("large").select(F.col("a").alias("node"), F.col("b").alias("item"))
    if not large.isEmpty():
        own = marked.select(F.col("id").alias("item"), "sk0", "sk1")
        met = met.union(cut(buckets.compare_blocks(large.join(own, "item"), most), "band-blocks"))
    met = met.select(F.col("a").alias("id_a"), F.col("b").alias("id_b")).distinct()
    sigs = classes.select("id", "sig")

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for k in (2, 3))
                same = (x == y).mean(1)
                out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same)], ["id_a", "id_b", "jaccard_estimado"])
                yield out.filter(pa.array(same >= threshold))

    both = met.join(sigs.select(F.col("id").alias("id_a"), F.col("sig").alias("x")), "id_a").join(sigs.select(F.col("id").alias("id_b"), F.col("sig").alias("y")), "id_b")
    pairs = both.select("id_a", "id_b", "x", "y").mapInArrow(agree, "id_a long, id_b long, jaccard_estimado double")
    return NearPairs(cut(pairs, "near-pairs"), members)


def all_duplicates(rows: DataFrame, columns: list[str], threshold: float = 0.85) -> tuple[DataFrame, NearPairs]:
    """The exact report on ``columns`` and the near pairs of ``text`` of ``rows(id, text, ...)``."""
    return exact_report(rows, columns), near_pairs(rows.select("id", "text"), threshold)


def near_components(found: NearPairs) -> DataFrame:
    """``id, componente`` of every row in a component of at least two rows, copies included."""
    parts = connected_components(found.pairs)
    joined = found.members.join(parts.select(F.col("id").alias("rep"), "component"), "rep", "left")
    label = joined.select("id", F.coalesce("component", "rep").alias("componente"))
    several = label.groupBy("componente").agg(F.count("*").alias("n")).filter("n > 1").select("componente")
    return label.join(several, "componente").select("id", "componente")


def near_affected(components: DataFrame) -> DataFrame:
    """Ids of all but the least row of each component."""
    return components.filter("id <> componente").select("id")


def enriched(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs with ``title, day, category`` of both rows and the days between them (null if a day is)."""
    out = pairs
    for side in ("a", "b"):
        own = rows.select(F.col("id").alias(f"id_{side}"), *(F.col(c).alias(f"{c}_{side}") for c in ("title", "day", "category")))
        out = out.join(own, f"id_{side}", "left")
    return out.withColumn("dias", F.abs(F.datediff("day_a", "day_b")))


def distant_pairs(found: NearPairs, rows: DataFrame, days: int = 30) -> DataFrame:
    """Classes of equal texts and links of two classes with rows over ``days`` days apart: ``id_a < id_b``,
    ``jaccard_estimado`` (1 in a class), ``rep_a, rep_b`` (equal in a class).

    The ids are those of the two rows furthest apart, from the first and last dated row of each class in
    ``rows(id, day)``; a link compares rows of one class with those of the other.
    """
    dated = rows.filter("day is not null").select("id", "day")
    at = F.struct("day", "id")
    ends = cut(found.members.join(dated, "id").groupBy("rep").agg(F.min(at).alias("lo"), F.max(at).alias("hi")), "class-days")
    own = ends.select(F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b"), F.lit(1.0).alias("jaccard_estimado"), F.col("lo").alias("x"), F.col("hi").alias("y"))
    a, b = (ends.select(F.col("rep").alias(f"id_{k}"), F.col("lo").alias(f"lo_{k}"), F.col("hi").alias(f"hi_{k}")) for k in "ab")
    late_b = F.datediff("hi_b.day", "lo_a.day") >= F.datediff("hi_a.day", "lo_b.day")
    linked = found.pairs.join(a, "id_a").join(b, "id_b").select(
        F.col("id_a").alias("rep_a"), F.col("id_b").alias("rep_b"), "jaccard_estimado",
        F.when(late_b, F.col("lo_a")).otherwise(F.col("lo_b")).alias("x"), F.when(late_b, F.col("hi_b")).otherwise(F.col("hi_a")).alias("y"),
    )
    far = own.union(linked).filter(F.datediff("y.day", "x.day") > days)
    return far.select(F.least("x.id", "y.id").alias("id_a"), F.greatest("x.id", "y.id").alias("id_b"), "jaccard_estimado", "rep_a", "rep_b")


def near_row_pairs(found: NearPairs) -> DataFrame:
    """One row, ``n``: pairs of rows in equal or linked classes, from the sizes of the classes."""
    sizes = found.members.groupBy("rep").agg(F.count("*").alias("n"))
    a, b = (sizes.select(F.col("rep").alias(f"id_{k}"), F.col("n").alias(f"n_{k}")) for k in "ab")
    links = found.pairs.join(a, "id_a").join(b, "id_b").selectExpr("n_a * n_b AS n")
    return sizes.selectExpr("n * (n - 1) div 2 AS n").union(links).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def dedup_summary(rows: DataFrame, exact: DataFrame, near: DataFrame, pairs: DataFrame, stop_above: float = 0.01) -> DataFrame:
    """One row: rows, rows affected exactly, nearly and in either way, pairs (``pairs`` has their number ``n``),
    and whether the share of affected rows is too large."""
    either = exact.union(near).distinct().agg(F.count("*").alias("afetadas_uniao"))
    one = rows.agg(F.count("*").alias("total_corpus_bruto"), F.count_if(F.col("text").isNull()).alias("linhas_com_text_nulo"))
    for df, name in ((exact, "afetadas_exatas"), (near, "afetadas_near")):
        one = one.join(F.broadcast(df.agg(F.count("*").alias(name))))
    one = one.join(F.broadcast(pairs.select(F.col("n").alias("pares_near_encontrados"))))
    share = F.coalesce(F.try_divide("afetadas_uniao", "total_corpus_bruto"), F.lit(0.0))
    return one.join(F.broadcast(either)).withColumn("pct_corpus_afetado", share).withColumn("parada_acionada", share > stop_above)
