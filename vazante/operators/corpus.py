"""Corpus preparation: row ids, null filter, exact de-duplication, rollups, class tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

_IN_PARTITION = (1 << 33) - 1


def numbered(df: DataFrame, order: list, name: str = "id_raw") -> DataFrame:
    """Global row numbers from 0 in the given order, without moving all rows to one task.

    Rows are range-partitioned and sorted; a partition's offset is the number of rows before it.
    The order should be total; rows that compare equal are numbered arbitrarily.
    """
    placed = cut(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered"
    )
    part = F.shiftrightunsigned("__at", 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    rows = [(r[0], r[1]) for r in counts.orderBy("__part").collect()]  # one row a partition
    offsets, total = [], 0
    for p, n in rows:
        offsets.append((p, total))
        total += n
    table = df.sparkSession.createDataFrame(offsets, "__part long, __offset long")
    return (
        placed.withColumn("__part", part)
        .join(F.broadcast(table), "__part")
        .withColumn(name, F.col("__offset") + F.col("__at").bitwiseAND(F.lit(_IN_PARTITION)))
        .drop("__part", "__at", "__offset")
    )


def prepared(articles: DataFrame, with_text: bool = False) -> DataFrame:
    """Rows with day and text: ``id_raw`` is the place by (day, link, article_id), nulls last, before the filter.

    Only the keys are sorted; ``with_text`` joins title and text to the result.
    """
    order = [F.col(c).asc_nulls_last() for c in ("day", "link", "article_id")]
    keys = articles.select("article_id", "day", "link", F.col("category").alias("y_original"), F.col("text").isNotNull().alias("has_text"))
    rows = numbered(keys, order).filter("day is not null and has_text").drop("has_text")
    return rows.join(articles.select("article_id", "title", "text"), "article_id") if with_text else rows


def without_copies(corpus: DataFrame) -> DataFrame:
    """The earliest row (day, link, id) of each text, ``eh_duplicata_text`` if the text had several rows.

    One aggregation by a digest of the text, so copies are combined before the shuffle. ``corpus`` has
    ``id, day, link, y_original, text``; rows without text are not texts and are left out.
    """
    first = F.min(
        F.struct(F.col("day").isNull().alias("no_day"), "day", F.col("link").isNull().alias("no_link"), "link", "id", "y_original")
    )
    return (
        corpus.filter("text is not null")
        .groupBy(F.sha2("text", 256).alias("digest"))
        .agg(first.alias("f"), F.count("*").alias("n"))
        .select("f.id", "f.day", "f.link", "f.y_original", (F.col("n") >= 2).alias("eh_duplicata_text"))
    )


def class_table(corpus: DataFrame, threshold: int, without: Sequence[str] = ()) -> DataFrame:
    """``classe, n, frac`` of the classes with at least ``threshold`` rows, except some."""
    counts = corpus.filter("y_original is not null").groupBy(F.col("y_original").alias("classe")).agg(F.count("*").alias("n"))
    kept = counts.filter((F.col("n") >= threshold) & ~F.col("classe").isin(list(without)))
    total = kept.agg(F.sum("n").alias("total"))
    return kept.join(F.broadcast(total)).select("classe", "n", (F.col("n") / F.col("total")).alias("frac"))


def rollup_threshold(corpus: DataFrame, threshold: int, without: Sequence[str] = ("colunas", "ilustrada")) -> DataFrame:
    """Rows of frequent classes except some; ``y_colapsado`` is the class itself."""
    kept = class_table(corpus, threshold, without).select(F.col("classe").alias("y_original"))
    return corpus.join(kept, "y_original").withColumn("y_colapsado", F.col("y_original"))


def rollup_anchors(corpus: DataFrame, threshold: int, anchors: Sequence[str]) -> DataFrame:
    """Rows of frequent classes; those that are no anchor become ``outros``."""
    kept = class_table(corpus, threshold).select(F.col("classe").alias("y_original"))
    label = F.when(F.col("y_original").isin(list(anchors)), F.col("y_original")).otherwise("outros")
    return corpus.join(kept, "y_original").withColumn("y_colapsado", label)


def rollup_fixed(corpus: DataFrame, classes: Sequence[str]) -> DataFrame:
    return corpus.filter(F.col("y_original").isin(list(classes))).withColumn("y_colapsado", F.col("y_original"))


def binary_labels(rollup: DataFrame, positive: str) -> DataFrame:
    """``y_colapsado`` reduced to the positive class and its complement."""
    label = F.when(F.col("y_colapsado") == positive, positive).otherwise(f"nao_{positive}")
    return rollup.withColumn("y_colapsado", label)


def viable_classes(corpus: DataFrame, least: int = 2) -> DataFrame:
    """``classe, n_textos, viavel``: whether a class has at least ``least`` texts."""
    counts = corpus.filter("y_original is not null").groupBy(F.col("y_original").alias("classe")).agg(F.count("text").alias("n_textos"))
    return counts.withColumn("viavel", F.col("n_textos") >= least)
