"""Queries of the corpus-preparation operators over the tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import category_name, valid_date
from ..session import cut, table
from . import chosen_path, mixing, overlap, quality, quotas, radix, subjects, terms, tokens


def _articles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "articles", spread=True)


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return _articles(spark, folder).select(F.col("article_id").alias("id"), "text")


def _above(per_mille: int) -> Callable[[Column, int], Column]:
    return lambda records, total: records * F.lit(1000) > F.lit(total * per_mille)


def p2_terms(spark: SparkSession, folder: str) -> DataFrame:
    """All words and category names with their counts and marks."""
    articles = _articles(spark, folder)
    words = terms.marked_terms(articles.select("text"), "text", lambda n, _: n <= 2, _above(250))
    names = terms.marked_terms(
        articles.select(category_name(F.col("category"))), "category", lambda n, total: n * 1000 < F.lit(total), _above(50), terms.whole_value
    )
    return words.union(names)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_terms(spark, folder).filter("mark is not null").select("field", "term", "mark")


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "subject_labels").select(F.col("article_id").alias("id"), "subject")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.subjects_of(_texts(spark, folder), _labels(spark, folder)).withColumnRenamed("id", "article_id")


def p3_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Articles by category name and subject."""
    found = subjects.subjects_of(_texts(spark, folder), _labels(spark, folder))
    rows = _articles(spark, folder).select(F.col("article_id").alias("id"), category_name(F.col("category")).alias("category"))
    return rows.join(found, "id", "left").groupBy("category", "subject").agg(F.count("*").alias("articles"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return chosen_path.duplicate_pairs(chosen_path.near_duplicates(_texts(spark, folder)))


def p4_links(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of different texts, each by the least id of its rows, and their similarity."""
    return chosen_path.near_duplicates(_texts(spark, folder)).links.withColumn("similarity", F.round("similarity", 8))


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    docs = _texts(spark, folder)
    return chosen_path.duplicate_groups(docs, chosen_path.near_duplicates(docs))


def _formats(spark: SparkSession, folder: str) -> radix.FormatDuplicates:
    key = radix.canonical_record(F.col("link"), F.col("title"), F.col("text"))
    return radix.format_duplicates(_articles(spark, folder).select(F.col("article_id").alias("id"), key.alias("key")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return radix.copies_of(_formats(spark, folder))


def p5_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row per distinct record: the least id and the number of copies."""
    return _formats(spark, folder).groups.select(F.col("first_id").alias("article_id"), "copies")


def _split_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = _articles(spark, folder).select(F.col("article_id").alias("id"), "text", "category", valid_date(F.col("date")).alias("day"))
    return rows.withColumn("split", F.explode(overlap.split_names(F.col("day"), table(spark, folder, "split_periods"))))


def _overlaps(spark: SparkSession, folder: str) -> DataFrame:
    rows = _split_rows(spark, folder)
    train = rows.filter("split = 'train'").select("id", "text")
    other = rows.filter("split in ('valid', 'test')").select("id", "text")
    return overlap.overlap_pairs(overlap.overlaps(train, other))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _overlaps(spark, folder).select(
        F.least("train_id", "evaluation_id").alias("id_a"), F.greatest("train_id", "evaluation_id").alias("id_b")
    )


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, overlapping rows and pairs by evaluation split and category name."""
    pairs = _overlaps(spark, folder).groupBy(F.col("evaluation_id").alias("id")).agg(
        F.count("*").alias("pairs"), F.max((F.col("similarity") == 1).cast("int")).alias("same")
    )
    rows = _split_rows(spark, folder).filter("split <> 'train'").select("id", "split", category_name(F.col("category")).alias("category"))
    return (
        rows.join(pairs, "id", "left")
        .groupBy("split", "category")
        .agg(
            F.count("*").alias("rows"),
            F.count("pairs").alias("overlapping_rows"),
            F.coalesce(F.sum("same"), F.lit(0)).cast("long").alias("rows_with_equal_shingles"),
            F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"),
        )
    )


def _eligible(spark: SparkSession, folder: str) -> DataFrame:
    return (
        _articles(spark, folder)
        .filter("category is not null")
        .select(F.col("article_id").alias("id"), F.year(valid_date(F.col("date"))).alias("year"), category_name(F.col("category")).alias("name"))
        .filter("year is not null")
    )


def _quotas(spark: SparkSession, folder: str) -> DataFrame:
    targets = table(spark, folder, "category_targets").withColumn("name", category_name(F.col("category")))
    return quotas.quotas(_eligible(spark, folder), targets)


def _drawn(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Quotas and the rows drawn for them."""
    quota = cut(_quotas(spark, folder), "quotas")
    return quota, quotas.draw(_eligible(spark, folder), quota)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return quotas.unmet(quotas.report(*_drawn(spark, folder))).select("target_set", "category")


def p7_quotas(spark: SparkSession, folder: str) -> DataFrame:
    """Every target with its quota, the rows drawn for it and its shortfall."""
    return quotas.report(*_drawn(spark, folder))


def p7_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The drawn rows: target_set, category, article_id."""
    return _drawn(spark, folder)[1].withColumnRenamed("id", "article_id")


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", spread=True).withColumnRenamed("doc_id", "id")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode(_documents(spark, folder).select("id", "text")).withColumnRenamed("id", "doc_id")


def _sizes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Token counts of the documents of listed sources, and the targets (a fixed small table)."""
    targets = table(spark, folder, "source_targets")
    docs = _documents(spark, folder).select("id", "source", "text").join(targets.select("source").distinct(), "source", "left_semi")
    return tokens.token_counts(docs), targets


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.short_sources(mixing.mix_sources(*_sizes(spark, folder)))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the mix with their number of copies."""
    return mixing.mix_sources(*_sizes(spark, folder)).copies.withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Wanted and actual shares of the sources in the mix."""
    return mixing.mix_sources(*_sizes(spark, folder)).shares


def p10_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of every document, with its kind if it is not prose."""
    return quality.text_statistics(_documents(spark, folder)).withColumnRenamed("id", "doc_id")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_stats(spark, folder).filter("kind is not null").select("doc_id", "kind")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p2_terms": p2_terms,
    "p3_found": p3_found,
    "p3_composition": p3_composition,
    "p4_found": p4_found,
    "p4_groups": p4_groups,
    "p4_links": p4_links,
    "p5_found": p5_found,
    "p5_records": p5_records,
    "p6_found": p6_found,
    "p6_report": p6_report,
    "p7_found": p7_found,
    "p7_quotas": p7_quotas,
    "p7_sample": p7_sample,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_stats": p10_stats,
}
