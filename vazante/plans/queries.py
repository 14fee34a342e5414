"""Queries of the core operators over the tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rows
from ..session import table
from . import corpus, evaluation, learning, temporal


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return rows.rejected_rows(table(spark, folder, "articles_raw"), "raw_line", rows.ARTICLE_ROW).select("line_id", "reason")


def p1_loaded(spark: SparkSession, folder: str) -> DataFrame:
    """The valid records as article rows."""
    valid = rows.valid_rows(table(spark, folder, "articles_raw"), "raw_line", rows.ARTICLE_ROW)
    return valid.select("line_id", *(f.name for f in rows.ARTICLE_ROW.fields))


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    """Rejected records by file, reason and broken field."""
    bad = rows.rejected_rows(table(spark, folder, "articles_raw"), "raw_line", rows.ARTICLE_ROW)
    return bad.groupBy("file_name", "reason", "broken_field").agg(F.count("*").alias("records"))


PARTS = [temporal, corpus, evaluation, learning]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_loaded": p1_loaded,
    "p1_report": p1_report,
}
for _part in PARTS:
    QUERIES |= _part.QUERIES
