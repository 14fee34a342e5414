"""Schemas of the pipeline's tables and the check for required columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

RAW_COLUMNS = ("title", "text", "date", "category", "subcategory", "link")
RAW_ARTICLES = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])

POSITIVE = "mercado"
#: The anchor classes of the eight-class and five-class rollups.
ANCHORS = ("poder", "colunas", "mercado", "esporte", "mundo", "cotidiano", "ilustrada")
FIVE = ("poder", "mercado", "esporte", "mundo", "cotidiano")


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``df`` itself, or a ValueError that names the columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df
