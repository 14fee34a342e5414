"""Deterministic samples by random keys, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLOT_BITS = 16


def random_key(id_column: Column, seed: str) -> Column:
    """60 random bits of an id, reproducible in any engine that has md5."""
    digest = F.md5(F.concat(F.lit(seed), id_column.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def smallest_keys(keyed: DataFrame, groups: list[str], quota: str) -> DataFrame:
    """Of each group the ``quota`` rows with the smallest ``key`` (ties by ``id``).

    Rows are counted by the leading bits of their key; the slot that holds a group's last row
    follows from these counts, and only its rows are ranked. A group may hold any share of the
    rows. ``key`` has 60 bits; rows with null or non-positive quota are dropped.
    """
    rows = keyed.filter(F.col(quota) > 0).withColumn("__slot", F.shiftrightunsigned("key", 60 - SLOT_BITS))
    slots = rows.groupBy(*groups, quota, "__slot").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.partitionBy(*groups).orderBy("__slot")) - F.col("__n")
    last = (
        slots.withColumn("__before", before)
        .filter((F.col("__before") < F.col(quota)) & (F.col("__before") + F.col("__n") >= F.col(quota)))
        .select(*(F.col(g).alias(f"__{g}") for g in groups), F.col("__slot").alias("__last"), "__before")
    )
    same = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in groups]
    marked = rows.join(last, same, "left")
    inside = marked.filter("__last is null or __slot < __last").select(*keyed.columns)
    edge = (
        marked.filter("__slot = __last")
        .withColumn("__rank", F.row_number().over(W.partitionBy(*groups).orderBy("key", "id")))
        .filter(F.col("__rank") <= F.col(quota) - F.col("__before"))
        .select(*keyed.columns)
    )
    return inside.union(edge)
