"""A sample whose shares of categories match target proportions.

Eligible rows of each category are counted; integer quotas follow from the target percentages by
the largest remainder, with least rows for small categories and caps at what is available; what
capped categories leave goes to the others by the same rule. The rows with the smallest random
keys of each category are drawn. A report names the targets that could not be met.

Selecting the smallest keys needs no sort of a category: rows are counted by the leading bits
of their key, the bucket that holds the last drawn row is found from these counts, and only
that bucket is ranked. A category that holds a third of all rows is spread like any other.

Targets are grouped by target set; a set's targets must fit one task (they are checked). Rows
with null category or without valid date are not eligible. Equal keys are told apart by id.
"""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sampling import random_key, smallest_keys
from ..session import cut

MOST_TARGETS = 100_000
QUOTA = "target_set string, target_year int, category string, name string, target_pct int, min_rows int, sample_rows long, available long, wanted long, quota long"


def allocate(size: int, shares: list[int], least: list[int], available: list[int]) -> list[int]:
    """Integer quotas that add up to ``size`` where availability allows.

    Every target first gets its least rows (as far as available and ``size`` goes, in order). The
    ideal quota of each is its share of ``size``; targets whose ideal lies below their floor keep the
    floor, those whose ideal lies above what is available are capped, and the rest is shared out
    among the others in proportion, by largest remainder (ties: first target).
    """
    n = len(shares)
    floor = []
    left = size
    for k in range(n):
        floor.append(min(least[k], available[k], left))
        left -= floor[k]
    fixed: dict[int, int] = {}
    while True:
        free = [k for k in range(n) if k not in fixed]
        rest = size - sum(fixed.values())
        weight = sum(shares[k] for k in free)
        if not free or not weight:
            break
        ideal = {k: Fraction(rest * shares[k], weight) for k in free}
        low = [k for k in free if ideal[k] < floor[k]]
        high = [k for k in free if ideal[k] > available[k]]
        under = sum(floor[k] - ideal[k] for k in low)
        over = sum(ideal[k] - available[k] for k in high)
        if not low and not high:
            break
        for k in low if under >= over and low else high:
            fixed[k] = floor[k] if under >= over and low else available[k]
    quota = [fixed.get(k, 0) for k in range(n)]
    if free and weight:
        whole = {k: int(ideal[k]) for k in free}
        extra = rest - sum(whole.values())
        for k in sorted(free, key=lambda k: (whole[k] - ideal[k], k)):
            add = 1 if extra > 0 and whole[k] < available[k] else 0
            quota[k] = whole[k] + add
            extra -= add
        for k in free:  # a remainder that capped targets could not take
            more = min(extra, available[k] - quota[k])
            quota[k] += more
            extra -= more
    else:
        for k in range(n):
            quota[k] = max(quota[k], floor[k])
    return quota


def quotas(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """QUOTA rows for ``targets`` from the eligible ``rows(year, name)``; targets come with ``name``.

    ``wanted`` is the larger of the target share of the sample, rounded up, and the least rows.
    """
    if targets.limit(MOST_TARGETS + 1).count() > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    counts = cut(rows.groupBy("year", "name").agg(F.count("*").alias("available")), "category-counts")
    totals = counts.groupBy("year").agg(F.sum("available").alias("eligible"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["target_pct", "category"], ascending=[False, True], kind="stable").reset_index(drop=True)
        size = int(pdf["sample_rows"].iloc[0])
        pdf["quota"] = allocate(size, pdf["target_pct"].tolist(), pdf["min_rows"].tolist(), pdf["available"].tolist())
        return pdf

    known = (
        targets.select("target_set", "target_year", "sample_pct", "category", "target_pct", "min_rows", "name")
        .filter("target_set is not null and target_year is not null and category is not null")
        .fillna(0, ["target_pct", "min_rows", "sample_pct"])
        .join(counts.withColumnRenamed("year", "target_year"), ["target_year", "name"], "left")
        .join(totals.withColumnRenamed("year", "target_year"), "target_year", "left")
        .fillna(0, ["available", "eligible"])
        .withColumn("sample_rows", F.floor(F.col("eligible") * F.col("sample_pct") / 100).cast("long"))
        .withColumn("wanted", F.greatest(F.ceil(F.col("sample_rows") * F.col("target_pct") / 100), F.col("min_rows")).cast("long"))
        .withColumn("quota", F.lit(0).cast("long"))
        .select("target_set", "target_year", "category", "name", "target_pct", "min_rows", "sample_rows", "available", "wanted", "quota")
    )
    return known.groupBy("target_set").applyInPandas(fill, QUOTA)


def draw(rows: DataFrame, quota: DataFrame, seed: str = "vazante") -> DataFrame:
    """``target_set, category, id`` of the drawn rows: of each target the ``quota`` smallest random keys.

    ``rows(id, year, name)`` are the eligible rows, ``quota`` the result of ``quotas``.
    """
    want = quota.filter("quota > 0").select("target_set", "category", F.col("target_year").alias("year"), "name", "quota")
    keyed = rows.select("id", "year", "name").join(F.broadcast(want), ["year", "name"]).select(
        "target_set", "category", "quota", "id", random_key(F.concat(F.col("target_set"), F.lit(":"), F.col("id")), seed).alias("key")
    )
    return smallest_keys(keyed, ["target_set", "category"], "quota").select("target_set", "category", "id")


def report(quota: DataFrame, drawn: DataFrame) -> DataFrame:
    """``quota`` with the rows ``drawn(target_set, category)`` of each target and its ``shortfall``, 0 if it was met."""
    counts = drawn.groupBy(F.col("target_set").alias("__set"), F.col("category").alias("__category")).agg(F.count("*").alias("__drawn"))
    same = (F.col("target_set") == F.col("__set")) & (F.col("category") == F.col("__category"))
    joined = quota.join(F.broadcast(counts), same, "left").select(*quota.columns, F.coalesce("__drawn", F.lit(0)).alias("drawn"))
    return joined.withColumn("shortfall", F.greatest(F.col("wanted") - F.col("drawn"), F.lit(0)))


def unmet(reported: DataFrame) -> DataFrame:
    """Of the targets that fell short, those for which there are not enough eligible rows; the others gave rows away to
    the rounding of shares or to the least rows of other targets."""
    return reported.filter("shortfall > 0 and available < wanted")
