"""Occurrences and record counts of every distinct term, with marks on the rare and the common.

Each task counts the terms of its records in a hash table of bounded size and hands on one
row a term (more only if the table had to be emptied), so the shuffle carries distinct terms
of a task, not tokens: a term that fills a third of all text is one row a task. A second
aggregation sums them. Bounds are then applied to the record counts.

Null values are in no record; an empty text is a record without terms; an empty table gives no
terms. Every record counts, repeated ones too.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .sketch import words_of

COUNT = "term string, occurrences long, records long"
TABLE_LIMIT = 400_000


def whole_value(value: str) -> list[str]:
    return [value]


def count_terms(values: DataFrame, split: Callable[[str], list[str]] = words_of) -> DataFrame:
    """COUNT rows of the single string column of ``values``; the null term carries the number of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, where, records = Counter(), Counter(), 0

        def given() -> pa.RecordBatch:
            terms = list(total)
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array([None, *terms], pa.string()),
                    pa.array([0, *(total[t] for t in terms)], pa.int64()),
                    pa.array([records, *(where[t] for t in terms)], pa.int64()),
                ],
                ["term", "occurrences", "records"],
            )
            total.clear()
            where.clear()
            return batch

        for batch in batches:
            for value in batch.column(0).to_pylist():
                if value is None:
                    continue
                records += 1
                terms = split(value)
                total.update(terms)
                where.update(set(terms))
                if len(total) > TABLE_LIMIT:
                    yield given()
                    records = 0
        yield given()

    return (
        values.mapInArrow(run, COUNT)
        .groupBy("term")
        .agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    )


def marked_terms(
    values: DataFrame, name: str, rare: Callable[[Column, int], Column], common: Callable[[Column, int], Column], split: Callable[[str], list[str]] = words_of
) -> DataFrame:
    """``field, term, occurrences, records, mark``: rare and common get a term's records and the number of records."""
    counts = cut(count_terms(values, split), "terms")
    total = counts.filter("term is null").agg(F.sum("records")).first()[0] or 0
    mark = F.when(rare(F.col("records"), total), "rare").when(common(F.col("records"), total), "common")
    return counts.filter("term is not null").select(F.lit(name).alias("field"), "term", "occurrences", "records", mark.alias("mark"))
