"""Records of evaluation splits that also appear, exactly or almost, in the training split.

Texts are canonicalised to their lower-cased words. Each gets one hash of the whole record and
hashes of samples of its shingles (a chosen number of MinHash coordinates each, in as many
independent samples as the target recall asks for). Evaluation hashes are joined with training
hashes: equal whole-record hashes by an equi-join, sampled hashes bucket by bucket, only across
the sides. A hash that many records of both sides share is split by further coordinates and at
last into blocks, as in the chosen-path join. A pair that meets is verified exactly. Equal records
enter once a side, so copies don't multiply in the join; matches are expanded to rows and counted
by split and category at the end.

Rows without valid date, outside all periods, or whose text is null, blank or shorter than the
fewest words have no overlap. A row in several periods counts in each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import chosen_path
from .chosen_path import JoinSettings

MOST_PERIODS = 1000


def split_names(day: Column, periods: DataFrame) -> Column:
    """Names of the periods that hold ``day``; the period table is checked to be small."""
    rows = periods.select("split", F.col("date_from").cast("date"), F.col("date_to").cast("date")).limit(MOST_PERIODS + 1).collect()
    if len(rows) > MOST_PERIODS:
        raise ValueError(f"more than {MOST_PERIODS} periods")
    names = [F.when((day >= F.lit(r[1])) & (day < F.lit(r[2])), F.lit(r[0])) for r in rows if None not in r]
    return F.array_distinct(F.array_compact(F.array(*names))) if names else F.array().cast("array<string>")


@dataclass(frozen=True)
class Overlaps:
    """links: rep_a (train), rep_b (evaluation), similarity; train, evaluation: rep, id."""

    links: DataFrame
    train: DataFrame
    evaluation: DataFrame


def _side(docs: DataFrame, settings: JoinSettings, name: str) -> tuple[DataFrame, DataFrame]:
    prints = cut(chosen_path.fingerprints(docs, settings), name)
    return prints, cut(chosen_path.classes_of(prints), f"{name}-classes")


def overlaps(train: DataFrame, evaluation: DataFrame, settings: JoinSettings = JoinSettings()) -> Overlaps:
    """Overlaps between ``train(id, text)`` and ``evaluation(id, text)``."""
    prints_t, classes_t = _side(train, settings, "train")
    prints_e, classes_e = _side(evaluation, settings, "evaluation")
    sides = [chosen_path.sets_of(p).withColumn("side", F.lit(k)) for k, p in enumerate((prints_t, prints_e))]
    met = chosen_path.candidates(sides[0].union(sides[1]), settings).select(F.col("a").alias("c1_t"), F.col("b").alias("c1_e"))
    whole = classes_t.select(F.col("c1").alias("c1_t")).join(classes_e.select(F.col("c1").alias("c1_t")), "c1_t").select("c1_t", F.col("c1_t").alias("c1_e"))
    a, b = classes_t.alias("a"), classes_e.alias("b")
    pairs = (
        met.union(whole)
        .distinct()
        .join(a, F.col("c1_t") == F.col("a.c1"))
        .join(b, F.col("c1_e") == F.col("b.c1"))
        .filter(chosen_path.same_nibbles("a", "b") >= chosen_path.nibble_bound(settings.threshold))
        .select(F.col("a.rep").alias("rep_a"), F.col("b.rep").alias("rep_b"))
    )
    docs = train.union(evaluation).filter("text is not null")
    links = cut(chosen_path.verify(pairs, docs, settings).distinct(), "overlaps")
    members = [p.select("id", "c1", "c2").join(c.select("c1", "c2", "rep"), ["c1", "c2"]).select("rep", "id") for p, c in ((prints_t, classes_t), (prints_e, classes_e))]
    return Overlaps(links, *members)


def overlap_pairs(found: Overlaps) -> DataFrame:
    """``train_id, evaluation_id, similarity`` of all overlapping rows."""
    t = found.train.select(F.col("rep").alias("rep_a"), F.col("id").alias("train_id"))
    e = found.evaluation.select(F.col("rep").alias("rep_b"), F.col("id").alias("evaluation_id"))
    return found.links.join(t, "rep_a").join(e, "rep_b").select("train_id", "evaluation_id", "similarity")
