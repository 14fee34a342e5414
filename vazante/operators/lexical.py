"""Vocabulary of groups of documents: frequent tokens, TF-IDF, overlap and drift."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import jaccard
from ..functions.text import letter_tokens, tokens
from ..session import cut
from .sampling import random_key, smallest_keys


MOST_TERMS = 1_000_000  # of a vocabulary that is broadcast


def token_counts(docs: DataFrame, group: str | None = None, words: Column | None = None) -> DataFrame:
    """``[group,] token, n`` over ``docs``; by default all words without stop words of ``text``."""
    by = [group] if group else []
    rows = docs.select(*by, F.explode(tokens(F.col("text")) if words is None else words).alias("token"))
    return rows.groupBy(*by, "token").agg(F.count("*").alias("n"))


def top_tokens(docs: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent tokens (ties alphabetically)."""
    return token_counts(docs).orderBy(F.desc("n"), "token").limit(k)


def top_tokens_by(docs: DataFrame, group: str, k: int) -> DataFrame:
    """``group, rank, token, freq`` of the ``k`` most frequent letter tokens of each group."""
    counts = token_counts(docs, group, letter_tokens(F.col("text")))
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.desc("n"), "token"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k).select(group, "rank", "token", F.col("n").alias("freq"))


def text_statistics(docs: DataFrame, group: str) -> DataFrame:
    """Mean characters and letter tokens of title and text by group; a null counts as empty."""

    def length(c: str) -> Column:
        return F.coalesce(F.length(c), F.lit(0))

    return docs.groupBy(group).agg(
        F.count("*").alias("n_documentos"),
        F.avg(length("title")).alias("comprimento_medio_titulo_chars"), F.avg(F.size(letter_tokens(F.col("title")))).alias("comprimento_medio_titulo_tokens"),
        F.avg(length("text")).alias("comprimento_medio_texto_chars"), F.avg(F.size(letter_tokens(F.col("text")))).alias("comprimento_medio_texto_tokens"),
    )


def sample_by_category(docs: DataFrame, n: int, seed: str) -> DataFrame:
    """At most ``n`` rows ``id, category, text`` a category, those with the smallest random keys."""
    rows = docs.filter("category is not null and text is not null").select("id", "category", "text")
    keyed = rows.select("id", "category", random_key(F.col("id"), seed).alias("key"), F.lit(n).alias("quota"))
    return smallest_keys(keyed, ["category"], "quota").select("id", "category").join(rows.select("id", "text"), "id")


def _unit_sums(words: DataFrame, idf: DataFrame) -> DataFrame:
    """``category, token, s``: sums over documents ``words(category, tokens)`` of their weights at unit length.

    Where the weighed vocabulary has at most MOST_TERMS terms it is sent to all tasks, which then need each document
    only once and hand on sums; a larger one is joined.
    """
    if idf.count() > MOST_TERMS:
        place = words.withColumn("id", F.monotonically_increasing_id())
        tf = place.select("id", "category", F.explode("tokens").alias("token")).groupBy("id", "category", "token").agg(F.count("*").alias("tf"))
        weighed = tf.join(idf, "token").withColumn("w", F.col("tf") * F.col("idf"))
        norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("id")))  # a document's tokens
        return weighed.withColumn("unit", F.col("w") / norm).groupBy("category", "token").agg(F.sum("unit").alias("s"))
    sent = words.sparkSession.sparkContext.broadcast({r["token"]: r["idf"] for r in idf.collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            codes, terms = pd.factorize(lists.flatten().to_numpy(zero_copy_only=False))
            weight = np.array([sent.value.get(t, 0.0) for t in terms])
            kinds, names = pd.factorize(np.array(batch.column(0).to_pylist(), dtype=object))
            if not len(codes) or not weight.any():
                continue
            cell, tf = np.unique(doc * len(terms) + codes, return_counts=True)
            doc, code = cell // len(terms), cell % len(terms)
            w = tf * weight[code]
            norm = np.sqrt(np.bincount(doc, w * w, batch.num_rows))[doc]
            used = w > 0
            key, at = np.unique(kinds[doc[used]] * len(terms) + code[used], return_inverse=True)
            s = np.bincount(at, w[used] / norm[used])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.asarray(names, object)[key // len(terms)], pa.string()), pa.array(np.asarray(terms, object)[key % len(terms)], pa.string()), pa.array(s)], ["category", "token", "s"]
            )

    return words.mapInArrow(run, "category string, token string, s double").groupBy("category", "token").agg(F.sum("s").alias("s"))


def tfidf_top(docs: DataFrame, k: int = 30, min_df: int = 2, max_df: float = 0.95) -> DataFrame:
    """``categoria, rank, token, tfidf_mean`` of the highest mean weights in each category of ``docs(id, category, text)``.

    Weights are counts times ln((1+N)/(1+df))+1, scaled to unit length by document; the mean is over all
    documents of the category, those without the token included.
    """
    sizes = docs.groupBy("category").agg(F.count("*").alias("docs"))
    words = cut(docs.select("category", letter_tokens(F.col("text")).alias("tokens")), "words")
    total = words.count()
    df = words.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    idf = cut(df.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * total)).select("token", (F.log((1 + F.lit(total)) / (1 + F.col("df"))) + 1).alias("idf")), "idf")
    sums = _unit_sums(words, idf)
    mean = sums.join(sizes, "category").select(F.col("category").alias("categoria"), "token", F.round(F.col("s") / F.col("docs"), 10).alias("tfidf_mean"))
    rank = F.row_number().over(W.partitionBy("categoria").orderBy(F.desc("tfidf_mean"), "token"))
    return mean.withColumn("rank", rank).filter(F.col("rank") <= k).select("categoria", "rank", "token", "tfidf_mean")


def overlap_with(top: DataFrame, reference: str) -> DataFrame:
    """Jaccard, shared and reference-only tokens of each other category against ``reference``.

    ``top`` holds a bounded number of tokens a category, so a category is one array.
    """
    sets = top.groupBy("categoria").agg(F.sort_array(F.collect_set("token")).alias("t"))
    ref = sets.filter(F.col("categoria") == reference).select(F.col("t").alias("r"))
    both = sets.filter(F.col("categoria") != reference).join(F.broadcast(ref))
    return both.select(
        F.col("categoria").alias("categoria_vs"), jaccard(F.col("t"), F.col("r")).alias("jaccard_top30"),
        F.array_join(F.sort_array(F.array_intersect("r", "t")), ";").alias("tokens_compartilhados"),
        F.array_join(F.sort_array(F.array_except("r", "t")), ";").alias("tokens_exclusivos_referencia"),
    )


def overlap_with_all(overlap: DataFrame, viable: DataFrame, reference: str) -> DataFrame:
    """The overlap of every class with the number of its texts; classes with too few texts have nulls."""
    return (
        viable.filter(F.col("classe") != reference)
        .join(overlap.withColumnRenamed("categoria_vs", "classe"), "classe", "left")
        .select(F.col("classe").alias("categoria_vs"), "n_textos", "viavel", "jaccard_top30")
    )


def consecutive_jaccard(top: DataFrame, group: str) -> DataFrame:
    """Jaccard of the token sets of neighbouring groups, in order."""
    sets = top.groupBy(group).agg(F.collect_set("token").alias("t"))
    order = W.partitionBy().orderBy(group)  # one row a period
    pairs = sets.select(group, "t", F.lag(group).over(order).alias("before"), F.lag("t").over(order).alias("b")).filter("before is not null")
    return pairs.select(F.col("before").alias(f"{group}_anterior"), F.col(group).alias(f"{group}_atual"), jaccard(F.col("b"), F.col("t")).alias("jaccard_top50"))


def psi_by(counts: DataFrame, group: str, k: int = 200, floor: float = 1e-6) -> DataFrame:
    """Population stability index of each group against the first, over the ``k`` most frequent tokens.

    Shares are floored at ``floor``; a group without any of the tokens has shares of 0.
    """
    vocabulary = counts.groupBy("token").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "token").limit(k).select("token")
    groups = counts.select(group).distinct()
    grid = groups.join(F.broadcast(vocabulary.agg(F.collect_list("token").alias("ts")))).select(group, F.explode("ts").alias("token"))
    cells = grid.join(counts, [group, "token"], "left").fillna(0, ["n"])
    share = F.coalesce(F.try_divide(F.col("n"), F.sum("n").over(W.partitionBy(group))), F.lit(0.0))
    shares = cells.select(group, "token", F.greatest(share, F.lit(floor)).alias("o"))
    base = shares.join(F.broadcast(groups.agg(F.min(group).alias(group))), group).select("token", F.col("o").alias("e"))
    return shares.join(F.broadcast(base), "token").groupBy(group).agg(F.sum((F.col("o") - F.col("e")) * F.log(F.col("o") / F.col("e"))).alias("psi_top200"))
