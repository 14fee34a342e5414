"""Classifier metrics from predictions, by fold.

Predictions have ``fold, y_true, y_pred`` and a map ``scores``; a null prediction is none, so it counts
as missed for its true class and as predicted for no other.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut


def confusion(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("fold", "y_true", "y_pred").agg(F.count("*").alias("n"))


def fold_metrics(predictions: DataFrame, positive: str) -> DataFrame:
    """``f1_binario_projetado``, ``macro_f1`` over the classes seen in any fold, ``n_teste, n_mercado_teste``.

    Everything follows from the confusion counts. A class without any true or predicted row scores 0.
    """
    counts = confusion(predictions)
    cells = counts.select("fold", F.explode(F.array(
        F.struct(F.col("y_true").alias("classe"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("y_pred").alias("classe"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("tp")),
    )).alias("c"))
    each = cells.filter("c.classe is not null").groupBy("fold", "c.classe").agg(F.sum("c.t").alias("t"), F.sum("c.p").alias("p"), F.sum("c.tp").alias("tp"))
    each = each.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("tp"), F.col("t") + F.col("p")), F.lit(0.0)))
    classes = each.select("classe").distinct().agg(F.count("*").alias("classes"))
    of_fold = each.groupBy("fold").agg(
        F.coalesce(F.max(F.when(F.col("classe") == positive, F.col("f1"))), F.lit(0.0)).alias("f1_binario_projetado"),
        F.sum("f1").alias("sum_f1"), F.sum("t").alias("n_teste"),
        F.coalesce(F.max(F.when(F.col("classe") == positive, F.col("t"))), F.lit(0)).alias("n_mercado_teste"),
    )
    return of_fold.join(F.broadcast(classes)).select("fold", "f1_binario_projetado", (F.col("sum_f1") / F.col("classes")).alias("macro_f1"), "n_teste", "n_mercado_teste")


def running_totals(rows: DataFrame, group: str, order: str, values: list[str]) -> DataFrame:
    """Inclusive running sums of ``values`` within ``group`` by falling ``order``, across all partitions.

    Rows are range-partitioned; a partition sums its own rows, and what precedes it in its group is added
    from one total a partition and group.
    """
    ranged = cut(rows.repartitionByRange(F.col(group), F.col(order).desc()).withColumn("__part", F.spark_partition_id()), "ranged")
    inside = W.partitionBy("__part", group).orderBy(F.col(order).desc()).rowsBetween(W.unboundedPreceding, 0)
    totals = ranged.groupBy("__part", group).agg(*(F.sum(v).alias(v) for v in values))
    earlier = W.partitionBy(group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select("__part", group, *(F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"__{v}") for v in values))
    return (
        ranged.join(before, ["__part", group])
        .select(*rows.columns, *((F.sum(v).over(inside) + F.col(f"__{v}")).alias(f"total_{v}") for v in values))
    )


def pr_auc(predictions: DataFrame, positive: str) -> DataFrame:
    """``fold, pr_auc``: area under the precision-recall curve by trapezoids, from recall 0 at precision 1.

    Rows without a score of the class are left out; a fold with one class only has null.
    """
    score = F.try_element_at("scores", F.lit(positive))
    rows = predictions.select("fold", score.alias("score"), (F.col("y_true") == positive).cast("long").alias("pos")).filter("score is not null and pos is not null")
    points = rows.groupBy("fold", "score").agg(F.sum("pos").alias("tp"), F.count("*").alias("n"))
    sums = running_totals(points, "fold", "score", ["tp", "n"])
    whole = points.groupBy("fold").agg(F.sum("tp").alias("positives"), F.sum("n").alias("all"))
    # a point and its predecessor, which has the same sums less the point's own
    p1, t1 = F.col("total_tp") / F.col("total_n"), F.col("total_tp") - F.col("tp")
    p0 = F.coalesce(F.try_divide(t1, F.col("total_n") - F.col("n")), F.lit(1.0))
    area = sums.groupBy("fold").agg(F.sum(F.col("tp") * (p1 + p0) / 2).alias("area"))
    value = F.when((F.col("positives") > 0) & (F.col("positives") < F.col("all")), F.col("area") / F.col("positives"))
    return area.join(F.broadcast(whole), "fold").select("fold", value.alias("pr_auc"))


def false_positives(predictions: DataFrame, positive: str) -> DataFrame:
    """Original classes of the rows wrongly predicted positive."""
    wrong = predictions.filter((F.col("y_pred") == positive) & (F.col("y_true") != positive))
    return wrong.groupBy("fold", "y_original").agg(F.count("*").alias("n"))


def bootstrap(values: list[float], n: int = 1000, seed: int = 2026) -> dict[str, float | None]:
    """Mean, deviation and percentile interval of a few values; of none: nulls, of one: deviation 0."""
    kept = np.array([v for v in values if v is not None], float)
    if not len(kept):
        return {"media": None, "dp": None, "ic_95_inf": None, "ic_95_sup": None}
    means = np.random.default_rng(seed).choice(kept, size=(n, len(kept)), replace=True).mean(axis=1)
    low, high = np.percentile(means, [2.5, 97.5])
    return {"media": float(kept.mean()), "dp": float(kept.std(ddof=1)) if len(kept) > 1 else 0.0, "ic_95_inf": float(low), "ic_95_sup": float(high)}


def cross_fold(metrics: DataFrame, columns: list[str], most_folds: int = 10_000) -> DataFrame:
    """``metrica, media, dp, ic_95_inf, ic_95_sup`` over the folds; their number is checked."""
    rows = metrics.select("fold", *columns).limit(most_folds + 1).collect()
    if len(rows) > most_folds:
        raise ValueError(f"more than {most_folds} folds")
    rows.sort(key=lambda r: r["fold"])
    out = [(c, *bootstrap([r[c] for r in rows]).values()) for c in columns]
    return metrics.sparkSession.createDataFrame(out, "metrica string, media double, dp double, ic_95_inf double, ic_95_sup double")
