"""Temporal and stratified splits, subsamples, and leakage of duplicate pairs between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .corpus import numbered
from .duplicates import NearPairs
from .sampling import random_key, smallest_keys


def rolling_folds(rows: DataFrame, folds: int = 5, train_months: int = 18, test_months: int = 3, inner_months: int = 3, check: bool = True) -> DataFrame:
    """``id, fold, papel`` of ``rows(id, day)``: expanding training before each test period.

    Roles: ``treino_interno``, ``validacao_interna`` (the last months before the test) and ``teste``. Rows
    after a fold's test, or without day, are not in it. With ``check`` a fold that lacks a role is an error.
    """
    start = rows.agg(F.trunc(F.min("day"), "MM").alias("start"))
    tests = F.transform(F.sequence(F.lit(0), F.lit(folds - 1)), lambda i: F.struct(i.alias("fold"), F.add_months("start", F.lit(train_months) + i * test_months).alias("t")))
    each = rows.filter("day is not null").join(F.broadcast(start)).select("id", "day", F.explode(tests).alias("f"))
    role = F.when(F.col("day") < F.add_months("f.t", -inner_months), "treino_interno").when(F.col("day") < F.col("f.t"), "validacao_interna")
    role = role.when(F.col("day") < F.add_months("f.t", test_months), "teste")
    out = each.select("id", "f.fold", role.alias("papel")).filter("papel is not null")
    if check:
        there = out.groupBy("fold").agg(F.count_distinct("papel").alias("n")).filter("n = 3").count()
        if there < folds:
            raise ValueError(f"{folds - there} folds lack a role: the corpus doesn't cover them")
    return out


def stratified_folds(rows: DataFrame, k: int = 5, seed: str = "2026", inner: int = 5) -> DataFrame:
    """``id, fold, validacao_interna`` of ``rows(id, y)``: each class is dealt out in random order.

    Rows are numbered by class and random key across all partitions, so classes of any size deal
    out evenly. Of the rows outside a fold one in ``inner`` is for validation.
    """
    keyed = rows.select("id", "y", random_key(F.col("id"), seed).alias("key"))
    order = [F.col("y").asc_nulls_last(), F.col("key").asc(), F.col("id").asc()]
    place = numbered(keyed, order, "place")
    return place.select("id", "y", (F.col("place") % k).cast("int").alias("fold"), (F.floor(F.col("place") / k) % inner == 0).alias("validacao_interna"))


def monthly_subsample(rows: DataFrame, n: int, seed: str = "2026") -> DataFrame:
    """About ``n`` of ``rows(id, day)``: of each month its share, rounded half to even, at least one."""
    months = rows.filter("day is not null").groupBy(F.trunc("day", "MM").alias("mes")).agg(F.count("*").alias("n_mes"))
    total = months.agg(F.sum("n_mes").alias("total"))
    size = F.greatest(F.lit(1), F.bround(F.col("n_mes") * F.least(F.lit(1.0), F.lit(float(n)) / F.col("total")))).cast("long")
    quota = months.join(F.broadcast(total)).select("mes", size.alias("quota"))
    keyed = rows.filter("day is not null").select("id", F.trunc("day", "MM").alias("mes"), random_key(F.col("id"), seed).alias("key")).join(F.broadcast(quota), "mes")
    return smallest_keys(keyed.select("id", "mes", "key", "quota"), ["mes"], "quota").select("id", "mes")


def leakage(pairs: DataFrame, folds: DataFrame) -> DataFrame:
    """Pairs inside and across training and test of each fold, and over all folds (``fold`` null).

    ``folds(id, fold, lado)`` has the side ``treino`` or ``teste``; pairs with an end outside a fold are not in it.
    """
    a = folds.select(F.col("id").alias("id_a"), "fold", F.col("lado").alias("lado_a"))
    b = folds.select(F.col("id").alias("id_b"), "fold", F.col("lado").alias("lado_b"))
    met = pairs.select("id_a", "id_b").join(a, "id_a").join(b, ["id_b", "fold"])
    across = F.count_if(F.col("lado_a") != F.col("lado_b"))
    return met.rollup("fold").agg(
        F.count("*").alias("pares_presentes"), across.alias("pares_cruzando_treino_teste"),
        F.count_if((F.col("lado_a") == "treino") & (F.col("lado_b") == "treino")).alias("pares_dentro_treino"),
        F.count_if((F.col("lado_a") == "teste") & (F.col("lado_b") == "teste")).alias("pares_dentro_teste"),
        F.coalesce(F.try_divide(across, F.count("*")), F.lit(0.0)).alias("fracao_cruzando"),
    )


def near_leakage(found: NearPairs, folds: DataFrame) -> DataFrame:
    """The columns of :func:`leakage` for all pairs of rows with equal or nearly equal texts, over ``folds(id, fold, lado)``.

    Each class of equal texts is counted by fold and side; its pairs, and those of two linked classes, are
    products of these counts, so no pair of copies is expanded. Folds without pairs have zeros.
    """
    sides = found.members.join(folds, "id").groupBy("rep", "fold").agg(F.count_if(F.col("lado") == "treino").alias("tr"), F.count_if(F.col("lado") == "teste").alias("te"))
    half = lambda n: F.expr(f"{n} * ({n} - 1) div 2")
    copies = sides.select("fold", (F.col("tr") * F.col("te")).alias("across"), half("tr").alias("train"), half("te").alias("test"))
    a, b = (sides.select(F.col("rep").alias(f"id_{x}"), "fold", F.col("tr").alias(f"tr_{x}"), F.col("te").alias(f"te_{x}")) for x in "ab")
    linked = found.pairs.select("id_a", "id_b").join(a, "id_a").join(b, ["id_b", "fold"])
    links = linked.selectExpr("fold", "tr_a * te_b + te_a * tr_b AS across", "tr_a * tr_b AS train", "te_a * te_b AS test")
    total = F.sum(F.expr("across + train + test"))
    return copies.union(links).rollup("fold").agg(
        total.alias("pares_presentes"), F.sum("across").alias("pares_cruzando_treino_teste"),
        F.sum("train").alias("pares_dentro_treino"), F.sum("test").alias("pares_dentro_teste"),
        F.coalesce(F.try_divide(F.sum("across"), total), F.lit(0.0)).alias("fracao_cruzando"),
    )
