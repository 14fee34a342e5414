"""Trend tests on series of prevalences: Mann-Kendall, two proportions, chi-squared of years."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats

TRENDS = (
    "categoria string, n_total long, n_meses_cobertos long, prevalencia_primeiro_mes double, prevalencia_ultimo_mes double, mk_tau double, "
    "mk_p double, zp_estatistica double, zp_p double, zp_ano_1 int, zp_ano_2 int, qui_estatistica double, qui_p double"
)


def mann_kendall_tau(monthly: DataFrame) -> DataFrame:
    """One row: Kendall's tau-b of the prevalences against time, with first, last and change.

    A self join of the series, whose length is the number of periods; null shares are left out.
    """
    v = monthly.filter("prevalencia is not null").select("data", F.col("prevalencia").alias("v"))
    a, b = v.alias("a"), v.alias("b")
    pairs = a.join(F.broadcast(b), F.col("a.data") < F.col("b.data")).agg(
        F.sum(F.signum(F.col("b.v") - F.col("a.v"))).alias("s"), F.count("*").alias("pairs"), F.count_if(F.col("a.v") == F.col("b.v")).alias("tied")
    )
    ends = v.agg(F.count("*").alias("n"), F.min_by("v", "data").alias("primeiro"), F.max_by("v", "data").alias("ultimo"))
    tau = F.try_divide(F.col("s"), F.sqrt(F.col("pairs").cast("double") * (F.col("pairs") - F.col("tied"))))
    return pairs.join(F.broadcast(ends)).select(tau.alias("tau"), "n", "primeiro", "ultimo", (F.col("ultimo") - F.col("primeiro")).alias("delta"))


def first_against_last_year(years: DataFrame) -> DataFrame:
    """Two-proportion z of the first and the last year; no row if there is but one."""
    ends = years.agg(
        F.min("ano").alias("ano_1"), F.max("ano").alias("ano_2"),
        *(f(c, "ano").cast("double").alias(n) for f, k in ((F.min_by, 1), (F.max_by, 2)) for c, n in (("positivos", f"k{k}"), ("total", f"n{k}"))),
    ).filter("ano_1 < ano_2")
    k1, n1, k2, n2 = (F.col(c) for c in ("k1", "n1", "k2", "n2"))
    return ends.select(
        "ano_1", "ano_2", stats.two_proportions(n1, k1, n2, k2).alias("estatistica"), (k1 / n1 - k2 / n2).alias("diferenca"), F.try_divide(k1 / n1, k2 / n2).alias("razao")
    )


def chi2_of_years(years: DataFrame) -> DataFrame:
    """Chi-squared independence of class and year (for more than two years, uncorrected)."""
    total = years.agg(F.sum("positivos").alias("k"), F.sum("negativos").alias("m"), F.sum("total").alias("n"), (F.count("*") - 1).cast("int").alias("df"))
    e1, e2 = F.col("total") * F.col("k") / F.col("n"), F.col("total") * F.col("m") / F.col("n")
    term = F.try_divide((F.col("positivos") - e1) ** 2, e1) + F.try_divide((F.col("negativos") - e2) ** 2, e2)
    return years.join(F.broadcast(total)).agg(F.sum(term).alias("estatistica"), F.first("df").alias("df"))


def category_trends(rows: DataFrame, before: str) -> DataFrame:
    """All three tests of every category against the rest, from ``rows(day, category)``.

    Two aggregations give a category's months and years; each category then is one small group.
    Months from ``before`` on are left out of the monthly test. Null categories count in the totals only.
    """
    month = F.when(F.col("day") < F.lit(before).cast("date"), F.trunc("day", "MM"))
    each = rows.groupBy("category", month.alias("mes"), F.year("day").alias("ano")).agg(F.count("*").alias("n"))
    months = each.filter("mes is not null").groupBy("mes").agg(F.sum("n").alias("n")).select(F.collect_list(F.struct("mes", "n")).alias("months"))
    years = each.filter("ano is not null").groupBy("ano").agg(F.sum("n").alias("n")).select(F.collect_list(F.struct("ano", "n")).alias("years"))
    own = each.filter("category is not null").groupBy("category").agg(F.collect_list(F.struct("mes", "ano", "n")).alias("cells"))

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for category, cells, all_months, all_years in pdf.itertuples(index=False):
            by_month: dict = {}
            by_year: dict = {}
            for c in cells:
                if c["mes"] is not None:
                    by_month[c["mes"]] = by_month.get(c["mes"], 0) + c["n"]
                if c["ano"] is not None:
                    by_year[c["ano"]] = by_year.get(c["ano"], 0) + c["n"]
            monthly = [by_month.get(m["mes"], 0) / m["n"] for m in sorted(all_months, key=lambda m: m["mes"])]
            yearly = [(int(y["ano"]), int(by_year.get(y["ano"], 0)), int(y["n"])) for y in sorted(all_years, key=lambda y: y["ano"])]
            tau, mk_p = stats.kendall(monthly)
            z = z_p = first = last = None
            if len(yearly) >= 2:
                (first, k1, n1), (last, k2, n2) = yearly[0], yearly[-1]
                pooled = (k1 + k2) / (n1 + n2)
                error = (pooled * (1 - pooled) * (1 / n1 + 1 / n2)) ** 0.5
                z = (k1 / n1 - k2 / n2) / error if error else 0.0
                z_p = stats.normal_tail(z) if error else 1.0
            x, x_p = stats.chi2_k_by_2([(k, n - k) for _, k, n in yearly])
            out.append((category, sum(int(c["n"]) for c in cells), sum(m > 0 for m in by_month.values()), *(monthly[i] if monthly else None for i in (0, -1)), tau, mk_p, z, z_p, first, last, x, x_p))
        return pd.DataFrame(out, columns=[c.split()[0] for c in TRENDS.split(", ")])

    return own.join(F.broadcast(months)).join(F.broadcast(years)).mapInPandas(lambda it: map(test, it), TRENDS)
