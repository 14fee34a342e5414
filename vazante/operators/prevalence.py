"""Prevalence of a class over time: gap-filled series, seasonality, coverage, anomalies.

Inputs have a ``day`` date column and a boolean ``positive``. Rows without day are left out of the
series. Every operator aggregates first, so what is joined with the calendar is one row a period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import wilson

UNITS = {"D": ("DAY", "INTERVAL 1 DAY", "date_sub(next, 1)"), "W": ("WEEK", "INTERVAL 7 DAYS", "date_sub(next, 7)"), "M": ("MONTH", "INTERVAL 1 MONTH", "add_months(next, -1)")}
#: Weekday labels from Monday.
WEEKDAYS = ("seg", "ter", "qua", "qui", "sex", "sáb", "dom")


def period(day: Column, unit: str) -> Column:
    """First day of the day's period: D, W (from Monday) or M."""
    if unit not in UNITS:
        raise ValueError(f"unit is one of {sorted(UNITS)}")
    return day if unit == "D" else F.trunc(day, UNITS[unit][0])


def filled(counts: DataFrame, unit: str, values: list[str]) -> DataFrame:
    """``counts(data, values)`` with a row of zeros for every period between two that it has.

    Each period brings the empty ones up to the next, so the counted table is read once; the window
    runs over one row a period.
    """
    _, step, before_next = UNITS[unit]
    following = counts.withColumn("next", F.lead("data").over(W.partitionBy().orderBy("data")))
    periods = F.expr(f"if(next is null, array(data), sequence(data, {before_next}, {step}))")
    spread = following.withColumn("p", F.explode(periods))
    return spread.select(F.col("p").alias("data"), *(F.when(F.col("p") == F.col("data"), F.col(v)).otherwise(0).alias(v) for v in values))


def series(rows: DataFrame, unit: str) -> DataFrame:
    """``data, total, positivos, prevalencia, ic_inf, ic_sup``; periods without rows have total 0 and null share."""
    counts = (
        rows.filter("day is not null")
        .groupBy(period(F.col("day"), unit).alias("data"))
        .agg(F.count("*").alias("total"), F.count_if("positive").alias("positivos"))
    )
    full = filled(counts, unit, ["total", "positivos"])
    share, low, high = wilson(F.col("positivos"), F.col("total"))
    return full.select("data", "total", "positivos", share.alias("prevalencia"), low.alias("ic_inf"), high.alias("ic_sup"))


def by_weekday(rows: DataFrame) -> DataFrame:
    """Shares by weekday from Monday = 0; weekdays without rows are left out."""
    counts = rows.filter("day is not null").groupBy(F.weekday("day").alias("dia_semana")).agg(F.count("*").alias("total"), F.count_if("positive").alias("positivos"))
    share, low, high = wilson(F.col("positivos"), F.col("total"))
    name = F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.col("dia_semana") + 1)
    return counts.select("dia_semana", name.alias("nome"), "total", "positivos", share.alias("prevalencia"), low.alias("ic_inf"), high.alias("ic_sup"))


def by_year_month(rows: DataFrame) -> DataFrame:
    """One row for each year and month that occurs."""
    return (
        rows.filter("day is not null")
        .groupBy(F.year("day").alias("ano"), F.month("day").alias("mes"))
        .agg(F.count("*").alias("total"), F.count_if("positive").alias("positivos"))
        .withColumn("prevalencia", F.col("positivos") / F.col("total"))
    )


def month_heatmap(rows: DataFrame, least: int = 100) -> DataFrame:
    """A row a year, a column a month (``m01``..``m12``); shares of fewer than ``least`` rows are null."""
    cells = by_year_month(rows).withColumn("v", F.when(F.col("total") >= least, F.col("prevalencia")))
    return cells.groupBy("ano").agg(*(F.max(F.when(F.col("mes") == m, F.col("v"))).alias(f"m{m:02d}") for m in range(1, 13)))


def by_year(rows: DataFrame) -> DataFrame:
    return (
        rows.filter("day is not null")
        .groupBy(F.year("day").alias("ano"))
        .agg(F.count_if("positive").alias("positivos"), F.count_if(~F.col("positive")).alias("negativos"), F.count("*").alias("total"))
    )


def by_year_and_category(rows: DataFrame) -> DataFrame:
    """One-versus-rest table of every category and year in one pass over ``rows(day, category)``;
    years of a category without positives are kept as 0."""
    known = rows.filter("day is not null")
    each = known.groupBy("category", F.year("day").alias("ano")).agg(F.count("*").alias("positivos"))
    years = each.groupBy("ano").agg(F.sum("positivos").alias("total"))
    names = each.filter("category is not null").select("category").distinct()
    every = years.agg(F.collect_list(F.struct("ano", "total")).alias("anos"))  # one row: a calendar's years
    grid = names.join(F.broadcast(every)).select("category", F.explode("anos").alias("y")).select("category", "y.ano", "y.total")
    return (
        grid.join(each, ["category", "ano"], "left")
        .fillna(0, ["positivos"])
        .select("category", "ano", "positivos", (F.col("total") - F.col("positivos")).alias("negativos"), "total")
    )


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls, their share and the number of distinct values of each column, in one aggregation by digests."""
    cells = [F.struct(F.lit(c).alias("coluna"), F.md5(F.col(c).cast("string").cast("binary")).alias("v"), F.lit(dict(df.dtypes)[c]).alias("dtype")) for c in columns]
    values = df.select(F.explode(F.array(*cells)).alias("c")).groupBy("c.coluna", "c.dtype", "c.v").agg(F.count("*").alias("n"))
    return values.groupBy("coluna", "dtype").agg(
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulos"),
        F.try_divide(F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)), F.sum("n")).alias("pct_nulos"),
        F.count("v").alias("valores_unicos_nao_nulos"),
    )


def top_and_rest(df: DataFrame, column: str, top: int = 7) -> DataFrame:
    """Counts of the ``top`` values (null is a value; ties by name), the others together as ``outras``."""
    counts = df.groupBy(F.coalesce(F.col(column), F.lit("nan")).alias("categoria")).agg(F.count("*").alias("n"))
    first = counts.orderBy(F.desc("n"), "categoria").limit(top).withColumn("top", F.lit(True))
    marked = counts.join(F.broadcast(first.select("categoria", "top")), "categoria", "left")
    total = F.sum("contagem").over(W.partitionBy())
    return (
        marked.groupBy(F.when(F.col("top"), F.col("categoria")).otherwise("outras").alias("categoria"))
        .agg(F.sum("n").alias("contagem"))
        .withColumn("pct", F.col("contagem") / total)
    )


def overall(rows: DataFrame) -> DataFrame:
    """One row: rows, positives, share with bounds, null categories and days. Of no rows: zeros and nulls."""
    one = rows.agg(
        F.count("*").alias("total_linhas"), F.count_if("positive").alias("positivos"),
        F.count_if(F.col("category").isNull()).alias("linhas_com_category_nula"), F.count_if(F.col("day").isNull()).alias("linhas_com_date_nula"),
    )
    share, low, high = wilson(F.col("positivos"), F.col("total_linhas"))
    return one.select("total_linhas", "positivos", share.alias("prevalencia"), low.alias("wilson_ic95_inf"), high.alias("wilson_ic95_sup"), "linhas_com_category_nula", "linhas_com_date_nula")


def coverage(rows: DataFrame, before: str | None = None) -> DataFrame:
    """One row on the days and months covered; months from ``before`` on are left out of the monthly part."""
    days = rows.filter("day is not null").groupBy("day").agg(F.count("*").alias("n"))
    one = days.agg(F.min("day").alias("a"), F.max("day").alias("b"), F.count("*").alias("dias_distintos"))
    monthly = series(rows.filter(F.col("day") < F.lit(before).cast("date")) if before else rows, "M")
    months = monthly.agg(
        F.sort_array(F.collect_list(F.when(F.col("total") == 0, F.date_format("data", "yyyy-MM")))).alias("zeros"),
        F.count("*").alias("n_pontos_serie_mensal"), F.date_format(F.min("data"), "yyyy-MM").alias("m1"), F.date_format(F.max("data"), "yyyy-MM").alias("m2"),
    )
    return one.join(F.broadcast(months)).select(
        F.date_format("a", "yyyy-MM-dd").alias("data_min"), F.date_format("b", "yyyy-MM-dd").alias("data_max"), "dias_distintos",
        (F.datediff("b", "a") + 1).alias("dias_calendario"), F.to_json("zeros").alias("meses_zerados"), F.size("zeros").alias("n_meses_zerados"),
        "n_pontos_serie_mensal", F.concat("m1", F.lit(" a "), "m2").alias("cobertura_mensal_efetiva"),
    )


def daily_calendar(rows: DataFrame) -> DataFrame:
    """``data, total`` of every day between the first and the last."""
    return series(rows.withColumn("positive", F.lit(False)), "D").select("data", "total")


def empty_days(days: DataFrame) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.weekday("data") + 1)
    return days.filter("total = 0").select("data", name.alias("dia_semana"))


def daily_anomalies(days: DataFrame, limit: float = 3.0) -> DataFrame:
    """Days whose classic or robust z passes ``limit``; days without rows don't enter the statistics, and
    a deviation of 0 flags nothing."""
    used = days.filter("total > 0")
    one = used.agg(F.avg("total").alias("mean"), F.stddev_samp("total").alias("sd"), F.median("total").alias("med"))
    mad = used.join(F.broadcast(one)).agg(F.median(F.abs(F.col("total") - F.col("med"))).alias("mad"))
    z = used.join(F.broadcast(one)).join(F.broadcast(mad)).select(
        "data", "total",
        F.try_divide(F.col("total") - F.col("mean"), F.col("sd")).alias("z_classico"),
        F.try_divide(0.6745 * (F.col("total") - F.col("med")), F.col("mad")).alias("z_robusto"),
    )
    a, b = (F.coalesce(F.abs(F.col(c)) > limit, F.lit(False)) for c in ("z_classico", "z_robusto"))
    return z.withColumns({"flag_classico": a, "flag_robusto": b, "flag_ambos": a & b}).filter("flag_classico or flag_robusto")
