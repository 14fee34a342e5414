"""Queries on counts and prevalence over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import prevalence as P
from ..operators import trends
from ..schemas import RAW_COLUMNS
from ..session import table
from .base import ART, LAST_MONTH, articles, rounded, wilson_sql


def _series(unit: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        rows = articles(spark, folder)
        if unit == "M":
            rows = rows.filter(F.col("day") < F.lit(LAST_MONTH).cast("date"))
        return rounded(P.series(rows.select("day", "positive"), unit))

    return query


def column_profile(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(P.column_profile(table(spark, folder, "articles"), list(RAW_COLUMNS)))


def trend_tests(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(trends.category_trends(articles(spark, folder).select("day", "category"), LAST_MONTH), 6)


def trend_statistics(spark: SparkSession, folder: str) -> DataFrame:
    found = trends.category_trends(articles(spark, folder).select("day", "category"), LAST_MONTH)
    return rounded(found.select("categoria", "n_total", "n_meses_cobertos", "mk_tau", "zp_estatistica", "qui_estatistica"), 6)


def _on_articles(f, *columns: str):
    return lambda spark, folder: rounded(f(articles(spark, folder).select(*columns)))


QUERIES = {
    "serie_mensal_prevalencia": _series("M"),
    "serie_semanal_prevalencia": _series("W"),
    "serie_diaria_prevalencia": _series("D"),
    "prevalencia_dia_semana": _on_articles(P.by_weekday, "day", "positive"),
    "prevalencia_mes_ano": _on_articles(P.by_year_month, "day", "positive"),
    "heatmap_mes_ano": _on_articles(P.month_heatmap, "day", "positive"),
    "tabela_ano_pos_neg": _on_articles(P.by_year, "day", "positive"),
    "tabela_ano_por_categoria": _on_articles(P.by_year_and_category, "day", "category"),
    "perfil_colunas": column_profile,
    "top_categorias_outras": _on_articles(lambda d: P.top_and_rest(d, "category"), "category"),
    "prevalencia_global": _on_articles(P.overall, "day", "category", "positive"),
    "cobertura_temporal": _on_articles(lambda d: P.coverage(d, LAST_MONTH), "day", "positive"),
    "calendario_diario": _on_articles(P.daily_calendar, "day"),
    "dias_zero": _on_articles(lambda d: P.empty_days(P.daily_calendar(d)), "day"),
    "anomalias_diarias": _on_articles(lambda d: P.daily_anomalies(P.daily_calendar(d)), "day"),
    "mann_kendall": lambda s, d: rounded(trends.mann_kendall_tau(P.series(articles(s, d).filter(F.col("day") < F.lit(LAST_MONTH).cast("date")), "M"))),
    "z_proporcoes": lambda s, d: rounded(trends.first_against_last_year(P.by_year(articles(s, d)))),
    "qui_quadrado": lambda s, d: rounded(trends.chi2_of_years(P.by_year(articles(s, d)))),
    "deriva_por_categoria": trend_tests,
    "deriva_por_categoria_estatisticas": trend_statistics,
}


def _series_sql(unit: str, step: str, where: str = "") -> str:
    p, a, b = wilson_sql()
    trunc = "day" if unit == "day" else f"date_trunc('{unit}', day)::DATE"
    return (
        f"WITH c AS (SELECT {trunc} AS data, count(*) AS total, count(*) FILTER (positive) AS positivos FROM {ART} WHERE day IS NOT NULL {where} GROUP BY 1), "
        f"k AS (SELECT unnest(generate_series(min(data)::TIMESTAMP, max(data)::TIMESTAMP, INTERVAL {step}))::DATE AS data FROM c), "
        "f AS (SELECT k.data, coalesce(total, 0) AS total, coalesce(positivos, 0) AS positivos FROM k LEFT JOIN c ON k.data = c.data) "
        f"SELECT data, total, positivos, {p} AS prevalencia, {a} AS ic_inf, {b} AS ic_sup FROM f"
    )


_P, _A, _B = wilson_sql()
_DAYS = "['seg','ter','qua','qui','sex','sáb','dom']"
_CAL = (
    f"c AS (SELECT day AS data, count(*) AS total FROM {ART} WHERE day IS NOT NULL GROUP BY 1), "
    "k AS (SELECT unnest(generate_series(min(data)::TIMESTAMP, max(data)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS data FROM c), "
    "cal AS (SELECT k.data, coalesce(total, 0) AS total FROM k LEFT JOIN c ON k.data = c.data)"
)
_YEARS = f"y AS (SELECT year(day)::INTEGER AS ano, count(*) FILTER (positive) AS positivos, count(*) FILTER (NOT positive) AS negativos, count(*) AS total FROM {ART} WHERE day IS NOT NULL GROUP BY 1)"
_MONTHLY = _series_sql("month", "1 MONTH", f"AND day < DATE '{LAST_MONTH}'")
_PAIRS = "SELECT sum(sign(b.v - a.v)) AS s, count(*) AS n, count(*) FILTER (a.v = b.v) AS t FROM m a JOIN m b ON a.data < b.data"
#: Two-sided normal tail 2 (1 - Phi(x)) of x >= 0, by Simpson's rule.
_TAIL = "CASE WHEN {0} > 12 THEN 0.0 ELSE greatest(0.0, 1 - 2 * {0} / 6000 * list_sum(list_transform(generate_series(0, 2000), lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(i * {0} / 2000, 2) / 2) / sqrt(2 * pi())))) END"
#: CTE ih(n, c): shares of the permutations of n things by their number of inversions, from 0 on.
_INVERSIONS = (
    "ih AS (SELECT 1 AS n, [1.0::DOUBLE] AS c UNION ALL SELECT n + 1, list_transform(generate_series(1, len(c) + n), lambda k: coalesce(list_sum(c[greatest(1, k - n) : least(k, len(c))]), 0.0) / (n + 1)) FROM ih WHERE n < 60)"
)
_CAT = f"""a AS (SELECT day, category FROM {ART}),
n AS (SELECT category, count(*) AS n_total FROM a WHERE category IS NOT NULL GROUP BY 1),
mt AS (SELECT date_trunc('month', day)::DATE AS data, count(*) AS total FROM a WHERE day < DATE '{LAST_MONTH}' GROUP BY 1),
mc AS (SELECT category, date_trunc('month', day)::DATE AS data, count(*) AS k FROM a WHERE day < DATE '{LAST_MONTH}' GROUP BY 1, 2),
m AS (SELECT n.category, mt.data, coalesce(k, 0) / mt.total::DOUBLE AS v, coalesce(k, 0) AS k FROM n CROSS JOIN mt LEFT JOIN mc ON mc.category = n.category AND mc.data = mt.data),
cov AS (SELECT category, count(*) FILTER (k > 0) AS n_meses_cobertos, count(*) AS months, arg_min(v, data) AS v1, arg_max(v, data) AS v2 FROM m GROUP BY 1),
ti AS (SELECT category, sum(t * (t - 1) * (2 * t + 5)) AS ties FROM (SELECT category, count(*) AS t FROM m GROUP BY category, v) GROUP BY 1),
mk AS (SELECT a.category, sum(sign(b.v - a.v)) AS s, count(*) AS n, count(*) FILTER (a.v = b.v) AS t FROM m a JOIN m b ON a.category = b.category AND a.data < b.data GROUP BY 1),
yt AS (SELECT year(day) AS ano, count(*) AS total FROM a WHERE day IS NOT NULL GROUP BY 1),
yc AS (SELECT category, year(day) AS ano, count(*) AS k FROM a WHERE day IS NOT NULL GROUP BY 1, 2),
y AS (SELECT n.category, yt.ano, coalesce(k, 0)::DOUBLE AS k, yt.total::DOUBLE AS total FROM n CROSS JOIN yt LEFT JOIN yc ON yc.category = n.category AND yc.ano = yt.ano),
fl AS (SELECT category, min(ano)::INTEGER AS a1, max(ano)::INTEGER AS a2, arg_min(k, ano) AS k1, arg_min(total, ano) AS n1, arg_max(k, ano) AS k2, arg_max(total, ano) AS n2, count(*) AS years, sum(k) AS ks, sum(total) AS ts FROM y GROUP BY 1),
z AS (SELECT category, years, ks, ts, a1, a2, (k1/n1 - k2/n2) / nullif(sqrt((k1+k2)/(n1+n2) * (1-(k1+k2)/(n1+n2)) * (1/n1+1/n2)), 0) AS z FROM fl),
q AS (SELECT y.category, sum((y.k - y.total*ks/ts)**2 / (y.total*ks/ts) + ((y.total-y.k) - y.total*(ts-ks)/ts)**2 / (y.total*(ts-ks)/ts)) AS x FROM y JOIN fl USING (category) WHERE ks > 0 AND ks < ts GROUP BY 1),
tt AS (SELECT n.category AS categoria, n_total, n_meses_cobertos, v1, v2, months, mk.s, mk.n AS pairs, mk.t AS tied, s / nullif(sqrt(mk.n::DOUBLE * (mk.n - t)), 0) AS tau,
abs(s) / nullif(sqrt((months * (months - 1) * (2.0 * months + 5) - ties) / 18), 0) AS mkz, CASE WHEN years >= 2 THEN coalesce(z, 0.0) END AS z, z IS NULL AS level, a1, a2, years, CASE WHEN years > 2 THEN x END AS x
FROM n JOIN cov USING (category) JOIN ti USING (category) JOIN mk USING (category) JOIN z USING (category) LEFT JOIN q USING (category))"""
_CAT_STATISTICS = f"WITH {_CAT} SELECT categoria, n_total, n_meses_cobertos, round(tau, 6) AS mk_tau, round(z, 6) AS zp_estatistica, round(x, 6) AS qui_estatistica FROM tt"
#: All columns for corpora of an odd number of years (an even number of degrees of freedom), three at least, and up to 60 months.
_CAT_TESTS = (
    f"WITH RECURSIVE {_INVERSIONS}, {_CAT}, xp AS (SELECT *, CASE WHEN tied = 0 THEN least(1.0, 2 * list_sum((SELECT c FROM ih WHERE ih.n = months)[1 : least((pairs - s) // 2, (pairs + s) // 2)::BIGINT + 1])) END AS exact FROM tt) "
    "SELECT categoria, n_total, n_meses_cobertos, round(v1, 6) AS prevalencia_primeiro_mes, round(v2, 6) AS prevalencia_ultimo_mes, round(tau, 6) AS mk_tau, "
    f"round(CASE WHEN tau IS NULL THEN NULL WHEN tied = 0 THEN exact ELSE {_TAIL.format('mkz')} END, 6) AS mk_p, round(z, 6) AS zp_estatistica, round(CASE WHEN level THEN 1.0 ELSE {_TAIL.format('abs(z)')} END, 6) AS zp_p, "
    "a1 AS zp_ano_1, a2 AS zp_ano_2, round(x, 6) AS qui_estatistica, round(exp(-x / 2) * list_sum(list_transform(generate_series(0, (years - 3) // 2), lambda i: pow(x / 2, i) / factorial(i::INTEGER))), 6) AS qui_p FROM xp"
)

ORACLE_SQL = {
    "serie_mensal_prevalencia": _MONTHLY,
    "serie_semanal_prevalencia": _series_sql("week", "7 DAYS"),
    "serie_diaria_prevalencia": _series_sql("day", "1 DAY"),
    "prevalencia_dia_semana": f"WITH c AS (SELECT (isodow(day) - 1)::INTEGER AS dia_semana, count(*) AS total, count(*) FILTER (positive) AS positivos FROM {ART} WHERE day IS NOT NULL GROUP BY 1) SELECT dia_semana, {_DAYS}[dia_semana + 1] AS nome, total, positivos, {_P} AS prevalencia, {_A} AS ic_inf, {_B} AS ic_sup FROM c",
    "prevalencia_mes_ano": f"SELECT year(day)::INTEGER AS ano, month(day)::INTEGER AS mes, count(*) AS total, count(*) FILTER (positive) AS positivos, round(count(*) FILTER (positive) / count(*)::DOUBLE, 8) AS prevalencia FROM {ART} WHERE day IS NOT NULL GROUP BY 1, 2",
    "heatmap_mes_ano": f"WITH c AS (SELECT year(day)::INTEGER AS ano, month(day) AS mes, CASE WHEN count(*) >= 100 THEN round(count(*) FILTER (positive) / count(*)::DOUBLE, 8) END AS v FROM {ART} WHERE day IS NOT NULL GROUP BY 1, 2) SELECT ano, "
    + ", ".join(f"max(v) FILTER (mes = {m}) AS m{m:02d}" for m in range(1, 13))
    + " FROM c GROUP BY ano",
    "tabela_ano_pos_neg": f"WITH {_YEARS} SELECT * FROM y",
    "tabela_ano_por_categoria": f"WITH a AS (SELECT category, year(day)::INTEGER AS ano FROM {ART} WHERE day IS NOT NULL), t AS (SELECT ano, count(*) AS total FROM a GROUP BY 1), n AS (SELECT DISTINCT category FROM a WHERE category IS NOT NULL), c AS (SELECT category, ano, count(*) AS k FROM a GROUP BY 1, 2) SELECT n.category, t.ano, coalesce(k, 0) AS positivos, total - coalesce(k, 0) AS negativos, total FROM n CROSS JOIN t LEFT JOIN c ON c.category = n.category AND c.ano = t.ano",
    "perfil_colunas": " UNION ALL ".join(
        f"SELECT '{c}' AS coluna, 'string' AS dtype, count(*) - count({c}) AS nulos, round((count(*) - count({c})) / count(*)::DOUBLE, 8) AS pct_nulos, count(DISTINCT {c}) AS valores_unicos_nao_nulos FROM articles"
        for c in RAW_COLUMNS
    ),
    "top_categorias_outras": f"WITH c AS (SELECT coalesce(category, 'nan') AS categoria, count(*) AS n FROM {ART} GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, categoria) AS r FROM c), g AS (SELECT CASE WHEN r <= 7 THEN categoria ELSE 'outras' END AS categoria, sum(n)::BIGINT AS contagem FROM r GROUP BY 1) SELECT categoria, contagem, round(contagem / (SELECT sum(contagem) FROM g)::DOUBLE, 8) AS pct FROM g",
    "prevalencia_global": f"WITH g AS (SELECT count(*) AS total, count(*) FILTER (positive) AS positivos, count(*) FILTER (category IS NULL) AS a, count(*) FILTER (day IS NULL) AS b FROM {ART}) SELECT total AS total_linhas, positivos, {_P} AS prevalencia, {_A} AS wilson_ic95_inf, {_B} AS wilson_ic95_sup, a AS linhas_com_category_nula, b AS linhas_com_date_nula FROM g",
    "cobertura_temporal": f"WITH d AS (SELECT min(day) AS a, max(day) AS b, count(DISTINCT day) AS n FROM {ART}), s AS ({_MONTHLY}), m AS (SELECT list(strftime(data, '%Y-%m') ORDER BY data) FILTER (total = 0) AS z, count(*) AS n_pontos, strftime(min(data), '%Y-%m') || ' a ' || strftime(max(data), '%Y-%m') AS r FROM s) SELECT strftime(a, '%Y-%m-%d') AS data_min, strftime(b, '%Y-%m-%d') AS data_max, n AS dias_distintos, (b - a + 1)::INTEGER AS dias_calendario, coalesce(to_json(z)::VARCHAR, '[]') AS meses_zerados, coalesce(len(z), 0)::INTEGER AS n_meses_zerados, n_pontos AS n_pontos_serie_mensal, r AS cobertura_mensal_efetiva FROM d, m",
    "calendario_diario": f"WITH {_CAL} SELECT * FROM cal",
    "dias_zero": f"WITH {_CAL} SELECT data, {_DAYS}[isodow(data)] AS dia_semana FROM cal WHERE total = 0",
    "anomalias_diarias": f"WITH {_CAL}, u AS (SELECT * FROM cal WHERE total > 0), o AS (SELECT avg(total) AS mu, stddev_samp(total) AS sd, median(total) AS md FROM u), r AS (SELECT median(abs(total - md)) AS mad FROM u, o), z AS (SELECT data, total, (total - mu) / nullif(sd, 0) AS zc, 0.6745 * (total - md) / nullif(mad, 0) AS zr FROM u, o, r), f AS (SELECT *, coalesce(abs(zc) > 3, false) AS c, coalesce(abs(zr) > 3, false) AS b FROM z) SELECT data, total, round(zc, 8) AS z_classico, round(zr, 8) AS z_robusto, c AS flag_classico, b AS flag_robusto, c AND b AS flag_ambos FROM f WHERE c OR b",
    "mann_kendall": f"WITH s AS ({_MONTHLY}), m AS (SELECT data, (positivos / total::DOUBLE) AS v FROM s WHERE total > 0), p AS ({_PAIRS}), e AS (SELECT count(*) AS n, arg_min(v, data) AS a, arg_max(v, data) AS b FROM m) SELECT round(s / nullif(sqrt(p.n::DOUBLE * (p.n - t)), 0), 8) AS tau, e.n, round(a, 8) AS primeiro, round(b, 8) AS ultimo, round(b - a, 8) AS delta FROM p, e",
    "z_proporcoes": f"WITH {_YEARS}, f AS (SELECT min(ano) AS ano_1, max(ano) AS ano_2, arg_min(positivos, ano)::DOUBLE AS k1, arg_min(total, ano)::DOUBLE AS n1, arg_max(positivos, ano)::DOUBLE AS k2, arg_max(total, ano)::DOUBLE AS n2 FROM y) SELECT ano_1, ano_2, round(coalesce((k1/n1 - k2/n2) / nullif(sqrt((k1+k2)/(n1+n2) * (1-(k1+k2)/(n1+n2)) * (1/n1 + 1/n2)), 0), 0.0), 8) AS estatistica, round(k1/n1 - k2/n2, 8) AS diferenca, round((k1/n1) / nullif(k2/n2, 0), 8) AS razao FROM f WHERE ano_1 < ano_2",
    "qui_quadrado": f"WITH {_YEARS}, t AS (SELECT sum(positivos)::DOUBLE AS k, sum(negativos)::DOUBLE AS m, sum(total)::DOUBLE AS n, count(*) AS years FROM y) SELECT round(sum((positivos - total*k/n)**2 / (total*k/n) + (negativos - total*m/n)**2 / (total*m/n)), 8) AS estatistica, (any_value(years) - 1)::INTEGER AS df FROM y, t",
    "deriva_por_categoria_estatisticas": _CAT_STATISTICS,
    "deriva_por_categoria": _CAT_TESTS,
}
