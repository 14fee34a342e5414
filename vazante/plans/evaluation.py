"""Queries on splits, classifier metrics and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift as D
from ..operators import metrics as M
from ..operators import splits as S
from ..operators.duplicates import near_pairs
from ..schemas import POSITIVE
from ..session import cut, table
from .base import ART, LAST_MONTH, articles, near_sql, rounded

START = "2015-01-01"


def _dated(spark: SparkSession, folder: str, spread: bool = False) -> DataFrame:
    rows = articles(spark, folder, spread).select(F.col("article_id").alias("id"), "day", "category", "text")
    return rows.filter((F.col("day") >= START) & (F.col("day") < LAST_MONTH))


def _predictions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "predictions").select("fold", F.col("y_colapsado").alias("y_true"), "y_pred", "y_original", "scores")


def fold_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows = _predictions(spark, folder)
    return rounded(M.fold_metrics(rows, POSITIVE).join(M.pr_auc(rows, POSITIVE), "fold", "left"))


def leakage(spark: SparkSession, folder: str) -> DataFrame:
    """Leakage of all pairs of equal or nearly equal texts between rolling training and test."""
    rows = _dated(spark, folder, spread=True)
    folds = S.rolling_folds(rows).select("id", "fold", F.when(F.col("papel") == "teste", "teste").otherwise("treino").alias("lado"))
    return rounded(S.near_leakage(near_pairs(rows), folds))


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    """One dated vector a link (the smallest date), in the effective period."""
    rows = table(spark, folder, "article_vectors").filter("embedding is not null and date is not null")
    one = rows.groupBy("link").agg(F.min_by("embedding", F.struct("date", F.to_json("embedding"))).alias("embedding"), F.min("date").alias("day"))
    return D.in_period(one.withColumnRenamed("link", "id"), START, LAST_MONTH)


def _windowed(spark: SparkSession, folder: str) -> DataFrame:
    rows = cut(_vectors(spark, folder), "vectors")
    return D.windowed(rows, D.monthly_windows(rows))


def aligned(spark: SparkSession, folder: str) -> DataFrame:
    corpus = articles(spark, folder).groupBy("link").agg(F.min_by("category", "article_id").alias("category"))
    return D.aligned(_vectors(spark, folder).withColumnRenamed("id", "link"), corpus).select("link", "day", "category")


def _scope(name: str):
    return lambda s, d: D.in_scope(articles(s, d), name).select("article_id", "category")


def random_parts(spark: SparkSession, folder: str) -> DataFrame:
    rows = _dated(spark, folder)
    return D.random_windows(rows.select("id"), D.monthly_windows(rows))


def _means(spark: SparkSession, folder: str) -> DataFrame:
    return D.centroids(_windowed(spark, folder))


def _results(spark: SparkSession, folder: str) -> DataFrame:
    monthly = F.col("janela_a").rlike("^[0-9]{4}-[0-9]{2}$")
    return table(spark, folder, "drift_results").withColumn("granularidade", F.when(monthly, "mensal").otherwise("bisemanal"))


def main_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Registry of runs made from the results: each repetition of a scope stands for a run."""
    runs = _results(spark, folder).groupBy("escopo", "granularidade", "condicao", "repeticao").agg(F.count("*").alias("n"))
    stamp = F.concat("condicao", F.lit("-"), F.col("repeticao").cast("string"))
    smoke = F.when((F.col("condicao") == "time_ordered") & (F.col("repeticao") == 1), F.lit(1))
    return D.main_runs(runs.select("granularidade", "escopo", stamp.alias("ts"), "n", smoke.alias("limite_pares"))).select("granularidade", "escopo", "ts", "n")


def _table(spark: SparkSession, folder: str) -> DataFrame:
    return D.p_value_table(D.without_window(_results(spark, folder)))


def annex(spark: SparkSession, folder: str) -> DataFrame:
    """The table of fortnightly runs: beside the monthly ones, the first fortnights of the same pairs of months stand for them."""
    results = _results(spark, folder)
    first = lambda c: F.concat(F.col(c), F.lit("-01_"), F.col(c), F.lit("-14"))
    fortnights = results.withColumns({"janela_a": first("janela_a"), "janela_b": first("janela_b"), "granularidade": F.lit("bisemanal")})
    return rounded(D.restricted(D.p_value_table(D.without_window(results.union(fortnights))), ["bisemanal"]))


def _some(where: str):
    return lambda s, d: rounded(_table(s, d).filter(where))


def statistical_drift(spark: SparkSession, folder: str) -> DataFrame:
    rows = cut(_vectors(spark, folder), "vectors")
    return rounded(D.statistical_drift(rows, D.monthly_windows(rows)))


def semantic_drift(spark: SparkSession, folder: str) -> DataFrame:
    rows = cut(_vectors(spark, folder), "vectors")
    return rounded(D.semantic_drift(rows, D.monthly_windows(rows)), 6)


QUERIES = {
    "folds_rolling": lambda s, d: S.rolling_folds(_dated(s, d)),
    "folds_kfold": lambda s, d: S.stratified_folds(_dated(s, d).select("id", F.col("category").alias("y"))),
    "subamostra_por_mes": lambda s, d: S.monthly_subsample(_dated(s, d), 1000),
    "leakage_por_fold": leakage,
    "matriz_confusao": lambda s, d: M.confusion(_predictions(s, d)),
    "metricas_fold": fold_metrics,
    "pr_auc": lambda s, d: rounded(M.pr_auc(_predictions(s, d), POSITIVE)),
    "composicao_fp": lambda s, d: M.false_positives(_predictions(s, d), POSITIVE),
    "bootstrap_ic": lambda s, d: rounded(M.cross_fold(fold_metrics(s, d), ["f1_binario_projetado", "macro_f1", "pr_auc"])),
    "classe_majoritaria": lambda s, d: _dated(s, d).filter("category is not null").groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(1),
    "janelas_mensais": lambda s, d: D.monthly_windows(_dated(s, d)),
    "janelas_bisemanais": lambda s, d: D.fortnightly_windows(_dated(s, d)),
    "particoes_aleatorias": random_parts,
    "filtro_periodo": lambda s, d: D.in_period(articles(s, d).filter("day is not null"), "2015-06-01", "2016-06-01").select("article_id", "day"),
    "filtro_escopo_global": _scope("global"),
    "filtro_escopo_mercado": _scope("mercado"),
    "filtro_escopo_nao_mercado": _scope("nao_mercado"),
    "alinhar_embeddings": aligned,
    "centroides": lambda s, d: rounded(_means(s, d).select("janela_idx", "rotulo", "n", F.posexplode("centroide").alias("dim", "valor")), 6),
    "cosseno_consecutivo": lambda s, d: rounded(D.consecutive_cosine(_means(s, d)), 6),
    "cosseno_cumulativo": lambda s, d: rounded(D.cumulative_cosine(_means(s, d), 16), 6),
    "ks_por_dimensao": lambda s, d: rounded(D.ks_statistics(_windowed(s, d))),
    "cvm_por_dimensao": lambda s, d: rounded(D.cvm_statistics(_windowed(s, d)), 6),
    "fisher_combinado": lambda s, d: rounded(D.combined(D.ks_statistics(_windowed(s, d)), "KS"), 6),
    "cvm": lambda s, d: rounded(D.combined(D.cvm_statistics(_windowed(s, d)), "CVM"), 6),
    "kts": lambda s, d: rounded(D.kernel_tests(_windowed(s, d)).filter("teste = 'KTS'")),
    "lsdd": lambda s, d: rounded(D.kernel_tests(_windowed(s, d)).filter("teste = 'LSDD'")),
    "mmd2": lambda s, d: rounded(D.kernel_tests(_windowed(s, d), permutations=1).filter("teste = 'KTS'").select("par", F.col("estatistica").alias("valor"))),
    "mmd2_exato": lambda s, d: rounded(D.exact_discrepancy(_windowed(s, d)), 6),
    "todos_os_testes": lambda s, d: rounded(D.all_tests(_windowed(s, d))),
    "drift_estatistico": statistical_drift,
    "drift_semantico": semantic_drift,
    "pontos_de_mudanca": lambda s, d: rounded(D.change_points(D.daily_centroids(_vectors(s, d)))),
    "corrida_principal": main_runs,
    "par_idx": lambda s, d: D.pair_index(_results(s, d)).drop("granularidade"),
    "filtro_janela_invalida": lambda s, d: D.without_window(_results(s, d)),
    "tabela_p_values": lambda s, d: rounded(_table(s, d)),
    "tabela_replica": _some("escopo = 'global' and granularidade = 'mensal'"),
    "tabela_condicional": _some("escopo in ('mercado', 'nao_mercado') and granularidade = 'mensal'"),
    "tabela_anexo_bisemanal": annex,
    "condicoes_pareadas": lambda s, d: rounded(D.paired_conditions(_results(s, d))),
    "linhas_descartadas": lambda s, d: D.dropped_rows(_results(s, d)),
    "gap_condicoes": lambda s, d: rounded(D.condition_gap(_table(s, d))),
    "envelope_kts": lambda s, d: D.envelope(_results(s, d)),
}

_DATED = f"d AS (SELECT article_id AS id, day, category, text FROM {ART} WHERE day >= DATE '{START}' AND day < DATE '{LAST_MONTH}')"
_KEY = "('0x' || substr(md5('{0}' || id), 1, 15))::BIGINT"
_FOLDS = (
    "st AS (SELECT date_trunc('month', min(day))::DATE AS s FROM d), t AS (SELECT f::INTEGER AS fold, (s + to_months(18 + 3 * f::INTEGER))::DATE AS t FROM st, range(5) r(f)), "
    "fo AS (SELECT id, fold, CASE WHEN day < t - INTERVAL 3 MONTH THEN 'treino_interno' WHEN day < t THEN 'validacao_interna' ELSE 'teste' END AS papel FROM d, t WHERE day < t + INTERVAL 3 MONTH)"
)
_P = "p AS (SELECT fold, y_colapsado AS y_true, y_pred, y_original, scores['mercado'] AS sc FROM predictions)"
_AUC = (
    "pt AS (SELECT fold, sc, sum((y_true = 'mercado')::INTEGER) AS tp, count(*) AS n FROM p WHERE sc IS NOT NULL AND y_true IS NOT NULL GROUP BY 1, 2), "
    "cu AS (SELECT fold, sc, tp, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER (PARTITION BY fold) AS pos, sum(n) OVER (PARTITION BY fold) AS al FROM pt WINDOW w AS (PARTITION BY fold ORDER BY sc DESC)), "
    "ar AS (SELECT fold, pos, al, tp, ctp / cn::DOUBLE AS p1, coalesce(lag(ctp / cn::DOUBLE) OVER (PARTITION BY fold ORDER BY sc DESC), 1.0) AS p0 FROM cu), "
    "auc AS (SELECT fold, round(CASE WHEN any_value(pos) > 0 AND any_value(pos) < any_value(al) THEN sum(tp * (p1 + p0) / 2) / any_value(pos) END, 8) AS pr_auc FROM ar GROUP BY 1)"
)
_F1 = (
    "ev AS (SELECT fold, y_true AS c, 1 AS t, 0 AS q, coalesce((y_true = y_pred)::INTEGER, 0) AS tp FROM p UNION ALL SELECT fold, y_pred, 0, 1, 0 FROM p), "
    "cl AS (SELECT fold, c, sum(t)::BIGINT AS t, coalesce(2.0 * sum(tp) / nullif(sum(t) + sum(q), 0), 0) AS f1 FROM ev WHERE c IS NOT NULL GROUP BY 1, 2), "
    "mf AS (SELECT fold, round(coalesce(max(f1) FILTER (c = 'mercado'), 0.0), 8) AS f1_binario_projetado, round(sum(f1) / (SELECT count(DISTINCT c) FROM cl), 8) AS macro_f1, sum(t)::BIGINT AS n_teste, coalesce(max(t) FILTER (c = 'mercado'), 0)::BIGINT AS n_mercado_teste FROM cl GROUP BY 1)"
)
_V = (
    f"v0 AS (SELECT link, min(date) AS day, arg_min(embedding, (date, to_json(embedding)::VARCHAR)) AS embedding FROM article_vectors WHERE embedding IS NOT NULL AND date IS NOT NULL GROUP BY 1), "
    f"v AS (SELECT * FROM v0 WHERE day >= DATE '{START}' AND day < DATE '{LAST_MONTH}')"
)
_WIN = "w AS (SELECT *, (dense_rank() OVER (ORDER BY date_trunc('month', day)) - 1)::INTEGER AS janela_idx, strftime(day, '%Y-%m') AS rotulo FROM v)"
_CEN = "e AS (SELECT janela_idx, rotulo, (generate_subscripts(embedding, 1) - 1)::INTEGER AS dim, unnest(embedding)::DOUBLE AS x FROM w), c AS (SELECT janela_idx, rotulo, dim, avg(x) AS v, count(*) AS n FROM e GROUP BY 1, 2, 3)"
_COS = "round(coalesce(1 - sum(a * b) / nullif(sqrt(sum(a * a)) * sqrt(sum(b * b)), 0), 1.0), 6) AS valor"
_DIM = (
    "k AS (SELECT janela_idx AS par, 0 AS lado, dim, x FROM e UNION ALL SELECT janela_idx - 1, 1, dim, x FROM e), "
    "k2 AS (SELECT * FROM k WHERE par >= 0 AND par < (SELECT max(janela_idx) FROM w)), "
    "g AS (SELECT par, dim, x, count(*) FILTER (lado = 0) AS a, count(*) FILTER (lado = 1) AS b FROM k2 GROUP BY 1, 2, 3), "
    "s AS (SELECT par, dim, a, b, sum(a) OVER o AS ca, sum(b) OVER o AS cb, sum(a) OVER z AS n, sum(b) OVER z AS m FROM g WINDOW o AS (PARTITION BY par, dim ORDER BY x), z AS (PARTITION BY par, dim))"
)
_RES = "r AS (SELECT *, CASE WHEN regexp_full_match(janela_a, '[0-9]{4}-[0-9]{2}') THEN 'mensal' ELSE 'bisemanal' END AS granularidade FROM drift_results)"
_KEPT = "x AS (SELECT * FROM r WHERE NOT (granularidade = 'mensal' AND coalesce(janela_a = '2017-10' OR janela_b = '2017-10', false)))"
_TAB = "tb AS (SELECT escopo, granularidade, teste, condicao, count(*) AS n, avg(p_value) AS mean, coalesce(stddev_samp(p_value), 0.0) AS std, quantile_cont(p_value, 0.25) AS q25, quantile_cont(p_value, 0.5) AS q50, quantile_cont(p_value, 0.75) AS q75 FROM x GROUP BY 1, 2, 3, 4)"
_TABOUT = "SELECT escopo, granularidade, teste, condicao, n, round(mean, 8) AS mean, round(std, 8) AS std, round(q25, 8) AS q25, round(q50, 8) AS q50, round(q75, 8) AS q75 FROM tb"
_IDX = "(row_number() OVER (PARTITION BY escopo, condicao, repeticao, teste ORDER BY janela_a, janela_b, p_value NULLS FIRST, estatistica NULLS FIRST) - 1) AS par_idx"

ORACLE_SQL = {
    "folds_rolling": f"WITH {_DATED}, {_FOLDS} SELECT * FROM fo",
    "folds_kfold": f"WITH {_DATED}, n AS (SELECT id, category AS y, row_number() OVER (ORDER BY category NULLS LAST, {_KEY.format('2026')}, id) - 1 AS p FROM d) SELECT id, y, (p % 5)::INTEGER AS fold, (p // 5) % 5 = 0 AS validacao_interna FROM n",
    "subamostra_por_mes": f"WITH {_DATED}, m AS (SELECT date_trunc('month', day)::DATE AS mes, count(*) AS n FROM d GROUP BY 1), q AS (SELECT mes, greatest(1, round_even(n * least(1.0::DOUBLE, 1000.0::DOUBLE / (SELECT sum(n) FROM m)), 0)) AS quota FROM m), k AS (SELECT id, date_trunc('month', day)::DATE AS mes, {_KEY.format('2026')} AS k FROM d) SELECT id, mes FROM k JOIN q USING (mes) QUALIFY row_number() OVER (PARTITION BY mes ORDER BY k, id) <= quota",
    "leakage_por_fold": f"WITH {_DATED}, {_FOLDS}, dn AS (SELECT id AS article_id, text FROM d), {near_sql('dn')}, "
    "pr AS (SELECT x.id AS id_a, y.id AS id_b FROM mb x JOIN mb y ON x.rep = y.rep AND x.id < y.id UNION ALL SELECT x.id, y.id FROM np JOIN mb x ON x.rep = id_a JOIN mb y ON y.rep = id_b), "
    "l AS (SELECT id, fold, CASE WHEN papel = 'teste' THEN 'teste' ELSE 'treino' END AS lado FROM fo), j AS (SELECT x.fold, x.lado AS la, y.lado AS lb FROM pr JOIN l x ON x.id = id_a JOIN l y ON y.id = id_b AND y.fold = x.fold), "
    "al AS (SELECT fold, la, lb FROM j UNION ALL SELECT DISTINCT fold, NULL, NULL FROM l) "
    "SELECT fold, count(la) AS pares_presentes, count(*) FILTER (la <> lb) AS pares_cruzando_treino_teste, count(*) FILTER (la = 'treino' AND lb = 'treino') AS pares_dentro_treino, count(*) FILTER (la = 'teste' AND lb = 'teste') AS pares_dentro_teste, round(coalesce(count(*) FILTER (la <> lb) / nullif(count(la), 0)::DOUBLE, 0), 8) AS fracao_cruzando FROM al GROUP BY ROLLUP (fold)",
    "matriz_confusao": f"WITH {_P} SELECT fold, y_true, y_pred, count(*) AS n FROM p GROUP BY 1, 2, 3",
    "metricas_fold": f"WITH {_P}, {_F1}, {_AUC} SELECT mf.*, pr_auc FROM mf LEFT JOIN auc ON mf.fold = auc.fold",
    "pr_auc": f"WITH {_P}, {_AUC} SELECT * FROM auc",
    "composicao_fp": f"WITH {_P} SELECT fold, y_original, count(*) AS n FROM p WHERE y_pred = 'mercado' AND y_true <> 'mercado' GROUP BY 1, 2",
    "classe_majoritaria": f"WITH {_DATED} SELECT category, count(*) AS n FROM d WHERE category IS NOT NULL GROUP BY 1 ORDER BY n DESC, category LIMIT 1",
    "janelas_mensais": f"WITH {_DATED} SELECT (row_number() OVER (ORDER BY date_trunc('month', day)) - 1)::INTEGER AS janela_idx, strftime(any_value(day), '%Y-%m') AS rotulo, date_trunc('month', any_value(day))::DATE AS inicio, (date_trunc('month', any_value(day)) + INTERVAL 1 MONTH)::DATE AS fim, count(*) AS n FROM d GROUP BY date_trunc('month', day)",
    "janelas_bisemanais": f"WITH {_DATED}, o AS (SELECT date_trunc('month', min(day))::DATE AS o, max(day) AS l FROM d), k AS (SELECT o, ((day - o) // 14)::INTEGER AS k, l FROM d, o), g AS (SELECT k, any_value(o) + k * 14 AS inicio, count(*) AS n FROM k WHERE (k + 1) * 14 <= l - o + 1 GROUP BY k) SELECT (row_number() OVER (ORDER BY k) - 1)::INTEGER AS janela_idx, strftime(inicio, '%Y-%m-%d') || '_' || strftime(inicio + 13, '%Y-%m-%d') AS rotulo, inicio, inicio + 14 AS fim, n FROM g",
    "particoes_aleatorias": f"WITH {_DATED}, m AS (SELECT date_trunc('month', day) AS mes, count(*) AS n FROM d GROUP BY 1), s AS (SELECT (row_number() OVER (ORDER BY mes) - 1)::INTEGER AS i, sum(n) OVER (ORDER BY mes) - n AS f, sum(n) OVER (ORDER BY mes) AS u FROM m), k AS (SELECT r::INTEGER AS r, id, row_number() OVER (PARTITION BY r ORDER BY ('0x' || substr(md5((2026 + r) || ':' || id), 1, 15))::BIGINT, id) - 1 AS p FROM d, range(5) t(r)) SELECT r AS repeticao, id, i AS janela_idx, 'rand_' || lpad(i::VARCHAR, 3, '0') AS rotulo FROM k JOIN s ON p >= f AND p < u",
    "filtro_periodo": f"SELECT article_id, day FROM {ART} WHERE day >= DATE '2015-06-01' AND day < DATE '2016-06-01'",
    "filtro_escopo_global": f"SELECT article_id, category FROM {ART}",
    "filtro_escopo_mercado": f"SELECT article_id, category FROM {ART} WHERE category = 'mercado'",
    "filtro_escopo_nao_mercado": f"SELECT article_id, category FROM {ART} WHERE category IS DISTINCT FROM 'mercado'",
    "alinhar_embeddings": f"WITH {_V}, c AS (SELECT link, arg_min_null(category, article_id) AS category FROM {ART} GROUP BY 1) SELECT v.link, day, category FROM v JOIN c ON v.link = c.link",
    "centroides": f"WITH {_V}, {_WIN}, {_CEN} SELECT janela_idx, rotulo, n, dim, round(v, 6) AS valor FROM c",
    "cosseno_consecutivo": f"WITH {_V}, {_WIN}, {_CEN}, z AS (SELECT x.rotulo AS ja, y.rotulo AS jb, x.v AS a, y.v AS b FROM c x JOIN c y ON y.janela_idx = x.janela_idx + 1 AND x.dim = y.dim) SELECT 'cosine_centroid' AS metrica, ja AS janela_a, jb AS janela_b, {_COS} FROM z GROUP BY ja, jb",
    "cosseno_cumulativo": f"WITH {_V}, {_WIN}, {_CEN}, h AS (SELECT rotulo AS jb, janela_idx, lag(rotulo) OVER q AS ja, v AS b, avg(v) OVER (PARTITION BY dim ORDER BY janela_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a FROM c WINDOW q AS (PARTITION BY dim ORDER BY janela_idx)) SELECT 'cumulative_cosine' AS metrica, 'historico_ate_' || ja AS janela_a, jb AS janela_b, {_COS} FROM h WHERE ja IS NOT NULL GROUP BY ja, jb",
    "ks_por_dimensao": f"WITH {_V}, {_WIN}, {_CEN}, {_DIM} SELECT par, dim, round(max(abs(ca / n::DOUBLE - cb / m::DOUBLE)), 8) AS estatistica, any_value(n)::BIGINT AS n, any_value(m)::BIGINT AS m FROM s GROUP BY par, dim",
    "cvm_por_dimensao": f"WITH {_V}, {_WIN}, {_CEN}, {_DIM} SELECT par, dim, round(sum((a + b) * pow(ca / n::DOUBLE - cb / m::DOUBLE, 2) * n * m / pow(n::DOUBLE + m, 2)), 6) AS estatistica, any_value(n)::BIGINT AS n, any_value(m)::BIGINT AS m FROM s GROUP BY par, dim",
    "fisher_combinado": f"WITH {_V}, {_WIN}, {_CEN}, {_DIM}, kd AS (SELECT par, dim, max(abs(ca / n::DOUBLE - cb / m::DOUBLE)) * sqrt(any_value(n)::DOUBLE * any_value(m) / (any_value(n) + any_value(m))) AS t FROM s GROUP BY par, dim), "
    "kp AS (SELECT par, CASE WHEN t < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, 2 * list_sum(list_transform(generate_series(1, 100), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * k * k * t * t))))) END AS p FROM kd), "
    "fx AS (SELECT par, -2 * sum(ln(least(1.0, greatest(p, 1e-300)))) AS x, count(*) AS dims FROM kp GROUP BY par) "
    "SELECT par, 'KS' AS teste, round(CASE WHEN x <= 0 THEN 1.0 ELSE least(1.0, list_sum(list_transform(generate_series(0, dims - 1), lambda i: exp(i * ln(x / 2) - lgamma(i + 1) - x / 2)))) END, 6) AS p_value, round(x, 6) AS estatistica FROM fx",
    "mmd2_exato": f"WITH {_V}, {_WIN}, b AS (SELECT janela_idx AS par, 0 AS lado, link, embedding::DOUBLE[] AS e FROM w UNION ALL SELECT janela_idx - 1, 1, link, embedding::DOUBLE[] FROM w), "
    "c AS (SELECT * FROM b WHERE par >= 0 AND par < (SELECT max(janela_idx) FROM w)), g AS (SELECT x.par, x.lado AS la, y.lado AS lb, x.link < y.link AS up, pow(list_distance(x.e, y.e), 2) AS d FROM c x JOIN c y ON x.par = y.par), "
    "s AS (SELECT par, greatest(median(d) FILTER (up), 1e-18) AS v FROM g GROUP BY par), k AS (SELECT g.par, la, lb, exp(-d / (2 * coalesce(v, 1.0))) AS k FROM g JOIN s ON s.par = g.par) "
    "SELECT par, round(avg(k) FILTER (la = 1 AND lb = 1) + avg(k) FILTER (la = 0 AND lb = 0) - 2 * avg(k) FILTER (la = 0 AND lb = 1), 6) AS valor FROM k GROUP BY par",
    "corrida_principal": f"WITH {_RES}, u AS (SELECT granularidade, escopo, condicao || '-' || repeticao AS ts, count(*) AS n, condicao = 'time_ordered' AND repeticao = 1 AS smoke FROM r GROUP BY granularidade, escopo, condicao, repeticao) SELECT granularidade, escopo, ts, n FROM u WHERE NOT smoke QUALIFY row_number() OVER (PARTITION BY granularidade, escopo ORDER BY n DESC, ts DESC) = 1",
    "par_idx": f"SELECT *, {_IDX} FROM drift_results",
    "filtro_janela_invalida": f"WITH {_RES}, {_KEPT} SELECT * FROM x",
    "tabela_p_values": f"WITH {_RES}, {_KEPT}, {_TAB} {_TABOUT}",
    "tabela_replica": f"WITH {_RES}, {_KEPT}, {_TAB} {_TABOUT} WHERE escopo = 'global' AND granularidade = 'mensal'",
    "tabela_condicional": f"WITH {_RES}, {_KEPT}, {_TAB} {_TABOUT} WHERE escopo IN ('mercado', 'nao_mercado') AND granularidade = 'mensal'",
    "tabela_anexo_bisemanal": f"WITH r AS (SELECT * REPLACE (janela_a || '-01_' || janela_a || '-14' AS janela_a, janela_b || '-01_' || janela_b || '-14' AS janela_b), 'bisemanal' AS granularidade FROM drift_results), {_KEPT}, {_TAB} {_TABOUT}",
    "condicoes_pareadas": f"WITH i AS (SELECT *, {_IDX} FROM drift_results), o AS (SELECT escopo, teste, par_idx, min(p_value) AS p FROM i WHERE condicao = 'time_ordered' GROUP BY ALL), z AS (SELECT escopo, teste, par_idx, avg(p_value) AS m, min(p_value) AS lo, max(p_value) AS hi FROM i WHERE condicao = 'randomized' GROUP BY ALL) SELECT coalesce(o.escopo, z.escopo) AS escopo, coalesce(o.teste, z.teste) AS teste, coalesce(o.par_idx, z.par_idx) AS par_idx, round(p, 8) AS ordenado, round(m, 8) AS medio, round(lo, 8) AS minimo, round(hi, 8) AS maximo FROM o FULL JOIN z ON o.escopo = z.escopo AND o.teste = z.teste AND o.par_idx = z.par_idx",
    "linhas_descartadas": f"WITH {_RES} SELECT granularidade, escopo, count(*) FILTER (granularidade = 'mensal' AND coalesce(janela_a = '2017-10' OR janela_b = '2017-10', false)) AS linhas FROM r GROUP BY 1, 2",
    "gap_condicoes": f"WITH {_RES}, {_KEPT}, {_TAB}, g AS (SELECT escopo, granularidade, avg(mean) FILTER (condicao = 'time_ordered') AS o, avg(mean) FILTER (condicao = 'randomized') AS z FROM tb GROUP BY 1, 2) SELECT escopo, granularidade, round(o, 8) AS time_ordered, round(z, 8) AS randomized, round(z - o, 8) AS gap FROM g",
    "envelope_kts": f"WITH i AS (SELECT *, {_IDX} FROM drift_results) SELECT escopo, par_idx, min(p_value) AS min, max(p_value) AS max FROM i WHERE teste = 'KTS' AND condicao = 'randomized' GROUP BY 1, 2",
}
