"""Whole drift runs into run folders, and the report that is assembled from them."""

from __future__ import annotations

from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift as D
from ..session import cut
from ..sources import artifacts, tables

MOST_ROWS = 10_000
GRANULARITIES = {"mensal": "month", "bisemanal": "14"}
TABLES = (
    ("tabela_replica", "Réplica (global, mensal)", ("mensal",), ("global",)),
    ("tabela_condicional", "Análise condicional (mercado e não mercado, mensal)", ("mensal",), ("mercado", "nao_mercado")),
    ("tabela_anexo_bisemanal", "Robustez com janelas bisemanais", ("bisemanal",), None),
)


def windows_of(rows: DataFrame, granularity: str) -> DataFrame:
    """The windows of ``rows(day)`` by the name of their granularity."""
    if granularity not in GRANULARITIES:
        raise ValueError(f"unknown granularity: {granularity}; known: {sorted(GRANULARITIES)}")
    return D.monthly_windows(rows) if granularity == "mensal" else D.fortnightly_windows(rows, int(GRANULARITIES[granularity]))


def run_drift(
    vectors: DataFrame, corpus: DataFrame, out: str | Path, block: str, granularity: str, scope: str, period: tuple[str, str],
    repetitions: int = 5, permutations: int = 100, limit_pairs: int | None = None, seed: int = 2026,
) -> Path:
    """A drift run on ``vectors(link, day, embedding)`` of the scope's articles in ``corpus(link, category)``, written to a
    new folder: ``results.parquet`` and ``metadata.json``.

    ``block`` is ``statistical`` or ``semantic``. With ``limit_pairs`` only the first pairs of windows are kept (a smoke
    run, which the report passes over). Fewer than two windows are an error.
    """
    started = datetime.now(timezone.utc)
    aligned = D.aligned(vectors, corpus.select("link", "category"))
    rows = cut(D.in_scope(D.in_period(aligned, *period), scope).select(F.col("link").alias("id"), "day", "embedding"), "drift-rows")
    windows = cut(windows_of(rows, granularity), "drift-windows")
    if limit_pairs is not None:
        windows = windows.filter(F.col("janela_idx") <= limit_pairs)
        ends = windows.agg(F.max("fim")).first()[0]
        rows = rows.filter(F.col("day") < F.lit(ends))
    folder = artifacts.drift_folder(out, block, scope, granularity, started)
    unit = GRANULARITIES[granularity]
    if block == "statistical":
        found = D.statistical_drift(rows, windows, repetitions, permutations, seed, unit)
    else:
        found = D.semantic_drift(rows, windows, repetitions, seed, unit)
    artifacts.write_table(found.withColumn("escopo", F.lit(scope)), str(folder / "results.parquet"))
    shown = [r.asDict() for r in windows.orderBy("janela_idx").limit(MOST_ROWS).collect()]
    about = {"bloco": block, "escopo": scope, "granularidade": granularity, "n_artigos": rows.count(), "janelas": shown, "n_repeticoes": repetitions, "n_permutations": permutations, "limite_pares": limit_pairs}
    artifacts.write_json(folder / "metadata.json", artifacts.metadata(seed, None, started, **about))
    return folder


def read_runs(spark: SparkSession, root: str | Path) -> tuple[DataFrame, list[dict]] | None:
    """Results of all run folders below ``root`` with their run's ``ts, granularidade, escopo``, and a row about each run;
    folders without metadata or results are passed over. None if there is no run."""
    results, about = None, []
    for folder in tables.find_runs(root):
        run = tables.read_run(spark, folder)
        if run is None:
            continue
        extras = run[0]["extras"]
        keys = {"ts": folder.name, "granularidade": extras["granularidade"], "escopo": extras["escopo"]}
        rows = run[1].withColumns({k: F.lit(v) for k, v in keys.items()})
        results = rows if results is None else results.unionByName(rows)
        about.append({**keys, "limite_pares": extras.get("limite_pares"), "git_commit": run[0].get("git_commit"), "duracao_s": run[0].get("duracao_s"), "criado_em": run[0].get("criado_em")})
    return (results, about) if about else None


def _rows(df: DataFrame, *order: str) -> list[dict]:
    """A small report as rows; more than MOST_ROWS are an error."""
    rows = df.orderBy(*order).limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows")
    return [r.asDict() for r in rows]


def drift_report(spark: SparkSession, root: str | Path, out: str | Path, invalid: str = "2017-10") -> Path:
    """Assemble the report on the statistical runs below ``root``: of each granularity and scope the main run, without the
    pairs that touch the ``invalid`` month, in three tables (CSV and Markdown), with counts of what was dropped, the gap of
    the conditions, paired p values for figures, and the runs used. Gives its folder. No run is an error."""
    found = read_runs(spark, root)
    if found is None:
        raise FileNotFoundError(f"no run below {root}")
    results, about = cut(found[0], "report-rows"), found[1]
    counted = results.groupBy("ts", "granularidade", "escopo").agg(F.count("*").alias("n"))
    known = spark.createDataFrame([(a["ts"], a["limite_pares"]) for a in about], "ts string, limite_pares long")
    main = cut(D.main_runs(counted.join(known, "ts")).select("ts", "granularidade", "escopo", "n"), "main-runs")
    if main.isEmpty():
        raise ValueError("only smoke runs")
    mine = results.join(main.select("ts"), "ts", "left_semi")
    kept = cut(D.without_window(mine, invalid), "kept")
    dropped = _rows(D.dropped_rows(mine, invalid), "granularidade", "escopo")
    table = cut(D.p_value_table(kept), "p-values")
    folder = artifacts.run_folder(out, "analise")
    text = ["# Análise de deriva", "", "## Linhas descartadas", "", f"Pares mensais que tocam {invalid}.", "", artifacts.markdown(dropped, ("granularidade",))]
    gaps = _rows(D.condition_gap(table), "escopo", "granularidade")
    text += ["## Lacuna entre as condições", "", artifacts.markdown(gaps, ("granularidade",))]
    used = [{**m, **{k: a[k] for k in ("git_commit", "duracao_s", "criado_em")}} for m in _rows(main, "granularidade", "escopo") for a in about if a["ts"] == m["ts"]]
    text += ["## Corridas usadas", "", artifacts.markdown(used, ("granularidade",))]
    for name, title, granularities, scopes in TABLES:
        chosen = D.restricted(table, granularities, scopes)
        rows = _rows(chosen, "escopo", "granularidade", "teste", "condicao")
        artifacts.write_rows_csv(rows, folder / f"{name}.csv")
        body = artifacts.markdown(rows)
        (folder / f"{name}.md").write_text(f"# {title}\n\n{body}", encoding="utf-8")
        text += [f"## {title}", "", body]
    artifacts.write_json(folder / "corridas.json", used)
    artifacts.write_table(D.paired_conditions(kept), str(folder / "pares.parquet"))
    (folder / "analise.md").write_text("\n".join(text), encoding="utf-8")
    return folder


EDA: dict[int, tuple[str, ...]] = {
    1: ("perfil_colunas", "top_categorias_outras", "prevalencia_global", "tabela_ano_pos_neg"),
    2: ("serie_mensal_prevalencia", "serie_semanal_prevalencia", "serie_diaria_prevalencia", "cobertura_temporal"),
    3: ("mann_kendall", "z_proporcoes", "qui_quadrado", "deriva_por_categoria"),
    4: ("prevalencia_dia_semana", "prevalencia_mes_ano", "heatmap_mes_ano"),
    5: ("dias_zero", "anomalias_diarias"),
    6: ("tfidf_top_k", "sobreposicao_tokens", "sobreposicao_todas"),
    7: ("resumo_duplicatas", "pares_enriquecidos", "pares_distantes", "afetadas_near", "resumo_deduplicacao"),
    8: ("estatisticas_texto", "tokens_top_k_por_grupo", "jaccard_consecutivo", "psi_vs_baseline"),
}


#: Columns by whose falling values a table is ordered first; all are then in order of their columns.
ORDERS = {"sobreposicao_tokens": ("jaccard_top30",), "deriva_por_categoria": ("n_total",), "top_categorias_outras": ("contagem",)}


def eda_section(spark: SparkSession, folder: str, number: int, out: str | Path, show: int = 10) -> list[Path]:
    """Write the tables of a section below ``out`` as CSV, print the head of each, and give their paths."""
    from .queries import QUERIES

    if number not in EDA:
        raise ValueError(f"unknown section: {number}; known: {sorted(EDA)}")
    paths = []
    for name in EDA[number]:
        path = Path(out) / f"{number:02d}-{name.replace('_', '-')}"
        result = cut(QUERIES[name](spark, folder), "section")
        result = result.orderBy(*(F.desc(c) for c in ORDERS.get(name, ())), *(c for c, t in result.dtypes if not t.startswith("map")))
        artifacts.write_csv(result.select(*(F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else c for c, t in result.dtypes)), str(path))
        print(f"== {path.name}: {result.count()} rows")
        result.show(show, truncate=40)
        paths.append(path)
    return paths
