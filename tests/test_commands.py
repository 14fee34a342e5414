"""Whole commands on small folders."""

import json

import pytest
from pyspark.sql import functions as F

from vazante import cli
from vazante.operators import drift as D
from vazante.operators import encoders as E
from vazante.plans import reports, scenario
from vazante.sources import artifacts


@pytest.fixture(scope="module")
def corpus(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("prepared")
    assert cli.main(["prepare", "--data", folder, "--out", str(out), "--threshold", "5"]) == 0
    return out


def test_prepare_writes_rollups_and_a_manifest(spark, corpus):
    manifest = json.loads((corpus / "manifest.json").read_text())
    assert set(manifest["recortes"]) == set(scenario.ROLLUPS) and manifest["sem_copias"] <= manifest["com_data_e_texto"]
    for name, about in manifest["recortes"].items():
        rows = spark.read.parquet(str(corpus / f"corpus_{name}.parquet"))
        assert rows.count() == about["linhas"] and rows.filter("text is null or day is null").isEmpty()
        assert len(about["sha256"]) == 64


def made(spark):
    """Thirty-three months of two clear classes and a third."""
    words = {"mercado": "juros banco lucro", "esporte": "gol time placar", "outros": "chuva sol vento"}
    rows = [(k, f"l{k}", None, f"{w} caso {k % 7}", y, y, k % 9 == 0) for k, (y, w) in enumerate(list(words.items()) * 130)]
    df = spark.createDataFrame(rows, "id long, link string, title string, text string, y_original string, y_colapsado string, eh_duplicata_text boolean")
    return df.withColumn("day", F.expr("date_add(date'2015-01-01', cast(id * 26 div 10 as int))"))


def test_primary_scenario_and_ablation(spark, tmp_path):
    pairs = spark.createDataFrame([(0, 3), (1, 380)], "id_a long, id_b long")
    families = {"logreg": scenario.with_limit(scenario.FAMILIES["logreg"], 2)}
    run = scenario.run_scenario(made(spark), "logreg", "anchors", "rolling", "multi", tmp_path, pairs=pairs, families=families)
    summary, hp = (json.loads((run / f"{n}.json").read_text()) for n in ("summary", "hp"))
    assert len(summary["por_fold"]) == 5 and summary["f1_binario_projetado"]["media"] == 1.0
    assert set(hp) == {str(k) for k in range(5)} and hp["0"] == {"c": 0.1, "balanced": False}
    assert (run / "folds/fold_0/hp_search.csv").read_text().count("\n") == 3
    found = spark.read.parquet(str(run / "folds/fold_4/predictions.parquet"))
    assert {"y_pred", "score_mercado", "score_esporte", "eh_duplicata_text"} <= set(found.columns) and found.count() == summary["por_fold"][4]["n_teste"]
    assert json.loads((run / "leakage.json").read_text())[-1]["fold"] is None
    about = json.loads((run / "metadata.json").read_text())["extras"]
    assert about["n_classes"] == 3 and about["n_folds"] == 5 and "done" in (run / "run.log").read_text()

    with pytest.raises(ValueError, match="primary"):
        scenario.run_scenario(made(spark), "logreg", "anchors", "kfold", "bin", tmp_path / "x", families=families)
    other = scenario.run_scenario(made(spark), "logreg", "anchors", "kfold", "bin", tmp_path, hp_from=run, limit=200)
    summary = json.loads((other / "summary.json").read_text())
    assert sum(m["n_teste"] for m in summary["por_fold"]) == pytest.approx(200, abs=15) and not (other / "leakage.json").exists()


def test_other_families(spark, tmp_path):
    class Names:
        def __call__(self, prompts):
            return ["mercado" if "juros" in p else "nada" for p in prompts]

    rows = made(spark)
    said = scenario.run_scenario(rows, "gerador", "fixed", "rolling", "multi", tmp_path, families={"gerador": scenario.zero_shot(Names, "Classe? {text}")})
    fold = json.loads((said / "folds/fold_1/metrics.json").read_text())
    assert fold["f1_binario_projetado"] == 1.0 and 0.6 < fold["taxa_fora_do_rotulo"] < 0.7 and json.loads((said / "hp.json").read_text())["0"]["prompt"]
    run = scenario.run_scenario(rows, "vetores", "anchors", "rolling", "multi", tmp_path, families={"vetores": scenario.with_limit(scenario.encoded(), 1)})
    assert json.loads((run / "summary.json").read_text())["macro_f1"]["media"] > 0.9
    with pytest.raises(ValueError, match="unknown family"):
        scenario.family_of("nenhuma")


def test_kfold_roles(spark):
    folds = scenario.folds_of(made(spark), "kfold")
    assert folds.count() == 390 * 5
    assert folds.filter("papel = 'teste'").groupBy("id").count().filter("count <> 1").isEmpty()
    with pytest.raises(ValueError, match="protocol"):
        scenario.folds_of(made(spark), "outro")


def test_encoder(spark):
    docs = spark.createDataFrame([(1, "Ação boa"), (2, "acao BOA"), (3, None), (4, "acao boa extra")], "link long, text string")
    got = {r.link: r.embedding for r in E.embed(docs, keep=["link"], batch=2).collect()}
    assert got[1] == got[2] and not any(got[3]) and len(got[1]) == 64 and got[4] != got[1]
    cut = {r.link: r.embedding for r in E.embed(docs, keep=["link"], words=2).collect()}
    assert cut[4] == cut[1]


def test_drift_runs_and_report(spark, corpus, tmp_path):
    path = str(corpus / "corpus_anchors.parquet")
    assert cli.main(["embed", "--corpus", path, "--out", str(tmp_path), "--width", "6"]) == 0
    vectors = str(tmp_path / "embeddings/hashed_words/embeddings.parquet")
    common = ["drift", "--corpus", path, "--vectors", vectors, "--out", str(tmp_path), "--repetitions", "1", "--permutations", "9", "--period", "2015-01-01", "2015-07-01"]
    with pytest.raises(FileNotFoundError):
        reports.drift_report(spark, tmp_path / "statistical", tmp_path)
    assert cli.main([*common, "--limit-pairs", "1"]) == 0
    with pytest.raises(ValueError, match="smoke"):
        reports.drift_report(spark, tmp_path / "statistical", tmp_path)
    for more in ([], ["--granularity", "bisemanal"], ["--block", "semantic"]):
        assert cli.main([*common, *more]) == 0
    assert cli.main(["report", "--runs", str(tmp_path / "statistical"), "--out", str(tmp_path / "reports")]) == 0
    (report,) = (tmp_path / "reports").iterdir()
    runs = json.loads((report / "corridas.json").read_text())
    assert [r["granularidade"] for r in runs] == ["bisemanal", "mensal"]
    text = (report / "analise.md").read_text()
    assert "Linhas descartadas" in text and "KTS" in text
    # 5 pairs of months, 4 tests, two conditions
    assert (report / "tabela_replica.csv").read_text().count("\n") == 1 + 8
    assert (report / "tabela_anexo_bisemanal.csv").read_text().count("\n") == 1 + 8
    assert spark.read.parquet(str(report / "pares.parquet")).filter("ordenado is not null").count() > 0
    (semantic,) = (tmp_path / "semantic").iterdir()
    assert spark.read.parquet(str(semantic / "results.parquet")).select("condicao").distinct().count() == 2


def test_dropped_rows_and_restriction(spark):
    rows = [("mensal", "global", a, b, "KS", "time_ordered", 0, 0.1, 1.0) for a, b in (("2017-08", "2017-09"), ("2017-09", "2017-10"))]
    rows += [("bisemanal", "global", "2017-10", "2017-10", "KS", "randomized", 1, 0.5, 1.0)]
    df = spark.createDataFrame(rows, "granularidade string, escopo string, janela_a string, janela_b string, teste string, condicao string, repeticao int, p_value double, estatistica double")
    assert {(r.granularidade, r.linhas) for r in D.dropped_rows(df).collect()} == {("mensal", 1), ("bisemanal", 0)}
    assert D.restricted(df, ["mensal"], None).count() == 2 and D.restricted(df, None, ["x"]).count() == 0
    assert {(r.par_idx, r.ordenado, r.medio) for r in D.paired_conditions(df).collect()} == {(0, 0.1, 0.5), (1, 0.1, None)}


def test_drift_folders(tmp_path):
    assert artifacts.drift_folder(tmp_path, "embeddings", "x") == artifacts.drift_folder(tmp_path, "embeddings", "x")
    one, two = (artifacts.drift_folder(tmp_path, "statistical", "global", "mensal") for _ in range(2))
    assert one != two and one.parent.name == "statistical"
    assert "diario" in artifacts.drift_folder(tmp_path, "change_points", "global").name
    for wrong in (("outro", "global", "mensal"), ("semantic", "mundo", "mensal"), ("semantic", "global", None)):
        with pytest.raises(ValueError):
            artifacts.drift_folder(tmp_path, *wrong)


def test_eda_section(spark, folder, tmp_path, capsys):
    assert cli.main(["eda", "--data", folder, "--out", str(tmp_path), "--section", "5"]) == 0
    assert {p.name for p in tmp_path.iterdir()} == {"05-dias-zero", "05-anomalias-diarias"}
    assert "05-dias-zero" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["eda", "--data", folder, "--out", str(tmp_path), "--section", "9"])


def test_load_and_digest(spark, tmp_path):
    import zipfile

    path = tmp_path / "a.csv"
    path.write_text('title,text,date,category,subcategory,link\n"a","x\ny",2015-01-01,Poder,,l1\nb,,2015-02-30,,s,l2\n', encoding="utf-8")
    assert cli.main(["load", "--csv", str(path), "--out", str(tmp_path / "t")]) == 0
    rows = spark.read.parquet(str(tmp_path / "t/articles.parquet")).orderBy("article_id").collect()
    assert [(r.article_id, r.title, r.text) for r in rows] == [(0, "a", "x\ny"), (1, "b", None)]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.write(path, "in/a.csv")
    args = ["digest", "--file", str(tmp_path / "a.zip"), "--register", str(tmp_path / "r"), "--extract", str(tmp_path / "o")]
    assert cli.main(args) == 0 and (tmp_path / "o/in/a.csv").exists()
    (tmp_path / "r").write_text("0" * 64)
    assert cli.main(args) == 2
