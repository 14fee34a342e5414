import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vazante.operators import models as M
from vazante.sources import artifacts as A
from vazante.sources import tables as S
from vazante.streaming import series


def test_articles_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('title,text,date,category,subcategory,link\n"a ""x"", y","linha 1\nlinha 2",2016-02-30, MERCÁDO ,NA,u\nb,NULL,2016-02-29,,x,v\n', encoding="utf-8")
    rows = {r.link: r for r in S.read_articles_csv(spark, str(path)).collect()}
    assert rows["u"].title == 'a "x", y' and rows["u"].text == "linha 1\nlinha 2" and rows["u"].day is None and rows["u"].category == "mercado"
    assert rows["u"].subcategory is None and rows["v"].text is None and rows["v"].category is None and rows["v"].day.year == 2016
    bad = tmp_path / "b.csv"
    bad.write_text("title\nx\n")
    with pytest.raises(ValueError, match="text"):
        S.read_articles_csv(spark, str(bad))


def test_pairs_and_tables(spark, tmp_path):
    (tmp_path / "p.csv").write_text("id_a,id_b,j\n1,2,0.9\n")
    assert [tuple(r) for r in S.read_pairs_csv(spark, str(tmp_path / "p.csv")).collect()] == [(1, 2)]
    spark.range(3).write.parquet(str(tmp_path / "t"))
    assert S.read_table(spark, str(tmp_path / "t"), ["id"]).count() == 3
    with pytest.raises(ValueError):
        S.read_table(spark, str(tmp_path / "t"), ["x"])
    assert S.table_digests(spark, str(tmp_path / "p.csv")).first().sha256 == S.file_digest(tmp_path / "p.csv")


def test_digest_register(tmp_path):
    (tmp_path / "f").write_text("um")
    assert S.check_digest(tmp_path / "f", tmp_path / "r") and S.check_digest(tmp_path / "f", tmp_path / "r")
    (tmp_path / "f").write_text("dois")
    assert not S.check_digest(tmp_path / "f", tmp_path / "r")


def test_runs(spark, tmp_path):
    assert S.find_runs(tmp_path / "nada") == []
    run = A.run_folder(tmp_path, "B1", "Mensal Global")
    again = A.run_folder(tmp_path, "B1", "Mensal Global")
    (tmp_path / "_fora").mkdir()
    assert run != again and S.find_runs(tmp_path) == sorted([run, again]) and S.read_run(spark, run) is None
    A.write_json(run / "metadata.json", A.metadata(7, {"a": "b"}, limite_pares=None) | {"ação": "é"})
    A.write_table(spark.range(2), str(run / "results.parquet"))
    meta, rows = S.read_run(spark, run)
    assert meta["seed"] == 7 and meta["ação"] == "é" and rows.count() == 2 and "é" in (run / "metadata.json").read_text(encoding="utf-8")
    A.write_json(run / "hp.json", {"0": {"c": 1.0}})
    assert S.read_best(run) == {"c": 1.0}
    with pytest.raises(FileNotFoundError):
        S.read_best(again)
    log = A.run_logger(run)
    log.info("pronto")
    assert "pronto" in (run / "run.log").read_text(encoding="utf-8")


def test_predictions_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("u", "m", {"m": 0.7, "x": 0.3}), ("v", None, None)], "link string, y_pred string, scores map<string,double>")
    A.write_predictions(df, ["m", "x", "y"], str(tmp_path / "p"))
    back = {r.link: r for r in spark.read.parquet(str(tmp_path / "p")).collect()}
    assert back["u"].score_m == 0.7 and back["u"].score_y is None and back["v"].score_m is None
    A.write_csv(df.drop("scores"), str(tmp_path / "c"))
    assert len(list((tmp_path / "c").glob("*.csv"))) == 1


def test_report():
    assert A.markdown([]) == "_(nenhum dado)_\n"
    text = A.markdown([{"escopo": "g", "granularidade": "m", "teste": "KS", "mean": 0.12345}])
    assert "### g / m" in text and "0.123" in text
    json.dumps(A.metadata(1))


def test_classifiers(spark):
    words = {"a": "gol time placar", "b": "juros banco lucro", "c": "vírus vacina exame"}
    rows = [(k, f"{words[y]} palavra {k % 4}", y) for k, y in enumerate("abc" * 40)] + [(500, None, "a"), (501, "gol", None)]
    docs = spark.createDataFrame(rows, "id long, text string, y string")
    for family in ("logreg", "svm"):
        out = M.train(docs, M.Config(family, min_df=2, iterations=10)).predict(docs)
        right = out.filter("y is not null and text is not null").agg(F.avg((F.col("y") == F.col("y_pred")).cast("double"))).first()[0]
        assert right > 0.95
        sums = out.select(F.aggregate(F.map_values("scores"), F.lit(0.0), lambda s, x: s + x)).first()[0]
        assert len(out.first().scores) == 3 and (family == "svm" or sums == pytest.approx(1))


def test_outside_models(spark):
    docs = spark.createDataFrame([(1, "um texto"), (2, None)], "id long, text string")
    out = {r.id: r for r in M.zero_shot(docs, ["poder", "mercado"], "Classe de {text}?", lambda: lambda prompts: ["Poder, claro" if "um" in p else "???" for p in prompts], "mercado").collect()}
    assert out[1].y_pred == "poder" and not out[1].fora_do_rotulo and out[2].y_pred == "mercado" and out[2].fora_do_rotulo
    sizes = M.score_batches(docs, lambda: lambda b: pd.DataFrame({"n": b["text"].fillna("").map(len)}), "n long")
    assert sorted(r.n for r in sizes.collect()) == [0, 8]


def test_stream_equals_table(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    got = series.drained(series.windowed_counts(stream, "ts", "event_type = 'click'"), "test-stream")
    want = series.windowed_counts(events, "ts", "event_type = 'click'")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
