"""Queries on classifiers and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import models as M
from ..operators import splits as S
from ..schemas import FIVE, POSITIVE
from ..session import cut
from ..streaming import series
from .base import LAST_MONTH, STRIPPED, WHITE, articles, rounded

FAMILIES = ("logreg", "svm")
FOLDS = 5


def _five(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the five-class rollup, and their rolling folds."""
    rows = articles(spark, folder).filter(F.col("category").isin(*FIVE) & (F.col("day") >= "2015-01-01") & (F.col("day") < LAST_MONTH) & F.col("text").isNotNull())
    rows = cut(rows.select(F.col("article_id").alias("id"), "day", "title", "text", F.col("category").alias("y")), "five-classes")
    return rows, cut(S.rolling_folds(rows, FOLDS), "folds")


def _folds(spark: SparkSession, folder: str) -> list[DataFrame]:
    """Each rolling fold of the five-class rollup: ``id, text, y, papel``."""
    rows, folds = _five(spark, folder)
    return [rows.join(folds.filter(F.col("fold") == k).select("id", "papel"), "id").select("id", "title", "text", "y", "papel") for k in range(FOLDS)]


def _predictions(family: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        found = None
        for k, rows in enumerate(_folds(spark, folder)):
            model = M.train(rows.filter("papel <> 'teste'"), M.Config(family))
            out = model.predict(rows.filter("papel = 'teste'").select("id", "title", "text", "y"))
            out = out.select(F.lit(k).alias("fold"), "id", "y", "y_pred", F.try_element_at("scores", F.lit(POSITIVE)).alias("score_mercado"))
            found = out if found is None else found.union(out)
        return rounded(found, 6)

    return query


def grid_search(spark: SparkSession, folder: str) -> DataFrame:
    """Both families' grids on the inner split of every fold, and the choice of each."""
    out = []
    rows, folds = _five(spark, folder)
    bits = lambda role: F.sum(F.when(F.col("papel") == role, F.expr("shiftleft(1, fold)")).otherwise(0)).cast("int")
    parts = folds.groupBy("id").agg(bits("treino_interno").alias("train"), bits("validacao_interna").alias("valid"))
    docs = rows.join(parts, "id").select("title", "text", "y", "train", "valid")
    docs = cut(docs.repartition(spark.sparkContext.defaultParallelism), "parts")
    configs = [M.Config(family, c, balanced) for family in FAMILIES for c, balanced in M.GRID]
    for fold, split in enumerate(M.tried_splits(docs, FOLDS, POSITIVE, configs)):
        for family in FAMILIES:
            tried, best = M.search(split, None, POSITIVE, M.Config(family))
            out += [(fold, family, k, *row, k == best) for k, row in enumerate(tried)]
    return spark.createDataFrame(out, "fold int, familia string, config int, c double, balanced boolean, tp long, fp long, fn long, f1 double, escolhida boolean")


class KeywordStub:
    """Stands in for a text generator: answers with the first class that the prompt names after its question."""

    def __call__(self, prompts: list[str]) -> list[str]:
        return [next((c for c in FIVE if c in p.lower()), "nenhuma") for p in prompts]


def zero_shot(spark: SparkSession, folder: str) -> DataFrame:
    docs = articles(spark, folder).select(F.col("article_id").alias("id"), "title", "text")
    return M.zero_shot(docs, list(FIVE), "Classifique:\n{text}", KeywordStub, "poder").select("id", "y_pred", "fora_do_rotulo")


def stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return series.drained(series.windowed_counts(events, "ts", "event_type = 'click'"), "stream")


QUERIES = {
    "logreg_predicoes": _predictions("logreg"),
    "svm_predicoes": _predictions("svm"),
    "busca_hp": grid_search,
    "zero_shot": zero_shot,
    "stream_serie_eventos": stream,
}

_CASES = " ".join(f"WHEN contains(lower('Classifique:' || chr(10) || t), '{c}') THEN '{c}'" for c in FIVE)
ORACLE_SQL = {
    "stream_serie_eventos": "SELECT ts::DATE AS data, count(*) AS total, count(*) FILTER (event_type = 'click') AS positivos FROM events WHERE ts IS NOT NULL GROUP BY 1",
    "zero_shot": f"WITH w AS (SELECT article_id, concat_ws(' ', {STRIPPED.format('title')}, {STRIPPED.format('text')}) AS x FROM articles), v AS (SELECT article_id, x, regexp_extract_all(x, '[^{WHITE}]+') AS w FROM w), t AS (SELECT article_id, CASE WHEN len(w) <= 1500 THEN x ELSE array_to_string(w[1:1500], ' ') END AS t FROM v), a AS (SELECT article_id, CASE {_CASES} END AS c FROM t) SELECT article_id AS id, coalesce(c, 'poder') AS y_pred, c IS NULL AS fora_do_rotulo FROM a",
}
