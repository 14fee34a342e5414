"""A whole classification scenario: folds, choice of hyper-parameters, training, predictions, metrics, run folder.

A scenario is a family of classifiers on one rollup of the corpus under one protocol and regime. Families are looked
up in a registry; each gives its grid and, from training and test rows, predictions with a score for every class.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import encoders as E
from ..operators import metrics as M
from ..operators import models, splits
from ..schemas import POSITIVE, require_columns
from ..session import cut
from ..sources import artifacts, tables

CORPUS = ("id", "link", "day", "text", "y_original", "y_colapsado")
ROLLUPS = ("anchors", "threshold", "fixed")
PROTOCOLS = ("rolling", "kfold")
REGIMES = ("multi", "bin")
PRIMARY = ("anchors", "rolling", "multi")
MOST_FOLDS = 1_000
ROLES = ("treino_interno", "validacao_interna", "teste")

Predict = Callable[[DataFrame, DataFrame, dict, list[str]], DataFrame]


@dataclass(frozen=True)
class Family:
    """grid: hyper-parameters to try, in order; predict: from training rows, test rows, one of the grid and all classes,
    the test rows with ``y_pred`` and ``scores``; search: whether the grid is searched at all; together: tries the whole
    grid in shared passes."""

    grid: tuple[dict, ...]
    predict: Predict
    search: bool = True
    together: Callable[[DataFrame, DataFrame], list[tuple]] | None = None


def _linear(family: str) -> Family:
    def config(hp: dict) -> models.Config:
        return models.Config(family, float(hp["c"]), bool(hp["balanced"]))

    def predict(train: DataFrame, test: DataFrame, hp: dict, classes: list[str]) -> DataFrame:
        return models.train(train.withColumn("y", F.col("y_colapsado")), config(hp)).predict(test)

    def together(inner: DataFrame, valid: DataFrame) -> list[tuple]:
        named = [d.withColumn("y", F.col("y_colapsado")) for d in (inner, valid)]
        split = models.featured_split(*named)
        return models.search_all(split, POSITIVE, [config(hp) for hp in grid])

    grid = tuple({"c": c, "balanced": b} for c, b in models.GRID)
    return Family(grid, predict, together=together)


def encoded(make: Callable[[], E.Encoder] = E.HashedWords, batch: int = 64, words: int | None = 256) -> Family:
    """A logistic output on the vectors of an encoder that stays as it is."""

    def predict(train: DataFrame, test: DataFrame, hp: dict, classes: list[str]) -> DataFrame:
        known = train.withColumn("y", F.col("y_colapsado"))
        vectors = cut(E.embed(known, make, ["y"], batch, words), "train-vectors")
        first = vectors.select(F.size("embedding")).first()
        width = first[0] if first else 0
        model = models.fit_all(cut(E.as_features(vectors, ["y"], width), "train"), None, width, [models.Config("logreg", float(hp["c"]))])[0]
        return model.scored(E.as_features(E.embed(test, make, test.columns, batch, words), test.columns, width), test.columns)

    return Family(tuple({"c": c} for c in (1.0, 10.0, 100.0)), predict)


def zero_shot(make: Callable, prompt: str) -> Family:
    """A text generator asked once a document; its scores are 1 for the class it names and 0 for the others."""

    def predict(train: DataFrame, test: DataFrame, hp: dict, classes: list[str]) -> DataFrame:
        most = train.groupBy("y_colapsado").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "y_colapsado").first()
        said = models.zero_shot(test, classes, prompt, make, most[0] if most else classes[0])
        one_hot = F.map_from_arrays(F.array(*map(F.lit, classes)), F.array(*((F.col("y_pred") == c).cast("double") for c in classes)))
        return test.join(said.select("id", "y_pred", "fora_do_rotulo"), "id").withColumn("scores", one_hot)

    return Family(({"prompt": prompt},), predict, search=False)


FAMILIES: dict[str, Family] = {"logreg": _linear("logreg"), "svm": _linear("svm"), "encoder": encoded()}


def family_of(name: str, families: dict[str, Family] | None = None) -> Family:
    known = FAMILIES | (families or {})
    if name not in known:
        raise ValueError(f"unknown family: {name}; known: {sorted(known)}")
    return known[name]


def folds_of(rows: DataFrame, protocol: str) -> DataFrame:
    """``id, fold, papel`` of ``rows(id, day, y_colapsado)``: rolling periods, or stratified parts."""
    if protocol == "rolling":
        return splits.rolling_folds(rows)
    if protocol != "kfold":
        raise ValueError(f"unknown protocol: {protocol}; known: {PROTOCOLS}")
    parts = splits.stratified_folds(rows.select("id", F.col("y_colapsado").alias("y")))
    each = parts.select("id", F.col("fold").alias("own"), "validacao_interna", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("fold"))
    role = F.when(F.col("own") == F.col("fold"), ROLES[2]).when(F.col("validacao_interna"), ROLES[1]).otherwise(ROLES[0])
    return each.select("id", "fold", role.alias("papel"))


def search(family: Family, inner: DataFrame, valid: DataFrame, classes: list[str]) -> tuple[dict, list[dict]]:
    """The best of the grid by F1 of the positive class on the validation rows (the first among equals), and all tried."""
    if family.together:
        found = family.together(inner, valid)
    else:
        found = []
        for hp in family.grid:
            is_pos, said = F.col("y_colapsado") == POSITIVE, F.col("y_pred") == POSITIVE
            tp, fp, fn = family.predict(inner, valid, hp, classes).agg(F.count_if(is_pos & said), F.count_if(~is_pos & F.coalesce(said, F.lit(False))), F.count_if(is_pos & ~F.coalesce(said, F.lit(False)))).first()
            found.append((tp, fp, fn, 2 * tp / (2 * tp + fp + fn) if tp else 0.0))
    tried = [{**hp, "f1_binario_inner_val": f1, "tp": tp, "fp": fp, "fn": fn} for hp, (tp, fp, fn, f1) in zip(family.grid, found)]
    return family.grid[models.best_of([t["f1_binario_inner_val"] for t in tried])], tried


def choose(family: Family, primary: bool, hp_from: str | Path | None, inner: DataFrame, valid: DataFrame, classes: list[str]) -> tuple[dict, list[dict]]:
    """Hyper-parameters of a fold: fixed where nothing is searched, searched in the primary scenario, else those that a
    primary run chose for its first fold (an error if none is named)."""
    if not family.search:
        return family.grid[0], []
    if primary:
        return search(family, inner, valid, classes)
    if hp_from is None:
        raise ValueError("only the primary scenario searches; name a primary run to take hyper-parameters from")
    return tables.read_best(hp_from, 0), []


def limited(rows: DataFrame, limit: int | None) -> DataFrame:
    """All rows, or about ``limit`` of them, of each month its share."""
    return rows if limit is None else rows.join(splits.monthly_subsample(rows.select("id", "day"), limit).select("id"), "id", "left_semi")


def leakage_report(folds: DataFrame, pairs: DataFrame | None, log: logging.Logger) -> list[dict] | None:
    """Leakage of the known near-duplicate pairs between training and test; none (with a warning) without pairs."""
    if pairs is None:
        log.warning("no table of near-duplicate pairs: leakage is not diagnosed")
        return None
    sides = folds.select("id", "fold", F.when(F.col("papel") == ROLES[2], "teste").otherwise("treino").alias("lado"))
    return [r.asDict() for r in splits.leakage(pairs, sides).orderBy(F.col("fold").asc_nulls_last()).limit(MOST_FOLDS).collect()]


def run_scenario(
    corpus: DataFrame, family_name: str, rollup: str, protocol: str, regime: str, out: str | Path,
    hp_from: str | Path | None = None, pairs: DataFrame | None = None, limit: int | None = None,
    families: dict[str, Family] | None = None, hashes: dict[str, str] | None = None,
) -> Path:
    """Run a scenario on ``corpus`` (CORPUS columns, and ``title`` if there is one) and write its folder below ``out``:
    ``folds/fold_<k>/{best_hp.json, hp_search.csv, metrics.json, predictions.parquet}``, ``summary.json``,
    ``hp.json`` (of all folds), ``leakage.json`` (where pairs are given), ``metadata.json`` and ``run.log``. Gives the folder."""
    for value, known in ((rollup, ROLLUPS), (protocol, PROTOCOLS), (regime, REGIMES)):
        if value not in known:
            raise ValueError(f"unknown choice: {value}; known: {known}")
    started = datetime.now(timezone.utc)
    family = family_of(family_name, families)
    rows = limited(require_columns(corpus, CORPUS), limit)
    if regime == "bin":
        rows = C.binary_labels(rows, POSITIVE)
    rows = cut(rows, "scenario")
    classes = [r[0] for r in rows.select("y_colapsado").distinct().orderBy("y_colapsado").limit(models.MOST_CLASSES + 1).collect()]
    folder = artifacts.run_folder(out, family_name, rollup, protocol, regime)
    log = artifacts.run_logger(folder)
    number = rows.count()
    log.info("scenario %s-%s-%s-%s: %d articles, %d classes", family_name, rollup, protocol, regime, number, len(classes))
    folds = cut(folds_of(rows, protocol), "scenario-folds")
    if (leaks := leakage_report(folds, pairs, log)) is not None:
        artifacts.write_json(folder / "leakage.json", leaks)
    places = [r[0] for r in folds.select("fold").distinct().orderBy("fold").limit(MOST_FOLDS).collect()]
    metrics, chosen = [], []
    for k in places:
        at = folder / "folds" / f"fold_{k}"
        own = rows.join(folds.filter(F.col("fold") == k).select("id", "papel"), "id")
        part = {role: own.filter(F.col("papel") == role).drop("papel") for role in ROLES}
        hp, tried = choose(family, (rollup, protocol, regime) == PRIMARY, hp_from, part[ROLES[0]], part[ROLES[1]], classes)
        artifacts.write_json(at / "best_hp.json", hp)
        if tried:
            artifacts.write_rows_csv(tried, at / "hp_search.csv")
        chosen.append({"fold": k, "hp": hp})
        found = cut(family.predict(own.filter(F.col("papel") != ROLES[2]).drop("papel"), part[ROLES[2]], hp, classes), "predictions")
        artifacts.write_predictions(found.drop("text", "title"), classes, str(at / "predictions.parquet"))
        judged = found.select(F.lit(k).alias("fold"), F.col("y_colapsado").alias("y_true"), "y_pred", "y_original", "scores")
        one = M.fold_metrics(judged, POSITIVE).join(M.pr_auc(judged, POSITIVE), "fold", "left").first().asDict()
        one["fp_por_original"] = {r["y_original"]: r["n"] for r in M.false_positives(judged, POSITIVE).collect()}
        if "fora_do_rotulo" in found.columns:
            one["taxa_fora_do_rotulo"] = found.agg(F.avg(F.col("fora_do_rotulo").cast("double"))).first()[0]
        artifacts.write_json(at / "metrics.json", one)
        metrics.append(one)
        log.info("fold %s: F1=%.4f PR-AUC=%s macro-F1=%.4f n=%d", k, one["f1_binario_projetado"], one["pr_auc"], one["macro_f1"], one["n_teste"])
    artifacts.write_json(folder / "hp.json", {str(c["fold"]): c["hp"] for c in chosen})
    summary = {c: M.bootstrap([m[c] for m in metrics]) for c in ("f1_binario_projetado", "macro_f1", "pr_auc")}
    artifacts.write_json(folder / "summary.json", {**summary, "por_fold": metrics})
    about = {"familia": family_name, "recorte": rollup, "protocolo": protocol, "regime": regime, "n_artigos": number, "n_classes": len(classes), "n_folds": len(places)}
    artifacts.write_json(folder / "metadata.json", artifacts.metadata(2026, hashes, started, **about, grid=list(family.grid), hp_por_fold=chosen, limite_artigos=limit))
    log.info("done: %s", folder)
    return folder


def prepare(articles: DataFrame, out: str | Path, threshold: int, anchors: Sequence[str], fixed: Sequence[str], rollups: Sequence[str] = ROLLUPS) -> dict:
    """Write ``corpus_<rollup>.parquet`` for each rollup from ``articles(article_id, day, link, category, title, text)``:
    dated texts without exact copies; and a manifest of row counts and digests, which is returned."""
    texts = cut(articles.filter("day is not null and text is not null").select(F.col("article_id").alias("id"), "title", "text", "day", "link", F.col("category").alias("y_original")), "dated")
    corpus = cut(C.without_copies(texts), "without-copies")
    make = {
        "anchors": lambda: C.rollup_anchors(corpus, threshold, anchors),
        "threshold": lambda: C.rollup_threshold(corpus, threshold),
        "fixed": lambda: C.rollup_fixed(corpus, fixed),
    }
    manifest: dict = {"com_data_e_texto": texts.count(), "sem_copias": corpus.count(), "recortes": {}}
    for name in rollups:
        path = f"{out}/corpus_{name}.parquet"
        artifacts.write_table(make[name]().join(texts.select("id", "title", "text"), "id"), path)
        written = articles.sparkSession.read.parquet(path)
        files = tables.table_digests(articles.sparkSession, path)
        digest = files.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("sha256")), ""), 256)).first()[0]
        manifest["recortes"][name] = {"linhas": written.count(), "classes": written.select("y_colapsado").distinct().count(), "sha256": digest}
    artifacts.write_json(Path(out) / "manifest.json", manifest)
    return manifest


def with_limit(family: Family, number: int) -> Family:
    """The family with the first ``number`` of its grid, for a smoke run."""
    return replace(family, grid=family.grid[:number], together=None)
