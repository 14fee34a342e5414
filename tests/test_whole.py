"""Whole jobs: results that a run over representatives, a part of the input or fewer repetitions would miss."""

import datetime
import itertools
import random

import numpy as np
import pytest

from vazante.operators import drift as D
from vazante.operators import duplicates as U
from vazante.operators import models, splits
from vazante.plans import evaluation, learning

DAY = datetime.date


def _copies_and_edits():
    """Texts of 400 characters: 0-2 and 3-5 are copies, the second set nearly equals the first; 6 stands alone."""
    rng = random.Random(3)
    base, other = ("".join(rng.choices("abcdefgh ", k=400)) for _ in range(2))
    return [base] * 3 + [base[:200] + "XY" + base[200:]] * 3 + [other]


def test_leakage_counts_all_near_pairs(spark):
    texts = _copies_and_edits()
    found = U.near_pairs(spark.createDataFrame(list(enumerate(texts)), "id long, text string"))
    sides = {0: ["treino", "treino", "teste", "teste", "treino", "teste", "treino"], 1: ["treino"] * 3 + [None] * 3 + ["teste"]}
    rows = [(k, f, s) for f, own in sides.items() for k, s in enumerate(own) if s]
    got = {r.fold: tuple(r)[1:] for r in splits.near_leakage(found, spark.createDataFrame(rows, "id long, fold int, lado string")).collect()}
    for fold, own in sides.items():
        met = [(own[a], own[b]) for a, b in itertools.combinations(range(6), 2) if own[a] and own[b]]
        across = sum(a != b for a, b in met)
        assert got[fold] == (len(met), across, met.count(("treino", "treino")), met.count(("teste", "teste")), across / len(met))
    assert got[None][:2] == (18, 9)


def test_leakage_query_takes_near_pairs(spark, folder):
    """Against all pairs of rows, with the near pairs found on all articles."""
    rows = evaluation._dated(spark, folder)
    found = U.near_pairs(rows)
    rep = {r.id: r.rep for r in found.members.collect()}
    links = {(r.id_a, r.id_b) for r in found.pairs.collect()}
    sides = {}
    for r in splits.rolling_folds(rows).collect():
        sides.setdefault(r.fold, {})[r.id] = r.papel == "teste"
    got = {r.fold: tuple(r)[1:5] for r in evaluation.QUERIES["leakage_por_fold"](spark, folder).collect()}
    assert set(got) == {None, *sides}
    classes = {}
    for i, c in rep.items():
        classes.setdefault(c, []).append(i)
    pairs = [p for c in classes.values() for p in itertools.combinations(c, 2)] + [p for a, b in links for p in itertools.product(classes[a], classes[b])]
    for fold, side in sides.items():
        met = [(side[a], side[b]) for a, b in pairs if a in side and b in side]
        assert got[fold] == (len(met), sum(a != b for a, b in met), met.count((False, False)), met.count((True, True)))
    assert got[None] == tuple(sum(got[f][k] for f in sides) for k in range(4))


def test_distant_pairs_look_at_all_rows_of_a_class(spark):
    texts = _copies_and_edits()
    days = [None, "2015-01-01", "2016-01-01", "2015-01-05", "2015-01-06", "2015-01-07", "2015-01-01"]
    rows = spark.createDataFrame([(k, DAY.fromisoformat(d) if d else None, t, "t", "c") for k, (d, t) in enumerate(zip(days, texts))], "id long, day date, text string, title string, category string")
    found = U.near_pairs(rows)
    got = {(r.rep_a, r.rep_b): r for r in U.enriched(U.distant_pairs(found, rows), rows).collect()}
    assert {k: (r.id_a, r.id_b, r.dias) for k, r in got.items()} == {(0, 0): (1, 2, 365), (0, 3): (2, 3, 361)}
    assert got[0, 0].jaccard_estimado == 1 > got[0, 3].jaccard_estimado >= 0.85
    assert U.distant_pairs(found, rows, 365).count() == 0


def test_summary_counts_row_pairs(spark):
    rows = spark.createDataFrame(list(enumerate(_copies_and_edits())), "id long, text string")
    found = U.near_pairs(rows)
    assert U.near_row_pairs(found).first().n == 15
    none = rows.select("id").limit(0)
    assert U.dedup_summary(rows.select("text"), none, none, U.near_row_pairs(found)).first().pares_near_encontrados == 15


SIX = {("time_ordered", 0), *(("randomized", r) for r in range(5))}


def test_semantic_drift_runs_all_conditions(spark, folder):
    out = evaluation.QUERIES["drift_semantico"](spark, folder).collect()
    assert {(r.condicao, r.repeticao) for r in out} == SIX
    sizes = {}
    for r in out:
        sizes.setdefault((r.condicao, r.repeticao), []).append(r.metrica)
    assert all({m: own.count(m) for m in own} == {m: len(own) // 3 for m in ("cosine_centroid", "cumulative_cosine", "mmd2")} for own in sizes.values())
    assert len({len(own) for own in sizes.values()}) == 1


def test_random_windows_and_statistical_drift_have_five_repetitions(spark, folder):
    parts = evaluation.QUERIES["particoes_aleatorias"](spark, folder).select("repeticao").distinct().collect()
    assert {r.repeticao for r in parts} == set(range(5))
    out = evaluation.QUERIES["drift_estatistico"](spark, folder).groupBy("condicao", "repeticao").count().collect()
    assert {(r.condicao, r.repeticao) for r in out} == SIX and len({r["count"] for r in out}) == 1


def test_predictions_cover_all_folds_with_the_default_vocabulary(spark, folder, monkeypatch):
    used, train = [], models.train
    monkeypatch.setattr(learning.M, "train", lambda docs, config: used.append(config) or train(docs, config))
    got = learning.QUERIES["logreg_predicoes"](spark, folder)
    assert {r.fold for r in got.select("fold").distinct().collect()} == set(range(5))
    assert used == [models.Config("logreg")] * 5 and used[0].vocabulary == 100_000


def test_grid_covers_both_families_and_all_folds(spark, folder, monkeypatch):
    used = []
    monkeypatch.setattr(learning.M, "search", lambda a, b, positive, config: used.append(config) or ([(c, w, 0, 0, 0, 0.0) for c, w in models.GRID], 0))
    got = learning.QUERIES["busca_hp"](spark, folder).collect()
    assert len(got) == 2 * 5 * len(models.GRID) and {(r.familia, r.fold) for r in got} == set(itertools.product(("logreg", "svm"), range(5)))
    assert {c.vocabulary for c in used} == {100_000}


def test_kernel_tests_see_a_change_between_small_windows(spark):
    """Two windows of 60 rows of other spreads beside one of 3000 far wider: the exact Gram statistic sees it, so
    must both tests; between 20 small windows of equal spread p is even."""
    rng = np.random.default_rng(4)
    data = [rng.normal(0, spread, (n, 4)) for n, spread in ((3000, 30), (60, 0.5), *[(60, 1.0)] * 20)]
    rows = [(k, w, f"w{w}", [float(v) for v in x]) for k, (w, x) in enumerate((w, x) for w, own in enumerate(data) for x in own)]
    got = {(r.par, r.teste): r.p_value for r in D.kernel_tests(spark.createDataFrame(rows, "id long, janela_idx int, rotulo string, embedding array<double>")).collect()}

    def exact(a, b):
        x = np.concatenate([a, b])
        gaps = ((x[:, None] - x[None]) ** 2).sum(-1)
        gram = np.exp(-gaps / (2 * np.median(gaps[np.triu_indices(len(x), 1)])))
        signs = np.repeat([1 / len(a), -1 / len(b)], [len(a), len(b)])
        real = signs @ gram @ signs
        return np.mean([s @ gram @ s >= real for s in (rng.permutation(signs) for _ in range(200))])

    assert exact(data[1], data[2]) < 0.03 and got[1, "KTS"] < 0.05 and got[1, "LSDD"] < 0.05
    assert max(got[0, "KTS"], got[0, "LSDD"]) < 0.05
    for test in ("KTS", "LSDD"):
        same = sorted(got[k, test] for k in range(2, 21))
        assert 0.25 < same[9] < 0.75 and same[3] > 0.05


def test_kernel_tests_agree_with_whole_matrices(spark):
    """Equal windows are calm and shifted ones are seen by both forms; statistics are close."""
    rng = np.random.default_rng(9)
    data = [rng.normal(shift, 1, (90, 3)) for shift in (0, 0, 0, 1.2, 1.2, 0)]
    rows = [(k, w, f"w{w}", [float(v) for v in x]) for k, (w, x) in enumerate((w, x) for w, own in enumerate(data) for x in own)]
    df = spark.createDataFrame(rows, "id long, janela_idx int, rotulo string, embedding array<double>")
    quick, whole = ({(r.par, r.teste): r for r in f(df).collect()} for f in (D.kernel_tests, D.exact_kernel_tests))
    assert set(quick) == set(whole) and len(whole) == 10
    for (par, test), r in whole.items():
        if par in (2, 4):
            assert r.p_value < 0.03 and quick[par, test].p_value < 0.03
        else:
            assert r.p_value > 0.03 and quick[par, test].p_value > 0.03
        if test == "KTS":
            assert abs(r.estatistica - quick[par, test].estatistica) < 0.1  # 256 random features: a deviation of about 0.03
    with pytest.raises(ValueError, match="more than"):
        D.exact_kernel_tests(df, most=100)


def test_all_duplicates(spark):
    rows = spark.createDataFrame(list(enumerate(_copies_and_edits())), "id long, text string")
    exact, near = U.all_duplicates(rows, ["text"])
    assert exact.first().linhas_duplicadas == 4 and near.pairs.count() == 1


def discrepancy(x, y):
    """From whole matrices, as the definition has it."""
    z = np.concatenate([x, y])
    gaps = ((z[:, None] - z) ** 2).sum(2)
    near = np.exp(-gaps / (2 * max(np.median(gaps[np.triu_indices(len(z), 1)]), 1e-18)))
    n = len(x)
    return near[:n, :n].mean() + near[n:, n:].mean() - 2 * near[:n, n:].mean()


@pytest.mark.parametrize("kind", ["plain", "copies", "mostly one", "far off"])
def test_exact_discrepancy_in_parts_equals_the_whole(spark, monkeypatch, kind):
    monkeypatch.setattr(D, "SIDE", 60)
    monkeypatch.setattr(D, "CHUNK", 200)
    monkeypatch.setattr(D, "MOST_TASKS", 8)
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (300, 3)).astype(np.float32)
    if kind == "copies":
        x[50:120] = x[:70]
    if kind == "mostly one":
        x[:250] = x[0]
    if kind == "far off":
        x[7] = 1e6
    window = np.sort(rng.integers(0, 3, 300)) + (np.arange(300) >= 290) * 2  # the last one has no neighbour
    rows = [(k, int(w), f"w{w}", [float(a) for a in v]) for k, (w, v) in enumerate(zip(window, x))]
    df = spark.createDataFrame([*rows, (999, 0, "w0", None)], "id long, janela_idx int, rotulo string, embedding array<float>")
    got = {r.par: r.valor for r in D.exact_discrepancy(df).collect()}
    assert got == {p: pytest.approx(discrepancy(x[window == p].astype(float), x[window == p + 1].astype(float)), abs=1e-9) for p in (0, 1)}


def test_mmd2_exato_takes_windows_of_any_size(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (2, 40, 16)).astype(np.float32)
    x[1] += 0.5
    rows = [(f"l{m}-{k}", f"2015-0{m + 1}-03", [float(a) for a in x[m, k % 40]]) for m in range(2) for k in range(4_400)]
    df = spark.createDataFrame(rows, "link string, date string, embedding array<float>")
    df.withColumn("date", df["date"].cast("date")).write.parquet(f"{tmp_path}/article_vectors.parquet")
    (got,) = evaluation.QUERIES["mmd2_exato"](spark, str(tmp_path)).collect()
    # 110 copies of each: the median over pairs of rows counts pairs of copies, too
    whole = np.concatenate(x).astype(float)
    gaps = ((whole[:, None] - whole) ** 2).sum(2)
    times = np.where(np.eye(80) > 0, 110 * 109 // 2, 110 * 110) * np.triu(np.ones((80, 80), int))
    order = np.argsort(gaps, axis=None)
    upto = np.cumsum(times.ravel()[order])
    middle = np.mean([gaps.ravel()[order][np.searchsorted(upto, k, "right")] for k in ((upto[-1] - 1) // 2, upto[-1] // 2)])
    near = np.exp(-gaps / (2 * middle))
    assert got.par == 0 and got.valor == pytest.approx(near[:40, :40].mean() + near[40:, 40:].mean() - 2 * near[:40, 40:].mean(), abs=2e-6)
