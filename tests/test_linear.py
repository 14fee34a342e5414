import numpy as np
import pytest

from vazante.operators import linear
from vazante.operators import models as M
from vazante.operators.linear import Problem

SHAPE = "label int, indices array<int>, data array<float>"


def descended(x, y, problem):
    """Many plain gradient steps on the same objective."""
    x = np.hstack([x, np.ones((len(x), 1))])
    sign = np.where(y == problem.positive, 1.0, -1.0)
    weight = problem.c * np.where(y == problem.positive, problem.own_weight, problem.other_weight)
    w = np.zeros(x.shape[1])
    for _ in range(40_000):
        z = sign * (x @ w)
        slope = -sign * weight * (2 * np.maximum(1 - z, 0) if problem.loss == "hinge" else 1 / (1 + np.exp(z)))
        w -= 0.02 / (1 + problem.c) * (w + x.T @ slope)
    return w


def test_fits_equal_plain_descent(spark):
    rng = np.random.default_rng(3)
    x = np.where(rng.random((60, 6)) < 0.5, 0, rng.normal(0, 0.5, (60, 6)))
    x[7] = 0  # a row without any feature
    y = (x[:, 0] + 0.3 * rng.normal(size=60) > 0).astype(int) + (x[:, 1] > 0.3)
    rows = [(int(c), [int(k) for k in np.flatnonzero(v)], [float(a) for a in v[v != 0]]) for c, v in zip(y, x)]
    df = spark.createDataFrame(rows, SHAPE).repartition(3)
    problems = [Problem("log", 0), Problem("hinge", 1, 0.5), Problem("log", 2, 2.0, 3.0, 0.5), Problem("hinge", 0, 1.0, 0.2, 1.0)]
    got = linear.fit(df, 6, problems, 100, 1e-5)
    for k, problem in enumerate(problems):
        assert np.allclose(got[:, k], descended(x, y, problem), atol=0.02), problem
    linear_bytes, linear.DRIVER_BYTES = linear.DRIVER_BYTES, 0  # merged by tasks
    try:
        assert np.allclose(linear.fit(df, 6, problems, 100, 1e-5), got, atol=1e-3)
    finally:
        linear.DRIVER_BYTES = linear_bytes


def test_no_rows_give_zeros(spark):
    assert not linear.fit(spark.createDataFrame([], SHAPE), 4, [Problem("log", 0)]).any()


def test_features_are_dampened_weighed_and_scaled(spark):
    docs = spark.createDataFrame([(1, "Ação", "ação de ação"), (2, None, "acao boa"), (3, "", None), (4, "x", "zzz")], "id long, title string, text string")
    f = M.fit_features(docs, M.Config(min_df=1, vocabulary=3))
    assert f.terms[0] == "acao" and len(f.terms) == 3
    assert f.weights[0] == pytest.approx(1 + np.log(5 / 3))
    got = {r.id: (r.indices, r.data) for r in f.of(docs, ["id"]).collect()}
    assert got[3] == ([], []) and got[4] == ([], [])
    raw = (1 + np.log(3)) * f.weights[0]
    other = {t: (1 + np.log(n)) * f.weights[k] for k, t in enumerate(f.terms[1:], 1) for n in [("acao acao de acao".split() + ["acao acao", "acao de", "de acao"]).count(t)] if n}
    assert got[1][1][0] == pytest.approx(raw / np.sqrt(raw**2 + sum(v**2 for v in other.values())), rel=1e-5)


def test_two_classes_and_one(spark):
    docs = spark.createDataFrame([(k, "sol praia" if k % 2 else "neve frio", "a" if k % 2 else "b") for k in range(20)] + [(99, "nada", None)], "id long, text string, y string")
    for family in ("logreg", "svm"):
        out = M.train(docs, M.Config(family, min_df=1)).predict(docs).collect()
        assert len(out) == 21 and all(r.y_pred == r.y for r in out if r.y) and set(out[0].scores) == {"a", "b"}
    with pytest.raises(ValueError, match="two classes"):
        M.train(docs.filter("y = 'a'"), M.Config(min_df=1))


def test_search_tries_the_whole_grid_together(spark):
    text = {"a": "sol praia", "b": "neve frio", "c": "chuva vento"}
    docs = spark.createDataFrame([(k, text["abc"[k % 3]], "abc"[k % 3]) for k in range(30)], "id long, text string, y string")
    for family in ("logreg", "svm"):
        tried, best = M.search(docs.filter("id < 21"), docs.filter("id >= 21"), "a", M.Config(family, min_df=1, iterations=8))
        assert [t[:2] for t in tried] == list(M.GRID) and best == 0
        assert all(t[2:] == (3, 0, 0, 1.0) for t in tried)
    assert M.best_of([0.1, 0.4, 0.4]) == 1


def test_splits_of_all_folds_read_texts_twice(spark, monkeypatch):
    docs = [(k, None if k % 7 == 0 else "Ação", f"acao boa {'sol' if k % 2 else 'neve'} x{k % 3} {'raro' * (k == 5)}", "ab"[k % 2] if k else None, 1 * (k < 15) + 2 * (k < 22), 1 * (15 <= k < 22) + 2 * (k >= 22)) for k in range(30)]
    df = spark.createDataFrame(docs, "id long, title string, text string, y string, train int, valid int")
    config = M.Config(min_df=2, vocabulary=9)
    got = list(M.featured_splits(df, 2, config))
    for k, split in enumerate(got):
        want = M.featured_split(df.filter(f"train & {1 << k} <> 0"), df.filter(f"valid & {1 << k} <> 0"), config)
        assert split.width == want.width
        for a, b in ((split.inner, want.inner), (split.valid, want.valid)):
            a, b = (sorted(((r.y or "", sorted(zip(r.indices, (round(x, 5) for x in r.data)))) for r in part.collect()), key=str) for part in (a, b))
            assert a == b and a


def test_packed_rows_give_the_sums_of_all_rows(monkeypatch):
    for name, value in (("ROWS", 7), ("DENSE", 3), ("RUN", 5)):
        monkeypatch.setattr(linear, name, value)
    rng = np.random.default_rng(5)
    x = np.where(rng.random((40, 12)) < 0.6, 0, rng.normal(0, 0.5, (40, 12)))
    x[3] = x[39] = 0
    y, w = rng.integers(0, 3, 40), rng.normal(0, 0.5, (13, 4)).astype(np.float32)
    problems = [Problem("hinge", 1, 0.5), Problem("log", 0), Problem("log", 2, 2.0, 3.0, 0.5), Problem("hinge", 2)]
    sizes, (_, index) = (x != 0).sum(1), np.nonzero(x)
    whole = y, sizes, index.astype(np.int32), x[x != 0].astype(np.float32)
    cut = sizes[:22].sum()
    parts = [[v[:n] for v, n in zip(whole, (22, 22, cut, cut))], [v[n:] for v, n in zip(whole, (22, 22, cut, cut))]]
    loss, gradient = linear.Packed(parts, 12).sums(problems, w)
    for k, p in enumerate(problems):
        sign, weight = np.where(y == p.positive, 1, -1), p.c * np.where(y == p.positive, p.own_weight, p.other_weight)
        z = sign * (np.hstack([x, np.ones((40, 1))]) @ w[:, k])
        gap = np.maximum(1 - z, 0)
        slope = -sign * weight * (2 * gap if p.loss == "hinge" else 1 / (1 + np.exp(z)))
        assert loss[k] == pytest.approx((weight * (gap**2 if p.loss == "hinge" else np.log1p(np.exp(-z)))).sum(), rel=1e-5)
        assert np.allclose(gradient[:, k], np.append(slope @ x, slope.sum()), atol=1e-4)


def test_folds_tried_in_tasks_find_what_distributed_passes_find(spark, monkeypatch):
    monkeypatch.setattr(M, "WHOLE", 0)
    rng = np.random.default_rng(8)
    words = np.array([f"w{k}" for k in range(30)])
    docs = []
    for k in range(90):
        y = k % 3
        text = " ".join(rng.choice(words[y * 8 : y * 8 + 14], 12))
        docs.append((text, None if k % 20 == 19 else "abc"[y], 1 * (k < 50) + 2 * (k < 70), 1 * (50 <= k < 70) + 2 * (k >= 70)))
    df = spark.createDataFrame(docs, "text string, y string, train int, valid int")
    configs = [M.Config(f, c, b, min_df=2, iterations=12) for f in ("logreg", "svm") for c, b in ((0.1, True), (1.0, False))]
    for some in (df, df.filter("y is null or y <> 'c'")):  # three classes, two
        monkeypatch.setattr(M, "WHOLE", 0)
        splits = list(M.tried_splits(some, 2, "a", configs))
        assert all(isinstance(s, M.Split) for s in splits)
        want = [M.search_all(s, "a", [c])[0] for s in splits for c in configs]
        monkeypatch.setattr(M, "WHOLE", 10**6)
        monkeypatch.setattr(linear, "DENSE", 5)
        tried = list(M.tried_splits(some, 2, "a", configs))
        assert [M.search_all(s, "a", [c])[0] for s in tried for c in configs] == want and all(sum(w[:3]) for w in want)
        rows, best = M.search(tried[1], None, "a", M.Config("svm", min_df=2, iterations=12), [(0.1, True), (1.0, False)])
        assert [r[2:] for r in rows] == want[-2:] and best == M.best_of([w[3] for w in want[-2:]])
    with pytest.raises(ValueError, match="two classes"):
        list(M.tried_splits(df.filter("y = 'a'"), 2, "a", configs))


def test_a_problem_that_is_done_is_not_passed_again():
    seen = []

    def at(problems, w):
        seen.append([p.c for p in problems])
        scale = np.array([[1], [10], [100]], np.float32) ** [p.c > 1 for p in problems]
        return ((w - 1) ** 2 * scale).sum(0, dtype=float) / 2, (w - 1) * scale

    got = linear.descend(at, 2, [Problem("log", 0, 1.0), Problem("log", 1, 50.0)], 40, 1e-4)
    assert np.allclose(got, [[1 / 2, 1 / 2], [1 / 2, 10 / 11], [1 / 2, 100 / 101]], atol=1e-3)
    assert len({len(s) for s in seen}) == 2 and len(seen) < 40
