import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vazante.functions import minhash
from vazante.functions import text as T
from vazante.operators import corpus as C
from vazante.operators import drift as D
from vazante.operators import duplicates as U
from vazante.operators import metrics as M
from vazante.operators import prevalence as P
from vazante.operators import sampling, splits
from vazante.operators.graph import connected_components

DAY = datetime.date


def days(spark, rows):
    return spark.createDataFrame([(DAY.fromisoformat(d) if d else None, p) for d, p in rows], "day date, positive boolean")


def test_series_fills_gaps(spark):
    rows = days(spark, [("2016-01-02", True), ("2016-01-03", True), ("2016-01-30", False), ("2016-03-01", False), (None, True)])
    got = [tuple(r)[:4] for r in P.series(rows, "M").orderBy("data").collect()]
    assert got == [(DAY(2016, 1, 1), 3, 2, 2 / 3), (DAY(2016, 2, 1), 0, 0, None), (DAY(2016, 3, 1), 1, 0, 0.0)]
    assert P.series(rows, "W").count() == 10 and P.series(rows, "D").count() == 60
    assert P.series(rows.filter("1=0"), "D").count() == 0
    with pytest.raises(ValueError):
        P.series(rows, "Q")


def test_weekdays_and_calendar(spark):
    rows = days(spark, [("2016-01-04", True), ("2016-01-10", False), ("2016-01-03", False), ("2016-01-17", True)])
    got = {r.dia_semana: r for r in P.by_weekday(rows).collect()}
    assert set(got) == {0, 6} and got[0].nome == "seg" and got[6].nome == "dom" and got[6].ic_inf <= 1 / 3 <= got[6].ic_sup
    assert [r.total for r in P.daily_calendar(days(spark, [("2016-01-01", True)] * 2 + [("2016-01-03", True)])).orderBy("data").collect()] == [2, 0, 1]


def test_anomalies(spark):
    start = DAY(2016, 1, 1)
    usual = [(start + datetime.timedelta(k), 100 + k % 3) for k in range(30)]
    out = P.daily_anomalies(spark.createDataFrame([*usual[:-1], (usual[-1][0], 1000)], "data date, total long")).collect()
    assert len(out) == 1 and out[0].flag_ambos
    flat = spark.createDataFrame([(d, 100) for d, _ in usual[:-1]] + [(usual[-1][0], 0)], "data date, total long")
    assert P.daily_anomalies(flat).count() == 0 and P.empty_days(flat).count() == 1


def test_components(spark):
    rng = random.Random(1)
    edges = [(1, 2), (2, 3), (5, 6), (7, 7), (None, 3), (3, 1), (1, 2)] + [(100 + k, 101 + k) for k in range(60)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    label: dict = {}
    for a, b in edges:
        if a is not None and a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(200):
        for a, b in edges:
            if a is not None and a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "id_a long, id_b long")).collect()}
    assert got == label
    assert connected_components(spark.createDataFrame([], "id_a long, id_b long")).count() == 0


def test_numbering(spark):
    rows = [(k, random.Random(k).choice([None, "a", "b", "c"])) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, v string").repartition(5)
    got = {r.id: r.n for r in C.numbered(df, [F.col("v").asc_nulls_last(), F.col("id").asc()], "n").collect()}
    want = {i: k for k, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1] is None, r[1] or "", r[0])))}
    assert got == want


def test_exact_copies(spark):
    rows = [(1, "2016-02-01", "z", "x", "A"), (2, "2016-01-01", "m", "x", "A"), (3, "2016-01-01", "a", "x", "A"), (4, "2016-05-01", "q", "x", "B"), (5, None, "q", "x", None)]
    df = spark.createDataFrame([(i, DAY.fromisoformat(d) if d else None, n, y, t) for i, d, n, y, t in rows], "id long, day date, link string, y_original string, text string")
    assert {(r.id, r.eh_duplicata_text) for r in C.without_copies(df).collect()} == {(3, True), (4, False)}


def test_rollups(spark):
    counts = {"poder": 11, "mercado": 12, "opiniao": 12, "tec": 10, "musica": 2, "colunas": 11}
    df = spark.createDataFrame([(y,) for y, n in counts.items() for _ in range(n)] + [(None,)], "y_original string")
    got = {r.y_colapsado: r["count"] for r in C.rollup_anchors(df, 10, ("poder", "mercado", "colunas")).groupBy("y_colapsado").count().collect()}
    assert got == {"poder": 11, "mercado": 12, "colunas": 11, "outros": 22}
    assert {r.y_colapsado for r in C.rollup_threshold(df, 11).collect()} == {"poder", "mercado", "opiniao"}
    assert C.class_table(df, 11).agg(F.sum("frac")).first()[0] == pytest.approx(1)


def test_duplicates(spark):
    rows = [(1, "u", "a"), (2, "u", "b"), (3, "v", "b"), (4, None, "c"), (5, None, None), (6, "u", None)]
    df = spark.createDataFrame(rows, "id long, link string, title string")
    assert {r.tipo: (r.linhas_duplicadas, r.grupos) for r in U.exact_report(df, ["link", "title"]).collect()} == {"link": (2, 1), "title": (1, 1)}
    assert {r.id for r in U.exact_affected(df, ["link", "title"]).collect()} == {2, 6, 3}
    assert [tuple(r) for r in U.exact_examples(df, "link", ids=2).collect()] == [("u", 3, [1, 2])]


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(7)
    base = ["".join(rng.choices("abcdefgh ", k=400)) for _ in range(25)]
    texts = base + [b[:200] + "XY" + b[200:] for b in base[:15]] + [base[0].upper(), base[1] + "  "] + [None, "", "ab"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = U.near_pairs(df)
    squeeze = lambda t: " ".join(t.lower().split())
    sig = {k: minhash.signature(minhash.run_hashes(squeeze(t), 5), 128) for k, t in enumerate(texts) if t}
    reps = {}
    for k in sig:
        reps.setdefault(squeeze(texts[k]), k)
    rep_ids = sorted(reps.values())
    want = {(a, b) for i, a in enumerate(rep_ids) for b in rep_ids[i + 1 :] if (sig[a] == sig[b]).mean() >= 0.85}
    assert {(r.id_a, r.id_b) for r in found.pairs.collect()} == want and len(want) == 15
    groups = U.near_components(found).groupBy("componente").count().collect()
    assert sorted(r["count"] for r in groups) == [2] * 13 + [3, 3]


def test_sampling_takes_the_smallest_keys(spark):
    rows = [(k, "g" if k % 5 else None, 40 if k % 5 else 7) for k in range(900)]
    df = spark.createDataFrame(rows, "id long, grp string, quota int").withColumn("key", sampling.random_key(F.col("id"), "s"))
    got = {r.id for r in sampling.smallest_keys(df, ["grp"], "quota").collect()}
    all_rows = df.collect()
    want = {r.id for g, n in (("g", 40), (None, 7)) for r in sorted((r for r in all_rows if r.grp == g), key=lambda r: (r.key, r.id))[:n]}
    assert got == want


def test_folds(spark):
    start = DAY(2015, 1, 5)
    rows = spark.createDataFrame([(k, start + datetime.timedelta(k)) for k in range(1000)], "id long, day date")
    folds = splits.rolling_folds(rows)
    ends = {(r.fold, r.papel): (r.a, r.b) for r in folds.join(rows, "id").groupBy("fold", "papel").agg(F.min("day").alias("a"), F.max("day").alias("b")).collect()}
    assert [ends[k, "teste"][0] for k in range(5)] == [DAY(2016, 7, 1), DAY(2016, 10, 1), DAY(2017, 1, 1), DAY(2017, 4, 1), DAY(2017, 7, 1)]
    assert all(ends[k, "validacao_interna"][1] < ends[k, "teste"][0] and ends[k, "treino_interno"][1] < ends[k, "validacao_interna"][0] for k in range(5))
    with pytest.raises(ValueError):
        splits.rolling_folds(rows.filter("day < '2016-08-01'"))
    classes = spark.createDataFrame([(k, "abcd"[min(3, k % 7)]) for k in range(700)], "id long, y string")
    kfold = splits.stratified_folds(classes)
    sizes = {(r.y, r.fold): r["count"] for r in kfold.groupBy("y", "fold").count().collect()}
    assert kfold.select("id").distinct().count() == 700 and max(sizes["a", f] for f in range(5)) - min(sizes["a", f] for f in range(5)) <= 1


def test_leakage(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3), (3, 4), (1, 99)], "id_a long, id_b long")
    sides = [(1, 0, "treino"), (2, 0, "treino"), (3, 0, "teste"), (4, 0, "teste"), (1, 1, "treino"), (3, 1, "teste")]
    got = {r.fold: tuple(r)[1:] for r in splits.leakage(pairs, spark.createDataFrame(sides, "id long, fold int, lado string")).collect()}
    assert got[0] == (3, 1, 1, 1, 1 / 3) and got[1] == (1, 1, 0, 0, 1.0) and got[None][:2] == (4, 2)


def test_metrics(spark):
    rows = [("m", "m", 0.9), ("m", "x", 0.8), ("x", "m", 0.7), ("x", "x", 0.1), ("m", "m", 0.6), ("x", None, 0.6)]
    df = spark.createDataFrame([(0, t, p, "o", {"m": s}) for t, p, s in rows] + [(1, "x", "x", "o", {"m": 0.3})], "fold int, y_true string, y_pred string, y_original string, scores map<string,double>")
    got = {r.fold: r for r in M.fold_metrics(df, "m").collect()}
    assert got[0].f1_binario_projetado == pytest.approx(4 / 6) and got[0].n_teste == 6 and got[0].n_mercado_teste == 3 and got[1].f1_binario_projetado == 0
    auc = {r.fold: r.pr_auc for r in M.pr_auc(df, "m").collect()}
    points = [(0, 1), (1 / 3, 1), (2 / 3, 1), (2 / 3, 2 / 3), (1, 3 / 5), (1, 1 / 2)]
    assert auc[0] == pytest.approx(sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))) and auc[1] is None
    assert [tuple(r) for r in M.false_positives(df, "m").collect()] == [(0, "o", 1)]
    assert M.bootstrap([])["media"] is None and M.bootstrap([0.5])["dp"] == 0.0
    b = M.bootstrap([0.1, 0.2, 0.4, 0.5, 0.3])
    assert b["ic_95_inf"] <= b["media"] <= b["ic_95_sup"]


def test_windows(spark):
    rows = spark.createDataFrame([(k, DAY(2015, 1, 1) + datetime.timedelta(k)) for k in range(30)] + [(100, DAY(2015, 3, 1))], "id long, day date")
    assert [r.rotulo for r in D.monthly_windows(rows).orderBy("janela_idx").collect()] == ["2015-01", "2015-03"]
    two = D.fortnightly_windows(rows.filter("id < 30")).orderBy("janela_idx").collect()
    assert [(r.rotulo, r.fim) for r in two] == [("2015-01-01_2015-01-14", DAY(2015, 1, 15)), ("2015-01-15_2015-01-28", DAY(2015, 1, 29))]
    with pytest.raises(ValueError):
        D.fortnightly_windows(rows, 0)
    parts = D.random_windows(rows, D.monthly_windows(rows), 2)
    assert {(r.repeticao, r.janela_idx): r["count"] for r in parts.groupBy("repeticao", "janela_idx").count().collect()} == {(r, i): n for r in (0, 1) for i, n in ((0, 30), (1, 1))}
    with pytest.raises(ValueError):
        D.random_windows(rows.limit(3), D.monthly_windows(rows))
    assert D.windowed(rows, D.fortnightly_windows(rows), "14").filter("id = 15").first().janela_idx == 1


def test_period_and_scope(spark):
    rows = spark.createDataFrame([(DAY(2014, 12, 31), "mercado"), (DAY(2015, 1, 1), None), (DAY(2017, 9, 30), "poder"), (DAY(2017, 10, 1), "mercado")], "day date, category string")
    assert D.in_period(rows, "2015-01-01", "2017-10-01").count() == 2
    assert [D.in_scope(rows, s).count() for s in ("global", "mercado", "nao_mercado")] == [4, 2, 2]
    with pytest.raises(ValueError):
        D.in_scope(rows, "outro")
    with pytest.raises(ValueError):
        D.in_period(rows.union(spark.sql("select cast(null as date), 'x'")), "2015-01-01", "2017-10-01")


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    rows = []
    for w, shift in enumerate([0.0] * 12 + [3.0]):
        rows += [(len(rows) + k, w, f"w{w}", [float(x) for x in v]) for k, v in enumerate(rng.normal(shift, 1, (120, 6)))]
    return spark.createDataFrame(rows + [(9999, 0, "w0", None)], "id long, janela_idx int, rotulo string, embedding array<float>")


def test_drift_tests_find_the_shift_and_only_it(vectors):
    got = {(r.par, r.teste): r.p_value for r in D.all_tests(vectors).collect()}
    assert len(got) == 12 * 4
    for test in ("KS", "CVM", "KTS", "LSDD"):
        same = sorted(got[k, test] for k in range(11))
        assert got[11, test] < 0.02 and 0.15 < same[5] < 0.9 and same[3] > 0.05


def test_whole_drift_run(spark):
    rng = np.random.default_rng(2)
    rows = [(k, DAY(2016, 1 + k % 3, 1 + k % 25), [float(x) for x in rng.normal(2.0 * (k % 3 == 2), 1, 4)]) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, day date, embedding array<float>")
    out = D.statistical_drift(df, D.monthly_windows(df), 1, 50).collect()
    assert {(r.condicao, r.repeticao): sum(1 for x in out if x.condicao == r.condicao) for r in out} == {("time_ordered", 0): 8, ("randomized", 0): 8}
    real = {(r.janela_a, r.janela_b): r.p_value for r in out if r.condicao == "time_ordered" and r.teste == "KTS"}
    assert real["2016-02", "2016-03"] < 0.05 and {r.janela_a for r in out if r.condicao == "randomized"} == {"rand_000", "rand_001"}
    with pytest.raises(ValueError):
        D.statistical_drift(df.filter("day < '2016-02-01'"), D.monthly_windows(df.filter("day < '2016-02-01'")))
    meters = {r["metrica"]: r["count"] for r in D.semantic_distances(D.windowed(df, D.monthly_windows(df))).groupBy("metrica").count().collect()}
    assert meters == {"cosine_centroid": 2, "cumulative_cosine": 2, "mmd2": 2}


def test_statistics_equal_direct_formulas(vectors):
    data = {w: np.array([r.embedding for r in vectors.filter(f"janela_idx = {w} and embedding is not null").collect()]) for w in (0, 1)}
    ks = {r.dim: r.estatistica for r in D.ks_statistics(vectors).filter("par = 0").collect()}
    cvm = {r.dim: r.estatistica for r in D.cvm_statistics(vectors).filter("par = 0").collect()}
    for d in range(6):
        a, b = data[0][:, d], data[1][:, d]
        pool = np.concatenate([a, b])
        gap = np.searchsorted(np.sort(a), pool, "right") / len(a) - np.searchsorted(np.sort(b), pool, "right") / len(b)
        assert ks[d] == pytest.approx(np.abs(gap).max()) and cvm[d] == pytest.approx((gap**2).sum() * len(a) * len(b) / len(pool) ** 2)


def test_semantic_drift(spark):
    flat = [(k, w, f"w{w}", [1.0, 0.0] if w < 2 else [-1.0, 0.1]) for w in range(3) for k in range(5)]
    means = D.centroids(spark.createDataFrame(flat, "id long, janela_idx int, rotulo string, embedding array<float>"))
    one = {r.janela_b: r.valor for r in D.consecutive_cosine(means).collect()}
    two = {r.janela_b: (r.janela_a, r.valor) for r in D.cumulative_cosine(means, 2).collect()}
    assert one["w1"] == pytest.approx(0, abs=1e-9) and one["w2"] > 0.5 and two["w2"][0] == "historico_ate_w1" and two["w2"][1] > 0.5
    found = D.change_points(means, least=1).collect()
    assert found[0].rotulo == "w2"


def test_text_functions(spark):
    df = spark.createDataFrame([(" Título ", " texto\n"), (None, None), ("  ", "só")], "a string, b string")
    assert [r[0] for r in df.select(T.title_and_text(F.col("a"), F.col("b"))).collect()] == ["Título texto", "", "só"]
    names = spark.createDataFrame([(" Mercado ",), ("MERCADO",), ("mercádo",), ("ﬁm º",), (None,)], "c string")
    assert [r[0] for r in names.select(T.category_name(F.col("c"))).collect()] == ["mercado", "mercado", "mercado", "fim o", None]
    words = spark.createDataFrame([("um  dois três",), ("um  dois",), (None,)], "t string")
    assert [r[0] for r in words.select(T.first_words(F.col("t"), 2)).collect()] == ["um dois", "um  dois", None]
    answers = spark.createDataFrame([("Mercado.",), ("  auto-peças, poder",), ("",), (None,), ("mercados",)], "t string")
    assert [r[0] for r in answers.select(T.first_class(F.col("t"), ["mercado", "auto-pecas"])).collect()] == ["mercado", "auto-pecas", None, None, None]
    runs = spark.createDataFrame([("abcdef",), ("abc",), ("",)], "t string").select(T.character_shingles(F.col("t"))).collect()
    assert [r[0] for r in runs] == [["abcde", "bcdef"], ["abc"], []]
    dates = spark.createDataFrame([("2016-02-29",), ("2016-02-30",), ("x",), (None,)], "d string")
    assert [r[0] for r in dates.select(T.valid_date(F.col("d"))).collect()] == [DAY(2016, 2, 29), None, None, None]


def test_buckets_compare_every_pair(spark):
    """Small and large buckets, repeated entries and sides against all pairs."""
    import random

    from vazante.operators import buckets

    rng = random.Random(8)
    rows = [(rng.choice([1, 1, 1, 2, 3, 4 + k % 9]), k % 90, rng.getrandbits(63), k % 2) for k in range(240)]
    sketch = {(i, s): b for _, i, b, s in rows}
    rows = [(n, i, sketch[i, s], s) for n, i, b, s in rows]
    rows += rows[:20]
    df = spark.createDataFrame(rows, "node long, item long, sk0 long, side int").repartition(5)
    for sided in (False, True):
        use = df if sided else df.drop("side").join(df.groupBy("item").agg(F.min("sk0").alias("x")), "item").selectExpr("node", "item", "x as sk0")
        at: dict = {}
        for r in use.collect():
            at.setdefault(r.node, set()).add((r.item, r.sk0, r.side if sided else None))
        want = set()
        for members in at.values():
            for x in members:
                for y in members:
                    if (x[2] == 0 and y[2] == 1) if sided else x[0] < y[0]:
                        if bin(x[1] ^ y[1]).count("1") <= 30:
                            want.add((x[0], y[0]))
        done = buckets.compare(use, 30, 12).cache()
        large = done.filter("large").selectExpr("a as node", "b as item", "side")
        large = large.join(use.distinct(), ["node", "item", "side"] if sided else ["node", "item"]).select("node", "item", "sk0", *(["side"] if sided else [])).distinct()
        assert large.count() and done.filter("not large").count()
        got = {tuple(r) for r in done.filter("not large").select("a", "b").union(buckets.compare_blocks(large, 30, 4)).collect()}
        assert got == want


def test_near_pairs_of_a_large_family(spark, monkeypatch):
    """A bucket of many different texts, compared in blocks, loses no pair; copies stay one class."""
    import random

    from vazante.operators import duplicates as D

    rng = random.Random(1)
    base = "".join(rng.choices("abcdefghij klm", k=900))
    texts = [base[: 10 * k] + f"#{k}#" + base[10 * k :] for k in range(70)] + [base] * 30 + [None, "", " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    whole = {tuple(r) for r in D.near_pairs(docs).pairs.collect()}
    monkeypatch.setattr(D, "SMALL", 5)
    monkeypatch.setattr(D.buckets, "BLOCK", 8)
    found = D.near_pairs(docs)
    assert {tuple(r) for r in found.pairs.collect()} == whole and len(whole) > 70 * 69 // 3
    assert found.members.filter("rep = 70").count() == 30


def test_tfidf_is_the_same_with_a_joined_vocabulary(spark, monkeypatch):
    from vazante.operators import lexical as L

    rng = random.Random(4)
    words = [f"palavra{chr(97 + k)}" for k in range(20)]
    docs = spark.createDataFrame([(k, "ab"[k % 2], " ".join(rng.choices(words, k=9)) if k % 5 else None) for k in range(80)], "id long, category string, text string")
    sent = [tuple(r) for r in L.tfidf_top(docs, 8).orderBy("categoria", "rank").collect()]
    monkeypatch.setattr(L, "MOST_TERMS", 0)
    joined = [tuple(r) for r in L.tfidf_top(docs, 8).orderBy("categoria", "rank").collect()]
    assert sent == joined and len(sent) == 16
    assert L.tfidf_top(docs.limit(0)).count() == 0
