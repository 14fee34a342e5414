import math

import pytest
from pyspark.sql import functions as F

from vazante.functions import stats as S
from vazante.operators.drift import cvm_tail


def test_published_interval(spark):
    one = spark.sql("select 20970 k, 167053 n union all select 0, 0").select(*S.wilson(F.col("k"), F.col("n"))).collect()
    assert one[0][1] == pytest.approx(0.1239488424, abs=1e-10) and one[0][2] == pytest.approx(0.1271264270, abs=1e-10)
    assert tuple(one[1]) == (None, None, None)
    with pytest.raises(ValueError):
        S.wilson(F.col("k"), F.col("n"), 1.0)


def test_chi_squared_tails():
    assert S.chi2_tail(105.9203399682, 2) == pytest.approx(9.99287e-24, rel=1e-5)
    assert S.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    assert S.chi2_tail(7.814727903251179, 3) == pytest.approx(0.05, rel=1e-9)
    assert S.chi2_tail(0, 5) == 1.0 and 0 < S.chi2_tail(1600, 1536) < 1


def test_exact_kendall_matches_enumeration():
    from itertools import permutations

    base = (1, 2, 5, 3, 4)
    score = lambda p: sum((b > a) - (b < a) for i, a in enumerate(p) for b in p[i + 1 :])
    tau, p = S.kendall(list(base))
    all_scores = [score(x) for x in permutations(base)]
    assert p == pytest.approx(sum(abs(s) >= abs(score(base)) for s in all_scores) / len(all_scores))
    assert S.kendall(list(range(24)))[0] == 1.0 and S.kendall([1, 2]) == (None, None) and S.kendall([1, 1, 1]) == (None, None)
    assert S.kendall([5, 4, 3, 3])[0] == pytest.approx(-5 / math.sqrt(30))


def test_published_kendall():
    # 33 values without ties at the published tau: 395 rising of 528 pairs
    values, fall = list(range(33)), 133
    for _ in range(fall):
        k = next(i for i in range(32) if values[i] < values[i + 1])
        values[k], values[k + 1] = values[k + 1], values[k]
    tau, p = S.kendall(values)
    assert tau == pytest.approx(0.4962121212) and p == pytest.approx(2.48175e-05, rel=1e-4)


def test_tables_and_combination():
    x, p = S.chi2_k_by_2([(150, 850), (100, 900), (200, 800)])
    assert p < 0.01 and S.chi2_k_by_2([(1, 2)]) == (None, None) and S.chi2_k_by_2([(0, 5), (0, 9)]) == (None, None)
    assert S.chi2_k_by_2([(10, 20), (20, 10)])[0] == pytest.approx(5.4)
    x, p = S.fisher([0.0, 0.5, 1.0])
    assert math.isfinite(x) and 0 <= p <= 1
    with pytest.raises(ValueError):
        S.fisher([])


def test_tails_of_distribution_gaps():
    assert S.kolmogorov_tail(0.0, 50, 50) == 1.0
    assert S.kolmogorov_tail(1.358 / math.sqrt(500), 1000, 1000) == pytest.approx(0.05, abs=0.001)
    n = 10_000
    assert cvm_tail(0.46136, n, n) == pytest.approx(0.05, abs=0.002)
    assert cvm_tail(0.74346, n, n) == pytest.approx(0.01, abs=0.001)
    assert cvm_tail(0.0, n, n) == 1.0


def test_vectors(spark):
    row = spark.sql("select array(1D, 0D) a, array(0D, 2D) b, array(0D, 0D) c")
    out = row.select(*(S.cosine_distance(F.col(x), F.col(y)) for x, y in ("ab", "aa", "ac"))).first()
    assert tuple(out) == (1.0, 0.0, 1.0)
    sets = spark.sql("select array('a','b') a, array('b','c') b, cast(array() as array<string>) c")
    assert sets.select(S.jaccard(F.col("a"), F.col("b")), S.jaccard(F.col("c"), F.col("c"))).first()[:] == (1 / 3, 0.0)


def test_two_proportions(spark):
    z = spark.range(1).select(S.two_proportions(F.lit(1000.0), F.lit(150.0), F.lit(1000.0), F.lit(100.0)), S.two_proportions(F.lit(5.0), F.lit(0.0), F.lit(5.0), F.lit(0.0))).first()
    assert S.normal_tail(z[0]) < 0.01 and z[1] == 0.0 and S.normal_tail(40) == 0.0
