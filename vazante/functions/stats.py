"""Statistics as column expressions, and the tails of distributions in plain Python for small inputs."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson(positives: Column, total: Column, confidence: float = 0.95) -> tuple[Column, Column, Column]:
    """Share and Wilson bounds; all null where total is not positive."""
    if not 0 < confidence < 1:
        raise ValueError("confidence lies between 0 and 1")
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    n = F.when(total > 0, total.cast("double"))
    p = positives / n
    middle = p + z * z / (2 * n)
    spread = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    low, high = F.greatest(F.lit(0.0), (middle - spread) / scale), F.least(F.lit(1.0), (middle + spread) / scale)
    return p, F.when(total > 0, low), F.when(total > 0, high)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 where one of the vectors has no length."""
    return F.coalesce(1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(1.0))


def two_proportions(n1: Column, k1: Column, n2: Column, k2: Column) -> Column:
    """Two-sided z of the difference with pooled variance; 0 where the variance is 0."""
    pooled = (k1 + k2) / (n1 + n2)
    error = F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2))
    return F.coalesce(F.try_divide(k1 / n1 - k2 / n2, error), F.lit(0.0))


def normal_tail(z: float) -> float:
    """Two-sided p of a z statistic, as 2 (1 - Phi), which underflows to 0 for large z."""
    return 2 * (1 - 0.5 * (1 + math.erf(abs(z) / math.sqrt(2))))


def chi2_tail(x: float, df: int) -> float:
    """Upper tail of the chi-squared distribution with whole degrees of freedom."""
    if x <= 0:
        return 1.0
    half = x / 2
    if df % 2 == 0:
        terms = [k * math.log(half) - math.lgamma(k + 1) for k in range(df // 2)]
        top = max(terms)
        return min(1.0, math.exp(top - half + math.log(sum(math.exp(t - top) for t in terms))))
    tail = math.erfc(math.sqrt(half))
    for k in range(1, (df + 1) // 2):
        tail += math.exp((k - 0.5) * math.log(half) - half - math.lgamma(k + 0.5))
    return min(1.0, tail)


def kendall(values: list[float]) -> tuple[float | None, float | None]:
    """Tau-b of a series against its order and its two-sided p: exact without ties up to 171 values,
    else normal. Fewer than three values give nulls."""
    n = len(values)
    if n < 3:
        return None, None
    signs = [(b > a) - (b < a) for i, a in enumerate(values) for b in values[i + 1 :]]
    score, pairs = sum(signs), len(signs)
    tied = sum(s == 0 for s in signs)
    if tied == pairs:
        return None, None
    tau = score / math.sqrt(pairs * (pairs - tied))
    if not tied and n <= 171:
        counts = [1]
        for m in range(2, n + 1):
            after = [0] * (len(counts) + m - 1)
            run = 0
            for k in range(len(after)):
                run += counts[k] if k < len(counts) else 0
                run -= counts[k - m] if k >= m else 0
                after[k] = run
            counts = after
        fewer = min((pairs - score) // 2, (pairs + score) // 2)
        return tau, min(1.0, 2 * sum(counts[: fewer + 1]) / math.factorial(n))
    groups: dict[float, int] = {}
    for v in values:
        groups[v] = groups.get(v, 0) + 1
    var = (n * (n - 1) * (2 * n + 5) - sum(t * (t - 1) * (2 * t + 5) for t in groups.values())) / 18
    return tau, math.erfc(abs(score) / math.sqrt(var) / math.sqrt(2))


def chi2_k_by_2(rows: list[tuple[int, int]]) -> tuple[float | None, float | None]:
    """Chi-squared independence of a k x 2 table; with two rows the differences are corrected for
    continuity. Fewer than two rows or an empty margin give nulls."""
    rows = [r for r in rows if sum(r)]
    total = [sum(r[k] for r in rows) for k in (0, 1)]
    if len(rows) < 2 or not all(total):
        return None, None
    x = 0.0
    for row in rows:
        for k in (0, 1):
            expected = sum(row) * total[k] / sum(total)
            gap = abs(row[k] - expected)
            gap -= min(0.5, gap) if len(rows) == 2 else 0
            x += gap * gap / expected
    return x, chi2_tail(x, len(rows) - 1)


def kolmogorov_tail(gap: float, n: int, m: int) -> float:
    """Asymptotic p of a two-sample Kolmogorov-Smirnov gap."""
    t = gap * math.sqrt(n * m / (n + m))
    if t < 0.2:
        return 1.0
    return max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101))))


def fisher(p_values: list[float]) -> tuple[float, float]:
    """Fisher's combination: chi-squared and its p, with p values held in [1e-300, 1]."""
    if not p_values:
        raise ValueError("no p values to combine")
    x = -2 * sum(math.log(min(1.0, max(p, 1e-300))) for p in p_values)
    return x, chi2_tail(x, 2 * len(p_values))
