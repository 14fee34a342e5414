"""Drift between windows of embeddings, and analysis of drift results.

Rows have ``id, day, embedding``; null embeddings are left out. Every test is a sum over rows: means of
coordinates, ranks, or kernel features, so a window may hold any number of rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stats
from ..session import cut
from .corpus import numbered
from .sampling import random_key

WINDOW = ("janela_idx", "rotulo")
MOST_PAIRS = 100_000  # of windows; more are an error
SIDE = 8_192  # different vectors of a window that are worked on together
CHUNK = 1 << 18  # distances held at a time
MOST_TASKS = 2_000
FIRST_SHIFT, FIRST_BITS, NEXT_BITS, LAST_SHIFT = 39, 16, 20, 19  # of the ranges in which a median is sought, see exact_discrepancy


def in_period(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Rows with ``start <= day < end``; a null day is an error."""
    if rows.filter("day is null").limit(1).count():
        raise ValueError("null day")
    return rows.filter((F.col("day") >= F.lit(start).cast("date")) & (F.col("day") < F.lit(end).cast("date")))


def in_scope(rows: DataFrame, scope: str, column: str = "category", positive: str = "mercado") -> DataFrame:
    """``global``, the positive class, or the others (null classes among them)."""
    if scope == "global":
        return rows
    if scope == positive:
        return rows.filter(F.col(column) == positive)
    if scope == f"nao_{positive}":
        return rows.filter(~F.col(column).eqNullSafe(F.lit(positive)))
    raise ValueError(f"unknown scope: {scope}")


def aligned(vectors: DataFrame, corpus: DataFrame, key: str = "link") -> DataFrame:
    """Inner join that must be one to one and keep every vector, else an error."""
    for df, name in ((vectors, "vectors"), (corpus, "corpus")):
        if not df.groupBy(key).count().filter("count > 1").isEmpty():
            raise ValueError(f"repeated {key} in the {name}")
    joined = vectors.join(corpus, key)
    if joined.count() != vectors.count():
        raise ValueError(f"{key}s of vectors are missing in the corpus")
    return joined


def _indexed(starts: DataFrame, label: Column, end: Column) -> DataFrame:
    """One row a window: dense index in order of start."""
    index = (F.row_number().over(W.partitionBy().orderBy("inicio")) - 1).cast("int")
    return starts.select(index.alias("janela_idx"), label.alias("rotulo"), "inicio", end.alias("fim"), "n")


def monthly_windows(rows: DataFrame) -> DataFrame:
    """``janela_idx, rotulo, inicio, fim, n`` of the months that have rows."""
    starts = rows.groupBy(F.trunc("day", "MM").alias("inicio")).agg(F.count("*").alias("n"))
    return _indexed(starts.filter("inicio is not null"), F.date_format("inicio", "yyyy-MM"), F.add_months("inicio", 1))


def fortnightly_windows(rows: DataFrame, days: int = 14) -> DataFrame:
    """Windows of ``days`` days from the first of the first month; a last partial window is left out."""
    if days <= 0:
        raise ValueError("days must be positive")
    per_day = rows.filter("day is not null").groupBy("day").agg(F.count("*").alias("n"))
    ends = per_day.agg(F.trunc(F.min("day"), "MM").alias("origin"), F.max("day").alias("last"))
    place = F.floor(F.datediff("day", "origin") / days).cast("int")
    kept = per_day.join(F.broadcast(ends)).withColumn("k", place).filter((F.col("k") + 1) * days <= F.datediff("last", "origin") + 1)
    starts = kept.groupBy(F.expr(f"date_add(origin, k * {days})").alias("inicio")).agg(F.sum("n").alias("n"))
    label = F.concat(F.date_format("inicio", "yyyy-MM-dd"), F.lit("_"), F.date_format(F.date_add("inicio", days - 1), "yyyy-MM-dd"))
    return _indexed(starts, label, F.date_add("inicio", days))


def windowed(rows: DataFrame, windows: DataFrame, unit: str = "month") -> DataFrame:
    """``rows`` with the index and label of their window: an equi-join on the window's start.

    ``unit`` is ``month`` or a number of days, as text.
    """
    if unit == "month":
        start = F.trunc("day", "MM")
        keyed = rows.withColumn("inicio", start)
    else:
        origin = windows.agg(F.min("inicio").alias("__origin"))
        keyed = rows.join(F.broadcast(origin)).withColumn("inicio", F.expr(f"date_add(__origin, cast(floor(datediff(day, __origin) / {int(unit)}) as int) * {int(unit)})")).drop("__origin")
    return keyed.join(windows.select(*WINDOW, "inicio"), "inicio").drop("inicio")


def random_windows(rows: DataFrame, windows: DataFrame, repetitions: int = 5, seed: int = 2026) -> DataFrame:
    """``repeticao, id, janela_idx, rotulo``: disjoint random parts of ``rows(id)`` of the windows' sizes.

    A row's place in the random order of a repetition falls into one of the windows' ranges.
    """
    sizes = windows.select("janela_idx", "n", (F.sum("n").over(W.partitionBy().orderBy("janela_idx")) - F.col("n")).alias("first"))
    total = windows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if total > rows.count():
        raise ValueError("windows hold more rows than there are")
    starts = sizes.filter("n > 0").agg(F.sort_array(F.collect_list(F.struct(F.col("first"), "janela_idx"))).alias("starts"))
    out = None
    for r in range(repetitions):
        keyed = rows.select("id", random_key(F.col("id"), f"{seed + r}:").alias("key"))
        placed = numbered(keyed, [F.col("key").asc(), F.col("id").asc()], "place").filter(F.col("place") < total).join(F.broadcast(starts))
        index = F.element_at(F.filter("starts", lambda s: s["first"] <= F.col("place")), -1)["janela_idx"]
        part = placed.select(F.lit(r).alias("repeticao"), "id", index.alias("janela_idx"), F.format_string("rand_%03d", index).alias("rotulo"))
        out = part if out is None else out.union(part)
    return out


def _width(rows: DataFrame) -> int:
    first = rows.filter("embedding is not null").select(F.size("embedding")).first()
    return first[0] if first else 0


def centroids(rows: DataFrame) -> DataFrame:
    """``janela_idx, rotulo, n, centroide`` (means in double precision) of windowed rows."""
    width = _width(rows)
    means = [F.avg(F.get("embedding", F.lit(k)).cast("double")) for k in range(width)]
    return rows.filter("embedding is not null").groupBy(*WINDOW).agg(F.count("*").alias("n"), F.array(*means).alias("centroide"))


def consecutive_cosine(means: DataFrame) -> DataFrame:
    """Cosine distance of each window's centroid to that of the window before."""
    order = W.partitionBy().orderBy("janela_idx")  # one row a window
    pairs = means.select("rotulo", "centroide", F.lag("rotulo").over(order).alias("a"), F.lag("centroide").over(order).alias("b")).filter("a is not null")
    return pairs.select(F.lit("cosine_centroid").alias("metrica"), F.col("a").alias("janela_a"), F.col("rotulo").alias("janela_b"), stats.cosine_distance(F.col("b"), F.col("centroide")).alias("valor"))


def cumulative_cosine(means: DataFrame, width: int) -> DataFrame:
    """Cosine distance of each centroid to the mean of all earlier centroids, each window weighing the same."""
    order = W.partitionBy().orderBy("janela_idx")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    history = F.array(*(F.avg(F.get("centroide", F.lit(k))).over(earlier) for k in range(width)))
    pairs = means.select("rotulo", "centroide", F.lag("rotulo").over(order).alias("a"), history.alias("h")).filter("a is not null")
    return pairs.select(
        F.lit("cumulative_cosine").alias("metrica"), F.concat(F.lit("historico_ate_"), "a").alias("janela_a"), F.col("rotulo").alias("janela_b"), stats.cosine_distance(F.col("h"), F.col("centroide")).alias("valor")
    )


def pair_rows(rows: DataFrame) -> DataFrame:
    """Every windowed row once for each pair of neighbouring windows: ``par, lado`` (0 earlier, 1 later)."""
    both = F.array(F.struct(F.col("janela_idx").alias("par"), F.lit(0).alias("lado")), F.struct((F.col("janela_idx") - 1).alias("par"), F.lit(1).alias("lado")))
    last = rows.agg(F.max("janela_idx").alias("last"))
    sided = rows.filter("embedding is not null").select("*", F.explode(both).alias("p")).select(*rows.columns, "p.par", "p.lado")
    return sided.join(F.broadcast(last)).filter("par >= 0 and par < last").drop("last")


def _by_dimension(rows: DataFrame) -> DataFrame:
    """Distinct values of each pair and dimension with their rows on both sides and running sums."""
    long = pair_rows(rows).select("par", "lado", F.posexplode("embedding").alias("dim", "v"))
    values = long.groupBy("par", "dim", F.col("v").cast("double").alias("v")).agg(F.count_if(F.col("lado") == 0).alias("a"), F.count_if(F.col("lado") == 1).alias("b"))
    order = W.partitionBy("par", "dim").orderBy("v")
    every = W.partitionBy("par", "dim")
    return values.select("par", "dim", "a", "b", F.sum("a").over(order).alias("ca"), F.sum("b").over(order).alias("cb"), F.sum("a").over(every).alias("n"), F.sum("b").over(every).alias("m"))


def ks_statistics(rows: DataFrame) -> DataFrame:
    """``par, dim, estatistica, n, m``: the largest gap of the two distributions of each dimension."""
    gap = F.max(F.abs(F.col("ca") / F.col("n") - F.col("cb") / F.col("m")))
    return _by_dimension(rows).groupBy("par", "dim").agg(gap.alias("estatistica"), F.max("n").alias("n"), F.max("m").alias("m"))


def cvm_statistics(rows: DataFrame) -> DataFrame:
    """``par, dim, estatistica, n, m``: the two-sample Cramer-von Mises T, from pooled counts (ties share a step)."""
    n, m = F.col("n").cast("double"), F.col("m").cast("double")
    gap = F.col("ca") / n - F.col("cb") / m
    t = F.sum((F.col("a") + F.col("b")) * gap * gap * n * m / ((n + m) * (n + m)))
    return _by_dimension(rows).groupBy("par", "dim").agg(t.alias("estatistica"), F.max("n").alias("n"), F.max("m").alias("m"))


def cvm_tail(t: float, n: int, m: int) -> float:
    """Asymptotic p of a Cramer-von Mises T, standardised by its exact mean and variance.

    The limit is the law of a sum of chi-squared variables with weights 1/(pi j)^2; its tail is read by
    inverting the characteristic function.
    """
    total = n + m
    mean = (1 + 1 / total) / 6
    var = (total + 1) * (4 * n * m * total - 3 * (n * n + m * m) - 2 * n * m) / (45 * total * total * 4 * n * m)
    x = max(0.0, (t - mean) / np.sqrt(45 * var) + 1 / 6) if var > 0 else t
    grid, tail = _limit_tail()
    return float(np.interp(x, grid, tail))


@lru_cache(1)
def _limit_tail() -> tuple[np.ndarray, np.ndarray]:
    """The limit law's tail on a grid, by Imhof's inversion; terms beyond the 80th count by their mean."""
    grid = np.concatenate([[0.0], np.geomspace(0.01, 4, 200)])
    u = np.linspace(1e-6, 1500, 15_001)
    weights = 1 / (np.pi * np.arange(1, 81)) ** 2
    angle = 0.5 * np.arctan(u[:, None] * weights).sum(1) + 0.5 * u * (1 / 6 - weights.sum())
    size = u * np.exp(0.25 * np.log1p((u[:, None] * weights) ** 2).sum(1))
    f = np.sin(angle - 0.5 * u * grid[:, None]) / size
    tail = 0.5 + (f[:, 1:] + f[:, :-1]).sum(1) / 2 * (u[1] - u[0]) / np.pi
    tail[0] = 1.0
    return grid, np.minimum.accumulate(np.clip(tail, 0, 1))


def combined(statistics: DataFrame, test: str) -> DataFrame:
    """``par, teste, p_value, estatistica``: p of every dimension, combined by Fisher; a pair has one row a dimension."""
    tail = {"KS": stats.kolmogorov_tail, "CVM": cvm_tail}[test]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = [tail(*row) for row in pdf[["estatistica", "n", "m"]].itertuples(index=False)]
        x, combined_p = stats.fisher(p)
        return pd.DataFrame([(pdf["par"].iloc[0], test, combined_p, x)], columns=["par", "teste", "p_value", "estatistica"])

    return statistics.groupBy("par").applyInPandas(run, "par int, teste string, p_value double, estatistica double")


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``x`` to those of ``y``."""
    return np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T, 0)


def _kernel_bases(sided: DataFrame, seed: str, centres: int, sample: int) -> dict[int, tuple[float, np.ndarray]]:
    """Bandwidth and centres of each pair of windows, from its rows with the least keys on whichever side.

    The side must not count: permuted sides are compared with the true ones. The rank filter is applied
    within each task before the shuffle.
    """
    keyed = sided.select("par", "id", "embedding", random_key(F.col("id"), seed).alias("key"))
    place = F.row_number().over(W.partitionBy("par").orderBy("key", "id"))
    drawn = keyed.withColumn("place", place).filter(F.col("place") <= sample)

    def base(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf.sort_values("place")["embedding"].tolist(), float)
        gaps = _squares(x, x)[np.triu_indices(len(x), 1)]
        sigma = max(float(np.sqrt(np.median(gaps))), 1e-9) if len(gaps) else 1.0
        return pd.DataFrame([(pdf["par"].iloc[0], sigma, x[:centres].tobytes(), x.shape[1])], columns=["par", "sigma", "middle", "width"])

    found = drawn.groupBy("par").applyInPandas(base, "par int, sigma double, middle binary, width int").limit(MOST_PAIRS + 1).collect()  # a row a pair of windows
    if len(found) > MOST_PAIRS:
        raise ValueError(f"more than {MOST_PAIRS} pairs of windows")
    return {r["par"]: (r["sigma"], np.frombuffer(r["middle"], float).reshape(-1, r["width"])) for r in found}


def kernel_tests(rows: DataFrame, permutations: int = 100, seed: int = 2026, features: int = 256, centres: int = 64, sample: int = 512) -> DataFrame:
    """``par, teste, p_value, estatistica`` of the kernel two-sample test (KTS) and the least-squares density
    difference (LSDD) of neighbouring windows, with permutation p values.

    Both depend on the rows through mean feature vectors only: random Fourier features of a Gaussian kernel
    for KTS (their squared distance estimates the squared maximum mean discrepancy), kernel values at a few
    centres for LSDD. A task adds up the features of its rows under the true and under randomly redrawn
    sides; the sums are merged by pair. The bandwidth (median distance) and the centres are those of each pair of
    windows: of its ``sample`` rows with the least random keys, whichever their side, or of all its rows if
    they are fewer. The tests cover all rows.
    """
    width = _width(rows)
    sided = pair_rows(rows).select("par", "lado", "id", "embedding")
    bases = _kernel_bases(sided, f"{seed}", centres, sample)
    if not bases:
        return rows.sparkSession.createDataFrame([], "par int, teste string, p_value double, estatistica double")
    rng = np.random.default_rng(seed)
    slopes, shifts = rng.normal(0, 1, (width, features)), rng.uniform(0, 2 * np.pi, features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            par, side, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            vectors = np.array(batch.column(3).to_pylist(), float)
            for p in np.unique(par):
                at = par == p
                x, share, (sigma, middle) = vectors[at], shares[int(p)], bases[int(p)]
                near = np.exp(-_squares(x, middle) / (2 * sigma**2))
                phi = np.concatenate([np.sqrt(2 / features) * np.cos(x @ slopes / sigma + shifts), near, np.ones((len(x), 1))], axis=1)
                draws = np.random.default_rng([seed, int(p), zlib.crc32(str(ids[at][0]).encode()), int(at.sum())]).random((permutations, at.sum())) < share
                later = np.concatenate([side[None, at] == 1, draws]).astype(float)
                both = np.stack([later @ phi, (1 - later) @ phi])
                sums[int(p)] = sums.get(int(p), 0) + both
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["par", "sums"])

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        sigma, middle = bases[int(pdf["par"].iloc[0])]
        shape = (2, permutations + 1, features + len(middle) + 1)
        total = np.zeros(shape)
        for data in pdf["sums"]:
            total += np.frombuffer(data, float).reshape(shape)
        means = total[:, :, :-1] / np.maximum(total[:, :, -1:], 1)
        gap = means[0] - means[1]
        mmd = (gap[:, :features] ** 2).sum(1)
        h = gap[:, features:]
        square = np.exp(-_squares(middle, middle) / (4 * sigma**2))
        theta = np.linalg.solve(square + 0.1 * np.eye(len(middle)), h.T).T
        lsdd = 2 * (theta * h).sum(1) - ((theta @ square) * theta).sum(1)
        out = [(pdf["par"].iloc[0], name, float((v[1:] >= v[0]).mean()), float(v[0])) for name, v in (("KTS", mmd), ("LSDD", lsdd))]
        return pd.DataFrame(out, columns=["par", "teste", "p_value", "estatistica"])

    sizes = sided.groupBy("par").agg(F.avg("lado").alias("share")).limit(MOST_PAIRS + 1).collect()  # as many as bases
    shares = {r["par"]: r["share"] for r in sizes}
    parts = cut(sided.mapInArrow(run, "par int, sums binary"), "kernel-sums")
    return parts.groupBy("par").applyInPandas(test, "par int, teste string, p_value double, estatistica double")


def exact_kernel_tests(rows: DataFrame, permutations: int = 100, seed: int = 2026, most: int = 2_000) -> DataFrame:
    """The columns of :func:`kernel_tests` from whole kernel matrices, one pair of windows in one task.

    For small windows, and to compare with: the discrepancy is that of all rows, the density difference has a centre
    at every row, and sides are permuted rather than redrawn. Bandwidth is the median distance of the pair's rows.
    Pairs of more than ``most`` rows are an error.
    """
    sided = pair_rows(rows).select("par", "lado", "id", "embedding")
    largest = sided.groupBy("par").count().agg(F.max("count")).first()[0] or 0
    if largest > most:
        raise ValueError(f"a pair of windows has {largest} rows, more than {most}: use kernel_tests")

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x, side = np.array(pdf["embedding"].tolist(), float), pdf["lado"].to_numpy()
        gaps = _squares(x, x)
        above = gaps[np.triu_indices(len(x), 1)]
        sigma2 = max(float(np.median(above)), 1e-18) if len(above) else 1.0
        near, wide = np.exp(-gaps / (2 * sigma2)), np.exp(-gaps / (4 * sigma2))
        rng = np.random.default_rng([seed, int(pdf["par"].iloc[0])])
        sides = np.stack([side, *(rng.permutation(side) for _ in range(permutations))])
        later = sides == 1
        signs = later / np.maximum(later.sum(1, keepdims=True), 1) - ~later / np.maximum((~later).sum(1, keepdims=True), 1)
        h = signs @ near
        mmd = (h * signs).sum(1)
        theta = np.linalg.solve(wide + 0.1 * np.eye(len(x)), h.T).T
        lsdd = 2 * (theta * h).sum(1) - ((theta @ wide) * theta).sum(1)
        out = [(pdf["par"].iloc[0], name, float((v[1:] >= v[0] - 1e-12).mean()), float(v[0])) for name, v in (("KTS", mmd), ("LSDD", lsdd))]
        return pd.DataFrame(out, columns=["par", "teste", "p_value", "estatistica"])

    return sided.groupBy("par").applyInPandas(test, "par int, teste string, p_value double, estatistica double")


def _cells(vectors: DataFrame, parts: dict[int, int]) -> DataFrame:
    """``wa, ia, wb, ib, lado, embedding, n`` of ``vectors(janela_idx, embedding, n)``: each of the ``parts`` of a window
    beside every part of its own and of the next window. A part beside itself is there once."""
    known = vectors.sparkSession.createDataFrame([(w, k, parts.get(w + 1, 0), parts.get(w - 1, 0)) for w, k in parts.items()], "janela_idx int, own int, after int, before int")
    placed = vectors.join(F.broadcast(known), "janela_idx").withColumn("part", F.pmod(F.xxhash64("embedding"), F.col("own")).cast("int"))
    w, part = F.col("janela_idx"), F.col("part")

    def beside(parts: str, wa: Column, wb: Column, make) -> Column:
        def cell(k: Column) -> Column:
            ia, ib, side = make(k)
            return F.struct(wa.alias("wa"), ia.alias("ia"), wb.alias("wb"), ib.alias("ib"), side.cast("int").alias("lado"))

        return F.transform(F.filter(F.sequence(F.lit(0), F.col(parts)), lambda k: k < F.col(parts)), cell)

    own = beside("own", w, w, lambda k: (F.least(part, k), F.greatest(part, k), k < part))
    later = beside("after", w, w + 1, lambda k: (part, k, F.lit(0)))
    earlier = beside("before", w - 1, w, lambda k: (k, part, F.lit(1)))
    return placed.select(F.explode(F.concat(own, later, earlier)).alias("c"), "embedding", "n").select("c.*", "embedding", "n")


def _gaps(pdf: pd.DataFrame, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Squared distances in a cell, each pair of vectors once, and the pairs of rows that each stands for (None: one)."""
    x, y = (np.array(pdf["embedding"][pdf["lado"] == side].tolist(), float) for side in (0, 0 if same else 1))
    n, m = (pdf["n"][pdf["lado"] == side].to_numpy(float) for side in (0, 0 if same else 1))
    if not len(x) or not len(y):
        return
    middle = np.median(x, axis=0)
    x, y = x - middle, y - middle
    a, b = (x**2).sum(1), (y**2).sum(1)
    left = np.concatenate([-2 * x, a[:, None], np.ones((len(x), 1))], axis=1)
    right = np.concatenate([y, np.ones((len(y), 1)), b[:, None]], axis=1).T.copy()
    plain = n.max() == 1 and m.max() == 1
    if same and not plain:
        yield np.zeros(1), np.array([(n * (n - 1) / 2).sum()])  # copies

    def block(i: slice, j: slice) -> np.ndarray:
        d = left[i] @ right[:, j]
        if d.min() < 1e-6 * (a[i].max() + b[j].max()):  # differences of nearly equal numbers are taken anew
            r, c = np.nonzero(d < 1e-6 * (a[i][:, None] + b[j]))
            for k in range(0, len(r), 10_000):
                p, q = r[k : k + 10_000], c[k : k + 10_000]
                d[p, q] = ((x[i][p] - y[j][q]) ** 2).sum(1)
        return np.abs(d, out=d)

    height = max(1, CHUNK // len(y))
    for at in range(0, len(x), height):
        i = slice(at, min(at + height, len(x)))
        j = slice(i.stop if same else 0, len(y))
        if same and i.stop - at > 1:
            above = np.triu_indices(i.stop - at, 1)
            yield block(i, i)[above], None if plain else np.outer(n[i], n[i])[above]
        if j.start < j.stop:
            yield block(i, j).ravel(), None if plain else np.outer(n[i], m[j]).ravel()


def exact_discrepancy(rows: DataFrame) -> DataFrame:
    """``par, valor``: the squared maximum mean discrepancy of neighbouring windows, from all pairs of their rows.

    The bandwidth is the median squared distance of all rows of the two windows. A task compares two parts of windows
    at a time, so a window may hold any number of rows; the work grows with its square, that of equal vectors is done
    once. The median is found by counting distances in ever narrower ranges of floating-point numbers (their bits,
    taken as integers, have the same order) until a range is narrower than one part in 10^9.
    """
    spark, schema = rows.sparkSession, "par int, valor double"
    kept = rows.filter("embedding is not null")
    vectors = cut(kept.groupBy("janela_idx", "embedding").agg(F.count("*").alias("n")), "window-vectors")
    found = vectors.groupBy("janela_idx").agg(F.sum("n").alias("n"), F.count("*").alias("different")).limit(MOST_PAIRS + 2).collect()
    if len(found) > MOST_PAIRS + 1:
        raise ValueError(f"more than {MOST_PAIRS} pairs of windows")
    sizes = {r["janela_idx"]: r["n"] for r in found}
    parts = {r["janela_idx"]: -(-r["different"] // SIDE) for r in found}
    pairs = [w for w in sizes if w + 1 in sizes]
    if not pairs:
        return spark.createDataFrame([], schema)
    spans = vectors.agg(*(F.expr(f"cast(max(embedding[{k}]) as double) - cast(min(embedding[{k}]) as double)") for k in range(_width(vectors)))).first()
    cell = ["wa", "ia", "wb", "ib"]
    cells = _cells(vectors, parts)
    tasks = min(3 * sum(k * (k + 1) // 2 + k * parts.get(w + 1, 0) for w, k in parts.items()), MOST_TASKS)

    def each_cell(run, shape: str, wanted: Sequence[int]) -> DataFrame:
        """``run`` on the cells that pairs of windows ``wanted`` need."""
        needed = sorted({w for p in wanted for w in (p, p + 1)})
        return cells.filter(F.col("wa").isin(needed)).repartition(tasks, *cell).groupBy(*cell).applyInPandas(run, shape)

    def used_by(wa: int, wb: int) -> list[int]:
        return [wa] if wa < wb else [wa - 1, wa]

    # of each pair: ranges (first bits, power of two of a bin's width and of the number of bins) and the ranks sought there
    most = np.array([max(sum(s * s for s in spans), 1e-300) * (1 + 1e-9)]).view(np.int64)[0]
    whole = (max(0, int(most) + 1 - (1 << FIRST_SHIFT + FIRST_BITS)), FIRST_SHIFT, FIRST_BITS)
    ranges: dict[int, dict[tuple, set[int]]] = {}
    for p in pairs:
        total = (sizes[p] + sizes[p + 1]) * (sizes[p] + sizes[p + 1] - 1) // 2
        ranges[p] = {whole: {(total - 1) // 2, total // 2}}
    middle: dict[int, list[float]] = {p: [] for p in pairs}
    while ranges:

        def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            wa, ia, wb, ib = map(int, key)
            tables = {r: np.zeros((2, (1 << r[2]) + 1)) for p in used_by(wa, wb) for r in ranges.get(p, ())}
            for d, weight in _gaps(pdf, (wa, ia) == (wb, ib)) if tables else ():
                bits = d.view(np.int64)
                for (low, shift, power), (number, total) in tables.items():
                    place = (bits - low) >> shift
                    inside, under = place.view(np.uint64) < (1 << power), place < 0
                    own, w = place[inside], None if weight is None else weight[inside]
                    number[0] += np.count_nonzero(under) if weight is None else weight[under].sum()
                    if shift > LAST_SHIFT and len(own) > 1 << power:
                        number[1:] += np.bincount(own, w, 1 << power)
                    else:
                        bins, where = np.unique(own, return_inverse=True)
                        number[bins + 1] += np.bincount(where, w, len(bins))
                        total[bins + 1] += np.bincount(where, d[inside] if w is None else w * d[inside], len(bins))
            out = [pd.DataFrame({"par": [], "low": [], "bin": [], "n": [], "total": []})]
            for p in used_by(wa, wb):
                for r in ranges.get(p, ()):
                    number, total = tables[r]
                    there = np.flatnonzero(number)
                    out.append(pd.DataFrame({"par": p, "low": r[0], "bin": there - 1, "n": number[there].astype(np.int64), "total": total[there]}))
            return pd.concat(out[1:] or out)

        sought = spark.createDataFrame([(p, r[0], k) for p, own in ranges.items() for r, ranks in own.items() for k in ranks], "par int, low long, rank long")
        bins = each_cell(count, "par int, low long, bin int, n long, total double", list(ranges)).groupBy("par", "low", "bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        bins = bins.withColumn("upto", F.sum("n").over(W.partitionBy("par", "low").orderBy("bin")))
        hits = bins.join(F.broadcast(sought), ["par", "low"]).filter("rank < upto and rank >= upto - n").collect()
        narrower: dict[int, dict[tuple, set[int]]] = {}
        for h in hits:
            low, shift, _ = next(r for r in ranges[h["par"]] if r[0] == h["low"])
            if h["bin"] < 0:  # under the range
                power = min(NEXT_BITS, low.bit_length())
                new = (0, low.bit_length() - power, power)
            elif shift <= LAST_SHIFT:
                middle[h["par"]].append(h["total"] / h["n"])
                continue
            else:
                power = min(NEXT_BITS, shift)
                new = (low + (h["bin"] << shift), shift - power, power)
            narrower.setdefault(h["par"], {}).setdefault(new, set()).add(h["rank"])
        ranges = narrower

    wide = {p: 2 * max(float(np.mean(m)), 1e-18) if m else 2.0 for p, m in middle.items()}

    def near(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        wa, ia, wb, ib = map(int, key)
        sums = {p: 0.0 for p in used_by(wa, wb) if p in wide}
        for d, weight in _gaps(pdf, (wa, ia) == (wb, ib)) if sums else ():
            for p in sums:
                k = np.exp(d / -wide[p])
                sums[p] += float(k.sum() if weight is None else k @ weight)
        return pd.DataFrame({"par": list(sums), "kind": ["ab" if wa < wb else "aa" if p == wa else "bb" for p in sums], "total": list(sums.values())})

    sums = {(r["par"], r["kind"]): r["total"] for r in each_cell(near, "par int, kind string, total double", pairs).groupBy("par", "kind").agg(F.sum("total").alias("total")).collect()}
    out = []
    for p in pairs:
        n, m = sizes[p], sizes[p + 1]
        own = ((2 * sums[p, kind] + k) / k**2 for kind, k in (("aa", n), ("bb", m)))  # every pair twice, a row beside itself once
        out.append((p, float(sum(own) - 2 * sums[p, "ab"] / (n * m))))
    return spark.createDataFrame(out, schema)


def all_tests(rows: DataFrame, permutations: int = 100, seed: int = 2026) -> DataFrame:
    """The four tests of all neighbouring windows."""
    return combined(ks_statistics(rows), "KS").union(combined(cvm_statistics(rows), "CVM")).union(kernel_tests(rows, permutations, seed))


def _labelled(pairs: DataFrame, rows: DataFrame, condition: str, repetition: int) -> DataFrame:
    """Pair results with the labels of their two windows, a condition and a repetition."""
    labels = rows.select(*WINDOW).distinct()
    a = labels.select(F.col("janela_idx").alias("par"), F.col("rotulo").alias("janela_a"))
    b = labels.select((F.col("janela_idx") - 1).alias("par"), F.col("rotulo").alias("janela_b"))
    fixed = {"condicao": F.lit(condition), "repeticao": F.lit(repetition)}
    return pairs.join(a, "par").join(b, "par").withColumns(fixed).drop("par")


def _conditions(rows: DataFrame, windows: DataFrame, repetitions: int, seed: int, test, unit: str, labelled: bool = False) -> DataFrame:
    """``test`` on the windows in time (repetition 0) and on randomly filled windows of the same sizes.

    ``labelled``: the results of ``test`` have the windows' labels already, not their pair.
    """

    def named(own: DataFrame, seed: int, condition: str, repetition: int) -> DataFrame:
        found = test(own, seed)
        if labelled:
            return found.withColumns({"condicao": F.lit(condition), "repeticao": F.lit(repetition)})
        return _labelled(found, own, condition, repetition)

    if windows.count() < 2:
        raise ValueError("fewer than two windows")
    ordered = cut(windowed(rows, windows, unit), "ordered")
    out = named(ordered, seed, "time_ordered", 0)
    if repetitions:
        parts = cut(random_windows(ordered.select("id"), windows, repetitions, seed).join(rows.select("id", "embedding"), "id"), "randomized")
        for r in range(repetitions):
            own = parts.filter(F.col("repeticao") == r)
            out = out.unionByName(named(own, seed + r + 1, "randomized", r))
    return out


def statistical_drift(rows: DataFrame, windows: DataFrame, repetitions: int = 5, permutations: int = 100, seed: int = 2026, unit: str = "month") -> DataFrame:
    """The four tests of neighbouring windows under both conditions: ``janela_a, janela_b, teste, condicao,
    repeticao, p_value, estatistica``. Fewer than two windows are an error."""
    found = _conditions(rows, windows, repetitions, seed, lambda r, s: all_tests(r, permutations, s), unit)
    return found.select("janela_a", "janela_b", "teste", "condicao", "repeticao", "p_value", "estatistica")


def semantic_distances(rows: DataFrame, seed: int = 2026) -> DataFrame:
    """``metrica, janela_a, janela_b, valor``: both centroid distances and the squared discrepancy of neighbours."""
    means = cut(centroids(rows), "centroids")
    labels = means.select(*WINDOW)
    mmd = kernel_tests(rows, 1, seed).filter("teste = 'KTS'").select("par", F.col("estatistica").alias("valor"))
    named = (
        mmd.join(labels.select(F.col("janela_idx").alias("par"), F.col("rotulo").alias("janela_a")), "par")
        .join(labels.select((F.col("janela_idx") - 1).alias("par"), F.col("rotulo").alias("janela_b")), "par")
        .select(F.lit("mmd2").alias("metrica"), "janela_a", "janela_b", "valor")
    )
    return consecutive_cosine(means).union(cumulative_cosine(means, _width(rows))).union(named)


def semantic_drift(rows: DataFrame, windows: DataFrame, repetitions: int = 5, seed: int = 2026, unit: str = "month") -> DataFrame:
    """The distances of neighbouring windows under both conditions: ``metrica, janela_a, janela_b, condicao,
    repeticao, valor``. Fewer than two windows are an error."""
    found = _conditions(rows, windows, repetitions, seed, semantic_distances, unit, labelled=True)
    return found.select("metrica", "janela_a", "janela_b", "condicao", "repeticao", "valor")


def p_value_table(results: DataFrame) -> DataFrame:
    """Count, mean, deviation (0 of one) and exact quartiles of the p values by scope, granularity, test and condition."""
    q = F.percentile("p_value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return (
        results.groupBy("escopo", "granularidade", "teste", "condicao")
        .agg(F.count("*").alias("n"), F.avg("p_value").alias("mean"), F.coalesce(F.stddev_samp("p_value"), F.lit(0.0)).alias("std"), q.alias("q"))
        .select("escopo", "granularidade", "teste", "condicao", "n", "mean", "std", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"))
    )


def condition_gap(table: DataFrame) -> DataFrame:
    """Mean of the tests' mean p values by condition and their gap (randomised less ordered)."""
    wide = table.groupBy("escopo", "granularidade").pivot("condicao", ["time_ordered", "randomized"]).agg(F.avg("mean"))
    return wide.withColumn("gap", F.col("randomized") - F.col("time_ordered"))


def pair_index(results: DataFrame) -> DataFrame:
    """``par_idx``: place of a pair among those of its scope, condition, repetition and test, by first window."""
    order = W.partitionBy("escopo", "condicao", "repeticao", "teste").orderBy("janela_a", "janela_b", F.col("p_value").asc_nulls_first(), "estatistica")
    return results.withColumn("par_idx", (F.row_number().over(order) - 1).cast("long"))


def envelope(results: DataFrame, test: str = "KTS") -> DataFrame:
    """Least and largest p of the randomised repetitions at each pair index."""
    rows = pair_index(results).filter((F.col("teste") == test) & (F.col("condicao") == "randomized"))
    return rows.groupBy("escopo", "par_idx").agg(F.min("p_value").alias("min"), F.max("p_value").alias("max"))


def without_window(results: DataFrame, label: str = "2017-10", granularity: str = "mensal") -> DataFrame:
    """Monthly results whose pair touches the window are dropped; other granularities stay whole."""
    touches = F.coalesce((F.col("janela_a") == label) | (F.col("janela_b") == label), F.lit(False))
    return results.filter(~((F.col("granularidade") == granularity) & touches))


def dropped_rows(results: DataFrame, label: str = "2017-10", granularity: str = "mensal") -> DataFrame:
    """``granularidade, escopo, linhas``: rows that :func:`without_window` leaves out of each; 0 where none."""
    every = results.groupBy("granularidade", "escopo").agg(F.count("*").alias("n"))
    left = without_window(results, label, granularity).groupBy("granularidade", "escopo").agg(F.count("*").alias("m"))
    return every.join(left, ["granularidade", "escopo"], "left").select("granularidade", "escopo", (F.col("n") - F.coalesce("m", F.lit(0))).alias("linhas"))


def restricted(rows: DataFrame, granularities: Sequence[str] | None = None, scopes: Sequence[str] | None = None) -> DataFrame:
    """Rows of some granularities and scopes; None stands for all."""
    for column, values in (("granularidade", granularities), ("escopo", scopes)):
        if values is not None:
            rows = rows.filter(F.col(column).isin(list(values)))
    return rows


def paired_conditions(results: DataFrame) -> DataFrame:
    """``escopo, teste, par_idx, ordenado, medio, minimo, maximo``: the p value in time at each pair index beside those of
    the randomised repetitions at the same index. Indexes that one condition lacks have nulls there."""
    rows = pair_index(results)
    ordered = rows.filter("condicao = 'time_ordered'").groupBy("escopo", "teste", "par_idx").agg(F.min("p_value").alias("ordenado"))
    drawn = rows.filter("condicao = 'randomized'").groupBy("escopo", "teste", "par_idx").agg(F.avg("p_value").alias("medio"), F.min("p_value").alias("minimo"), F.max("p_value").alias("maximo"))
    return ordered.join(drawn, ["escopo", "teste", "par_idx"], "full")


def main_runs(runs: DataFrame) -> DataFrame:
    """The run of each granularity and scope: no smoke run, most rows, then the latest."""
    order = W.partitionBy("granularidade", "escopo").orderBy(F.desc("n"), F.desc("ts"))
    return runs.filter("limite_pares is null").withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")


def daily_centroids(rows: DataFrame) -> DataFrame:
    """Centroid of every day that has vectors, in order."""
    days = rows.filter("day is not null").withColumns({"janela_idx": F.datediff("day", F.lit("1970-01-01").cast("date")), "rotulo": F.date_format("day", "yyyy-MM-dd")})
    return centroids(days)


def change_points(means: DataFrame, most: int = 5, least: int = 7, max_days: int = 100_000) -> DataFrame:
    """Days at which the level of the first principal component of the centroids changes, by binary segmentation.

    One row a day enters, and their number is checked. ``ganho`` is the fall of the squared error; splits are
    taken by gain, each side keeping at least ``least`` days.
    """
    rows = means.orderBy("janela_idx").select("rotulo", "centroide").limit(max_days + 1).collect()
    if len(rows) > max_days:
        raise ValueError(f"more than {max_days} days")
    schema = "rotulo string, ganho double"
    if len(rows) < 2 * least:
        return means.sparkSession.createDataFrame([], schema)
    x = np.array([r["centroide"] for r in rows])
    x = x - x.mean(0)
    s = x @ np.linalg.svd(x, full_matrices=False)[2][0]
    c1 = np.concatenate([[0], np.cumsum(s)])

    def best(a: int, b: int) -> tuple[float, int]:
        k = np.arange(a + least, b - least + 1)
        if not len(k):
            return 0.0, -1
        gain = (c1[k] - c1[a]) ** 2 / (k - a) + (c1[b] - c1[k]) ** 2 / (b - k) - (c1[b] - c1[a]) ** 2 / (b - a)
        return float(gain.max()), int(k[gain.argmax()])

    parts, found = [(*best(0, len(s)), 0, len(s))], []
    while parts and len(found) < most:
        parts.sort(reverse=True)
        gain, k, a, b = parts.pop(0)
        if k < 0:
            break
        found.append((rows[k]["rotulo"], gain))
        parts += [(*best(a, k), a, k), (*best(k, b), k, b)]
    return means.sparkSession.createDataFrame(found, schema)
