import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vazante.llm import mixing, quotas, radix, terms
from vazante.llm.sketch import words_of


def test_terms(spark):
    texts = ["a b a", "A, b!", None, "", "c " * 50_000, "c", "ã_b"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = {r.term: r for r in terms.marked_terms(df, "text", lambda n, _: n <= 1, lambda n, total: n * 2 > F.lit(total)).collect()}
    total, where = Counter(), Counter()
    for t in texts:
        total.update(words_of(t or ""))
        where.update(set(words_of(t or "")))
    assert {t: (r.occurrences, r.records) for t, r in got.items()} == {t: (total[t], where[t]) for t in total}
    assert got["ã"].mark == "rare" and got["b"].mark is None and got["a"].field == "text"


def test_terms_of_nothing(spark):
    df = spark.createDataFrame([], "text string")
    assert terms.marked_terms(df, "text", lambda n, _: n <= 1, lambda n, total: n > F.lit(total)).count() == 0


RECORDS = [
    (1, "https://x.com/a?p=1&q=2", "Um Título", "O texto."), (2, "HTTPS://X.com/a?q=2&p=1", "um titulo", "o texto"),
    (3, "https://x.com/a?q=2&p=1", "O TEXTO!", "um  título"), (4, "https://x.com/b", None, None), (5, "https://x.com/b", "", " "),
    (6, None, None, None), (7, "", "...", None), (8, "https://x.com/c", "t", "longo " * 40_000), (9, "https://x.com/c", "LONGO" * 40_000, "T"),
    (10, "https://x.com/a?p=1&q=2", "Um Título", "O texto."), (11, "https://x.com/a?p=1&q=2", "um título", "o texto"),
]


@pytest.mark.parametrize("settings", [radix.RadixSettings(), radix.RadixSettings(fits=1, step=1), radix.RadixSettings(fits=2, step=3)])
def test_format_duplicates(spark, settings):
    df = spark.createDataFrame([(*r, "x", "y") for r in RECORDS], "id long, link string, title string, text string, key string, copies string").repartition(3)
    key = radix.canonical_record(F.col("link"), F.col("title"), F.col("text"))
    found = radix.format_duplicates(df.select("id", key.alias("key")), settings)
    assert {(r.id_a, r.id_b) for r in radix.copies_of(found).collect()} == {(1, 3), (1, 10), (1, 11), (4, 5), (6, 7), (8, 9)}
    assert {r.first_id: r.copies for r in found.groups.collect()} == {1: 4, 2: 1, 4: 2, 6: 2, 8: 2}


def test_format_duplicates_many_buckets(spark):
    rows = [(k, f"prefixo comum {k % 700:05d}".encode()) for k in range(2100)] + [(9000 + k, b"prefixo") for k in range(500)]
    found = radix.format_duplicates(spark.createDataFrame(rows, "id long, key binary"), radix.RadixSettings(fits=20, step=2))
    groups = {r.first_id: r.copies for r in found.groups.collect()}
    assert groups == {k: 3 for k in range(700)} | {9000: 500}


def test_format_duplicates_with_long_common_parts(spark):
    """Strings that share thousands of bytes are split in few levels; the same string from many tasks is one group."""
    stem = b"mesmo " * 900
    rows = [(k, stem + b"fim %04d" % (k % 300)) for k in range(900)] + [(5000 + k, stem) for k in range(40)] + [(7000, b"outro"), (7001, b"outro" + stem)]
    df = spark.createDataFrame(rows, "id long, key binary").repartition(8)
    entries = radix.combine(df).filter("copies is not null").cache()
    splits = radix.split_table(entries, 20, 2)
    assert len({len(p) for p in splits}) < 8
    groups = {r.first_id: r.copies for r in radix.format_duplicates(df, radix.RadixSettings(fits=20, step=2)).groups.collect()}
    assert groups == {k: 3 for k in range(300)} | {5000: 40, 7000: 1, 7001: 1}
    sizes = radix.bucketed(entries, radix.RadixSettings(fits=20, step=2)).groupBy("bucket").count().collect()
    assert max(r["count"] for r in sizes) <= 20


def test_format_duplicates_of_nothing(spark):
    found = radix.format_duplicates(spark.createDataFrame([], "id long, key binary"))
    assert found.groups.count() == 0 and radix.copies_of(found).count() == 0


def test_allocate():
    assert quotas.allocate(10, [50, 30, 20], [0, 0, 0], [99, 99, 99]) == [5, 3, 2]
    assert quotas.allocate(10, [50, 50], [0, 0], [2, 99]) == [2, 8]
    assert quotas.allocate(10, [90, 10], [0, 4], [99, 99]) == [6, 4]
    assert quotas.allocate(10, [50, 50], [0, 0], [1, 2]) == [1, 2]
    assert quotas.allocate(0, [50, 50], [3, 3], [9, 9]) == [0, 0]
    assert quotas.allocate(5, [0, 0], [1, 0], [9, 9]) == [1, 0]
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = rng.integers(1, 8)
        shares, least, there = rng.integers(0, 50, n).tolist(), rng.integers(0, 4, n).tolist(), rng.integers(0, 60, n).tolist()
        size = int(rng.integers(0, 120))
        q = quotas.allocate(size, shares, least, there)
        assert all(0 <= a <= b for a, b in zip(q, there)) and sum(q) <= size
        if sum(least) <= size:
            assert all(a >= min(b, c) for a, b, c in zip(q, least, there))
        weighted = sum(t for t, s in zip(there, shares) if s)
        if all(shares) and weighted >= size and not any(least):
            assert sum(q) == size


def _targets(spark, rows):
    return spark.createDataFrame(rows, "target_set string, target_year int, sample_pct int, category string, target_pct int, min_rows int, name string, available string")


def test_quotas_and_sample(spark):
    rows = spark.createDataFrame([(k, 2016, "a" if k % 3 else "b", "x") for k in range(600)] + [(700, 2016, "c", "x"), (701, 2015, "a", "x")], "id long, year int, name string, target_set string")
    targets = _targets(spark, [("s", 2016, 50, "A", 60, 0, "a", "z"), ("s", 2016, 50, "b", 30, 0, "b", "z"), ("s", 2016, 50, "c", 10, 5, "c", "z"), (None, 2016, 1, "a", 1, 1, "a", "z"), ("vazio", 1999, 50, "a", 100, 2, "a", "z")])
    quota = quotas.quotas(rows, targets)
    got = {(r.target_set, r.category): r for r in quota.collect()}
    assert got["s", "A"].sample_rows == 300 and got["s", "c"].wanted == 30
    assert [got["s", c].quota for c in ("A", "b", "c")] == [199, 100, 1]
    drawn = quotas.draw(rows, quota)
    reported = quotas.report(quota, drawn)
    assert {(r.target_set, r.category) for r in quotas.unmet(reported).collect()} == {("s", "c"), ("vazio", "a")}
    assert {(r.category, r.drawn, r.shortfall) for r in reported.filter("target_set = 's'").collect()} == {("A", 199, 0), ("b", 100, 0), ("c", 1, 29)}
    counts = {(r.target_set, r.category): r["count"] for r in drawn.groupBy("target_set", "category").count().collect()}
    assert counts == {("s", "A"): 199, ("s", "b"): 100, ("s", "c"): 1}
    assert drawn.select("id").distinct().count() == 300
    assert sorted(drawn.collect()) == sorted(quotas.draw(rows.repartition(7), quota).collect())


def test_quotas_of_nothing(spark):
    rows = spark.createDataFrame([], "id long, year int, name string")
    assert quotas.draw(rows, quotas.quotas(rows, _targets(spark, []))).count() == 0


def test_flight_keeps_totals():
    rng = np.random.default_rng(4)
    tokens = rng.integers(1, 900, 500)
    p = mixing.fly(tokens, np.full(500, 0.3), rng)
    assert ((p > 0) & (p < 1)).sum() <= 2
    assert math.isclose(p.sum(), 150, abs_tol=1e-6) and math.isclose((p * tokens).sum(), 0.3 * tokens.sum(), rel_tol=1e-9)
    landed = mixing.land(tokens, p, rng)
    assert set(np.unique(landed)) <= {0.0, 1.0} and abs(landed.sum() - 150) <= 1


def test_flight_draws_by_probability():
    tokens, hits = np.array([5, 9, 9, 30, 2, 2]), np.zeros(6)
    for seed in range(4000):
        rng = np.random.default_rng(seed)
        hits += mixing.land(tokens, mixing.fly(tokens, np.full(6, 0.4), rng), rng)
    assert np.allclose(hits / 4000, 0.4, atol=0.04)


def test_mix(spark):
    rng = np.random.default_rng(1)
    sizes = [(k, "grande", int(rng.integers(1, 400))) for k in range(9000)] + [(20_000 + k, "pequena", 50) for k in range(20)]
    sizes += [(30_000, None, 10), (30_001, "fora", 10), (30_002, "pequena", 0)]
    df = spark.createDataFrame([(*s, "x") for s in sizes], "id long, source string, tokens long, chance string")
    targets = spark.createDataFrame([("grande", 40, 3), ("pequena", 40, 3), ("ausente", 20, 9), (None, 1, 1)], "source string, target_pct int, max_repeats int")
    mix = mixing.mix_sources(df, targets)
    shares = {r.source: r for r in mix.shares.collect()}
    total = sum(s[2] for s in sizes if s[1] in ("grande", "pequena"))
    assert {s: r.short for s, r in shares.items()} == {"grande": False, "pequena": True, "ausente": True}
    assert shares["pequena"].given == 3000 and shares["ausente"].given == 0
    assert abs(shares["grande"].given - (total - 3000)) < 1000  # what the two cannot give is made up for
    assert {r.source for r in mixing.short_sources(mix).collect()} == {"pequena", "ausente"}
    copies = {r.id: r.copies for r in mix.copies.collect()}
    assert set(copies) <= {s[0] for s in sizes if s[2] and s[1] in ("grande", "pequena")} and max(copies.values()) == 3


def test_planned_tokens(spark):
    """Gaps go to the others in proportion, also where that exhausts one of them; an exact mix is smaller."""
    sizes = spark.createDataFrame([(1, "a", 100), (2, "b", 300), (3, "c", 600)], "id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 50, 2), ("b", 30, 1), ("c", 20, 1)], "source string, target_pct int, max_repeats int")
    shares = {r.source: r for r in mixing.planned_tokens(mixing.source_shares(sizes, targets)).collect()}
    assert {s: r.planned for s, r in shares.items()} == {"a": 200, "b": 300, "c": 500}
    assert shares["a"].exact_tokens == 400 and [r.source for r in shares.values() if r.short] == ["a"]
    exact = {r.source: r.planned for r in mixing.planned_tokens(mixing.source_shares(sizes, targets), True).collect()}
    assert exact == {"a": 200, "b": 120, "c": 80}
    mix = mixing.mix_sources(sizes, targets)
    assert {r.source: r.given for r in mix.shares.collect()} == {"a": 200, "b": 300, "c": 600} or mix.copies.count() == 2
    assert [r.source for r in mixing.short_sources(mix).collect()] == ["a"]
    enough = spark.createDataFrame([("a", 10, 2), ("b", 30, 1), ("c", 60, 1), ("d", 0, 1)], "source string, target_pct int, max_repeats int")
    mix = mixing.mix_sources(sizes, enough)
    assert {r.source: r.planned for r in mix.shares.collect()} == {"a": 100, "b": 300, "c": 600, "d": 0}
    assert mixing.short_sources(mix).count() == 0


def test_shares_equal_targets_where_no_source_is_short(spark):
    rng = np.random.default_rng(2)
    rows = [(k, "xyz"[k % 3], int(rng.integers(20, 300))) for k in range(6000)]
    targets = spark.createDataFrame([("x", 50, 2), ("y", 30, 2), ("z", 20, 2)], "source string, target_pct int, max_repeats int")
    for exact in (False, True):
        mix = mixing.mix_sources(spark.createDataFrame(rows, "id long, source string, tokens long"), targets, exact=exact)
        assert all(abs(r.actual_pct - r.target_pct) < 0.1 for r in mix.shares.collect())


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 50, 2)], "source string, target_pct int, max_repeats int")
    mix = mixing.mix_sources(df, targets)
    assert mix.copies.count() == 0 and mix.shares.first().short is False
