import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vazante.llm import chosen_path as C
from vazante.llm import overlap as O
from vazante.llm import sketch

SHAPE = "id long, text string, c1 string, node string"


def corpus(seed=1, groups=25, size=30):
    """Texts with edited, reordered and repeated versions, and the odd cases."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for _ in range(groups):
        base = rng.choices(words, k=rng.randint(25, 90))
        for _ in range(rng.randint(1, 4)):
            copy = base[:]
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(copy))
                kind = rng.random()
                if kind < 0.4:
                    copy[at] = rng.choice(words)
                elif kind < 0.7:
                    copy.insert(at, rng.choice(words))
                else:
                    copy = copy[at:] + copy[:at]
            rows.append(" ".join(copy))
    rows += [rows[0].upper(), rows[0].replace(" ", "\n, "), rows[1], None, "", "   ", "curto demais", "longo " * 30_000, "Longo, " * 30_000]
    return list(enumerate(rows, 10))


def brute(rows, settings):
    sets = {i: sketch.shingle_set(t, settings.width) for i, t in rows if t and len(sketch.words_of(t)) >= settings.min_words}
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sketch.jaccard(sets[a], sets[b]) >= settings.threshold}


@pytest.mark.parametrize("settings", [C.JoinSettings(), C.JoinSettings(small=2, more_levels=1), C.JoinSettings(width=5, threshold=0.8, small=4)])
def test_pairs_equal_brute_force(spark, settings):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SHAPE)
    got = [tuple(r) for r in C.duplicate_pairs(C.near_duplicates(docs, settings)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, settings)


def test_groups_are_components_of_all_rows(spark):
    rows = corpus(2)
    docs = spark.createDataFrame(rows, "id long, text string")
    settings = C.JoinSettings()
    got = {r.id: r for r in C.duplicate_groups(docs, C.near_duplicates(docs, settings)).collect()}
    label = {i: i for i, _ in rows}
    changed = True
    pairs = brute(rows, settings)
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    assert {i: r.group_id for i, r in got.items()} == label


def test_one_class_may_hold_most_rows(spark):
    hot = " ".join(f"h{k}" for k in range(40))
    rows = [(k, hot) for k in range(300)] + [(1000, hot + " mais"), (1001, "outro " + hot)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(8)
    found = C.near_duplicates(docs)
    assert found.classes.count() == 3
    assert found.classes.agg(F.max("rows")).first()[0] == 300
    assert C.duplicate_pairs(found).count() == 300 * 299 // 2 + 600 + 1


def test_dense_nodes_lose_no_pair(spark):
    base = [f"d{k}" for k in range(60)]
    rows = [(k, " ".join(base[:30] + [f"novo{k}"] + base[30:])) for k in range(40)]
    docs = spark.createDataFrame(rows, "id long, text string")
    settings = C.JoinSettings(small=3, more_levels=1)
    assert C.duplicate_pairs(C.near_duplicates(docs, settings)).count() == 40 * 39 // 2


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "id long, text string")
    assert C.duplicate_pairs(C.near_duplicates(docs)).count() == 0
    assert C.duplicate_groups(docs, C.near_duplicates(docs)).count() == 0
    assert O.overlap_pairs(O.overlaps(docs, docs)).count() == 0


def test_runs_reach_the_target():
    s = C.JoinSettings()
    assert s.runs(3) > s.runs(2) >= 4
    assert s.depth(10) == 1 and s.depth(10**9) > s.depth(10**6)


@pytest.mark.parametrize("depth", [1, 2, 3, 4, 5])
def test_runs_reach_the_recall_of_shared_coordinates(depth):
    """Simulated signatures of pairs exactly at the threshold, all runs drawn from the same coordinates."""
    s, rng = C.JoinSettings(), np.random.default_rng(depth)
    for runs, level in ((s.least_runs(depth), 0), (s.runs(depth), s.more_levels)):
        agree = rng.random((100_000, sketch.COORDS)) < s.threshold
        k = agree.sum(1)
        met = np.ones(len(k))
        for place in range(depth):
            met *= (k - place) / (sketch.COORDS - place)
        lost = np.zeros(len(k))
        for _ in range(level):
            lost = (1 - k / sketch.COORDS + k / sketch.COORDS * lost) ** s.children
        assert ((1 - met * (1 - lost)) ** runs).mean() < 0.0012


def family(stem, number, first):
    """Texts that differ from each other in one word, at a place of their own."""
    base = [f"{stem}{k}" for k in range(60)]
    return [(first + k, " ".join([*base[:30], f"novo{first + k}", *base[30:]])) for k in range(number)]


def test_a_family_on_both_sides_is_compared_in_blocks(spark, monkeypatch):
    """Every pair across the sides is found, and no task holds a whole node."""
    train = family("f", 700, 0) + family("g", 300, 10_000)
    other = family("f", 90, 50_000) + family("h", 300, 60_000)
    largest = []
    real = C.buckets.compare_blocks

    def watched(large, most, block=64):
        entries = C.buckets.in_blocks(large, block)
        largest.append(entries.groupBy("node").count().agg(F.max("count")).first()[0])
        return real(large, most, block)

    monkeypatch.setattr(C.buckets, "compare_blocks", watched)
    settings = C.JoinSettings(small=64, more_levels=1)
    frames = [spark.createDataFrame(r, "id long, text string") for r in (train, other)]
    got = O.overlap_pairs(O.overlaps(*frames, settings)).select("train_id", "evaluation_id")
    assert got.count() == got.distinct().count() == 700 * 90
    assert largest and max(largest) < 2 * 64 * 2
    both = spark.createDataFrame(train[:200], "id long, text string")
    assert C.duplicate_pairs(C.near_duplicates(both, settings)).count() == 200 * 199 // 2


def test_large_classes_are_expanded_in_parts(spark, monkeypatch):
    monkeypatch.setattr(C, "EXPANDED", 7)
    hot = " ".join(f"h{k}" for k in range(40))
    docs = spark.createDataFrame([(k, hot) for k in range(50)], "id long, text string")
    got = C.duplicate_pairs(C.near_duplicates(docs))
    assert got.count() == got.distinct().count() == 50 * 49 // 2


def test_overlaps_equal_brute_force(spark):
    rows = corpus(3)
    train, other = rows[::2], rows[1::2]
    frames = [spark.createDataFrame(r, "id long, text string") for r in (train, other)]
    got = {(r.train_id, r.evaluation_id) for r in O.overlap_pairs(O.overlaps(*frames)).collect()}
    left = {i for i, _ in train}
    want = {(a, b) if a in left else (b, a) for a, b in brute(rows, C.JoinSettings()) if (a in left) != (b in left)}
    assert got == want


def test_split_names(spark):
    days = spark.sql("select * from values (date'2015-01-01'), (date'2016-10-05'), (null) t(day)")
    periods = spark.sql("select 'train' split, date'2015-01-01' date_from, date'2016-10-01' date_to union all select null, null, null")
    assert [r[0] for r in days.select(O.split_names(F.col("day"), periods)).collect()] == [["train"], [], []]
