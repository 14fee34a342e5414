"""Combine sources so that each contributes a target share of the total size, by cube sampling.

Sizes are token counts. A source should give its percentage of the tokens of all listed sources. What
sources that are too small cannot give, even repeated as often as allowed, is shared out among the
others in proportion to their targets, so the mix keeps its size and its shares differ from the targets
only because a source is short; with ``exact`` the mix is made smaller instead, to the largest size at
which every target share is met. A source's rate is its planned tokens over its tokens; every document
enters as often as the rate's whole part, and once more with the fractional part as inclusion probability. Which documents get the extra copy is decided by the cube method: in
its flight phase the probabilities of three undecided documents at a time move along the null space
of the balancing constraints (number of documents and number of tokens) until one of them is 0 or 1.
Blocks of bounded size fly in parallel, the at most two undecided documents of each block fly again
together, round by round, and only a handful a source reaches the landing.

Null sources and sources not listed take no part; null and empty texts have no tokens and are never
used. A listed source without documents contributes nothing. If a source is listed twice its rows
are judged apart. Targets without percentage or repeats count as 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut

BLOCK = 4_000
FLOWN = "source string, id long, tokens long, chance double"
_EPS = 1e-9


@dataclass(frozen=True)
class Mix:
    """shares: a row a listed source; copies: id, source, tokens, copies (at least 1)."""

    shares: DataFrame
    copies: DataFrame


def source_shares(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """What each listed source has, can give (``capacity``) and should give (``wanted``), in tokens.

    ``sizes(id, source, tokens)`` holds the documents of all sources. ``short`` marks the sources
    whose capacity stays below their percentage of the tokens of all listed sources.
    """
    listed = targets.filter("source is not null").select(
        "source",
        F.coalesce(F.col("target_pct").cast("long"), F.lit(0)).alias("target_pct"),
        F.coalesce(F.col("max_repeats").cast("long"), F.lit(0)).alias("max_repeats"),
    )
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count_if(F.col("tokens") > 0).alias("documents"))
    known = listed.join(have, "source", "left").fillna(0, ["tokens", "documents"])
    total = known.dropDuplicates(["source"]).agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    return known.join(F.broadcast(total)).select(
        "source", "target_pct", "max_repeats", "documents", "tokens", "total",
        (F.col("tokens") * F.col("max_repeats")).alias("capacity"),
        (F.col("total") * F.col("target_pct") / 100).alias("wanted"),
        (F.col("tokens") * F.col("max_repeats") * 100 < F.col("total") * F.col("target_pct")).alias("short"),
    )


def planned_tokens(shares: DataFrame, exact: bool = False) -> DataFrame:
    """``shares`` with ``planned``, the tokens a source is to give, and ``exact_tokens``, the size of the largest mix that
    meets every target share.

    Sources are taken in order of capacity over target: each that cannot give its part of what is left gives all it
    has; the rest is shared out among those after it. Windows run over one row a listed source.
    """
    pct, capacity = F.col("target_pct"), F.col("capacity").cast("double")
    ratio = F.when(pct > 0, capacity / pct)
    order = W.partitionBy().orderBy(ratio.asc_nulls_last(), "source", "max_repeats")
    earlier, later = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    level = (F.sum("wanted").over(everything) - F.coalesce(F.sum(F.when(pct > 0, capacity)).over(earlier), F.lit(0.0))) / F.nullif(F.sum(pct).over(later), F.lit(0))
    known = shares.select(
        *shares.columns, ratio.alias("__ratio"), level.alias("__level"),
        F.least(F.min(ratio).over(everything) * 100, F.sum("wanted").over(everything)).alias("exact_tokens"),
    )
    last = F.max(F.when(F.col("__ratio") >= F.col("__level"), F.col("__level"))).over(everything)  # of the first that need not give all
    share = F.least(capacity, pct * F.coalesce(last, F.col("__ratio"))) if not exact else F.col("exact_tokens") * pct / 100
    return known.withColumn("planned", F.coalesce(F.when(pct > 0, share), F.lit(0.0))).drop("__ratio", "__level")


def fly(tokens: np.ndarray, chance: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight: decide all but two probabilities at most, keeping their sum and their sum by tokens."""
    p, t = chance.tolist(), tokens.tolist()
    active: list[int] = []
    draws = iter(rng.random(2 * len(p) + 8).tolist())
    for k in [k for k in range(len(p)) if _EPS < p[k] < 1 - _EPS]:
        active.append(k)
        while len(active) == 3:
            a, b, c = active
            u = (t[c] - t[b], t[a] - t[c], t[b] - t[a])
            if u == (0, 0, 0):
                u = (1, -1, 0)
            up = min((1 - p[k]) / x if x > 0 else p[k] / -x for k, x in zip(active, u) if x)
            down = min(p[k] / x if x > 0 else (1 - p[k]) / -x for k, x in zip(active, u) if x)
            step = up if next(draws) * (up + down) < down else -down
            for k, x in zip(active, u):
                p[k] += step * x
            still = [k for k in active if _EPS < p[k] < 1 - _EPS]
            if len(still) == 3:  # rounding kept the moved one off its bound
                near = min(active, key=lambda k: min(p[k], 1 - p[k]))
                still.remove(near)
                p[near] = round(p[near])
            active = still
    return np.array([x if _EPS < x < 1 - _EPS else float(round(x)) for x in p])


def land(tokens: np.ndarray, chance: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Landing of at most two: give up the token total first, keep the number of documents while two
    are undecided, and draw the last one by its probability."""
    p = chance.copy()
    open_ = [k for k in range(len(p)) if _EPS < p[k] < 1 - _EPS]
    while len(open_) >= 2:
        a, b = open_[:2]
        up, down = min(1 - p[a], p[b]), min(p[a], 1 - p[b])
        step = up if rng.random() * (up + down) < down else -down
        p[a] += step
        p[b] -= step
        open_ = [k for k in range(len(p)) if _EPS < p[k] < 1 - _EPS]
    for k in open_:
        p[k] = float(rng.random() < p[k])
    return np.round(p)


def _fly_blocks(units: DataFrame, blocks: DataFrame, seed: int, last: bool) -> DataFrame:
    """One round: every block of undecided units flies (and lands, in the ``last`` round)."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        rng = np.random.default_rng([seed, int(key[1]), len(pdf), int(pdf["id"].iloc[0]) & 0xFFFFFFFF])
        order = rng.permutation(len(pdf))
        pdf = pdf.iloc[order]
        chance = fly(pdf["tokens"].to_numpy(), pdf["chance"].to_numpy(), rng)
        if last:
            chance = land(pdf["tokens"].to_numpy(), chance, rng)
        return pdf.assign(chance=chance)[["source", "id", "tokens", "chance"]]

    block = F.pmod(F.xxhash64("id", F.lit(seed)), F.col("blocks"))
    return units.join(F.broadcast(blocks), "source").withColumn("block", block).groupBy("source", "block").applyInPandas(run, FLOWN)


def balanced_draw(units: DataFrame, seed: int = 7) -> DataFrame:
    """``id`` of the drawn units of ``units(source, id, tokens, chance)``, balanced within each source."""
    drawn = []
    round_ = 0
    while True:
        blocks = cut(
            units.groupBy("source").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "blocks"
        )
        last = not blocks.agg(F.max("blocks") > 1).first()[0]
        flown = cut(_fly_blocks(units, blocks, seed + round_, last), "flown")
        drawn.append(flown.filter("chance = 1").select("id"))
        if last:
            break
        units = flown.filter("chance > 0 and chance < 1")
        round_ += 1
    out = drawn[0]
    for more in drawn[1:]:
        out = out.union(more)
    return out


def short_sources(mix: Mix) -> DataFrame:
    """``source`` of the targets that the mix could not meet: all that the source has, repeated as often as allowed, went
    in and is less than its share of the tokens of all listed sources."""
    return mix.shares.filter("given = capacity and given * 100 < total * target_pct").select("source")


def mix_sources(sizes: DataFrame, targets: DataFrame, seed: int = 7, exact: bool = False) -> Mix:
    """Copies of the documents ``sizes(id, source, tokens)`` that make up the target mix, and its shares.

    A source that gives all it has gives each document exactly as often as allowed.
    """
    sizes = cut(sizes.select("id", "source", "tokens"), "sizes")
    shares = cut(planned_tokens(source_shares(sizes, targets), exact), "shares")
    full = F.col("planned") >= F.col("capacity")
    rate = F.when(F.col("tokens") > 0, F.when(full, F.col("max_repeats").cast("double")).otherwise(F.col("planned") / F.col("tokens"))).otherwise(0.0)
    rates = shares.groupBy("source").agg(F.max(rate).alias("rate"))
    units = (
        sizes.filter("tokens > 0")
        .join(F.broadcast(rates), "source")
        .select("source", "id", "tokens", F.floor("rate").cast("long").alias("whole"), (F.col("rate") - F.floor("rate")).alias("chance"))
    )
    extra = balanced_draw(units.filter("chance > 0").select("source", "id", "tokens", "chance"), seed).withColumn("extra", F.lit(1).cast("long"))
    copies = cut(
        units.join(extra, "id", "left")
        .select("id", "source", "tokens", (F.col("whole") + F.coalesce("extra", F.lit(0))).alias("copies"))
        .filter("copies > 0"),
        "copies",
    )
    given = copies.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("given"), F.sum("copies").alias("given_documents"))
    known = shares.join(given, "source", "left").fillna(0, ["given", "given_documents"])
    whole = F.broadcast(given.agg(F.sum("given").alias("mix")))
    report = known.join(whole).select(
        *shares.columns, "given", "given_documents", F.round(100 * F.try_divide(F.col("given"), F.col("mix")), 6).alias("actual_pct")
    )
    return Mix(report, copies)
