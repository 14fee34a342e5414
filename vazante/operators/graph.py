"""Connected components of a pair table, without moving the graph to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def connected_components(pairs: DataFrame, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """``id, component`` of every id in ``pairs``; the component is its smallest id.

    Alternates large-star and small-star rewiring: each round sends a vertex's larger
    (then smaller) neighbours to its least neighbour, so the number of rounds grows with
    the logarithm of the longest path. A vertex's neighbours are never collected: each
    round is an aggregation and a join. Loops and null ends are ignored; an empty table
    gives no rows; repeated pairs count once.
    """
    edges = cut(
        pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("v"), F.least(a, b).alias("w"))
        .distinct(),
        "edges",
    )
    before = None
    while True:
        both = edges.union(edges.select(F.col("w").alias("v"), F.col("v").alias("w")))
        least = both.groupBy("v").agg(F.least(F.min("w"), F.first("v")).alias("m"))
        large = (
            both.join(least, "v")
            .filter("w > v")
            .select(F.col("w").alias("v"), F.col("m").alias("w"))
            .distinct()
        )
        low = large.groupBy("v").agg(F.min("w").alias("m"))
        small = large.join(low, "v").select(
            F.explode(F.array(F.struct("v", F.col("m").alias("w")), F.struct(F.col("w").alias("v"), F.col("m").alias("w")))).alias("e")
        )
        after = cut(small.select("e.v", "e.w").filter("v != w").distinct(), "edges")
        # equal edge tables have equal numbers and checksums; one pass over the table just written
        now = tuple(after.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "w")), F.sum(F.xxhash64("w", "v").cast("decimal(38,0)"))).first())
        edges = after
        if now == before:
            break
        before = now
    return edges.select(F.col("v").alias("id"), F.col("w").alias("component")).union(
        edges.select(F.col("w").alias("id"), F.col("w").alias("component")).distinct()
    )
