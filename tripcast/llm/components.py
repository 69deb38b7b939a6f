"""Connected components by alternating stars (Kiveris et al., 2014).

Every step is a minimum per key, which is reduced in each task before the
shuffle, and a join with those minima. Both are stored, so a join starts from
plain exchanges and adaptive execution can split the partition of a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripcast.durable import forget, stored

MAX_ROUNDS = 100   # far above the logarithmic need; reaching it is an error


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` for every node with a link to another; ``root`` is the
    smallest node it can reach. Null ends and loops are ignored."""
    ends = [F.col(a).cast("long"), F.col(b).cast("long")]
    edges = stored(
        links.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(*ends).alias("u"), F.least(*ends).alias("v"))
        .filter(F.col("u") != F.col("v")).distinct(), "edges")
    before = _state(edges)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = stored(
            both.filter(F.col("v") > F.col("u")).join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").filter(F.col("v") != F.col("m")).select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        after = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        forget(edges, low, large, least)
        edges, now = after, _state(after)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return stored(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots), "components")
