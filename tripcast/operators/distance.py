"""Compactness of clusters: the mean distance over all pairs of members."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripcast.durable import forget, stored
from tripcast.functions import hashing
from tripcast.joins import small, spread
from tripcast.operators.ranking import group_positions

BLOCK = 20_000   # distinct points per block: every point travels once for each block of its cluster
SPLIT = 16       # blocks of a cluster whose blocks are smaller than that
STRIP, STRIP_WIDE = 64, 2048    # rows and columns of a tile held at a time
CLOSE = 1e-3     # squared distances below this share of both lengths are worked out from differences
DRAWS = 100_000  # pairs drawn per cluster; a cluster with fewer pairs is measured whole
NORMAL_95 = 1.959964   # a standard normal lies within this with a probability of 0.95


def _tile_sum(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Weighted sum of the distances of all rows of ``a`` to all of ``b``. Squares come from
    one product of matrices; of close rows, where that cancels, from their differences."""
    origin = a.mean(axis=0)
    ca, cb = a - origin, b - origin
    na, nb = np.einsum("ij,ij->i", ca, ca), np.einsum("ij,ij->i", cb, cb)
    total = 0.0
    for at in range(0, len(a), STRIP):
        to = min(at + STRIP, len(a))
        for start in range(0, len(b), STRIP_WIDE):
            end = min(start + STRIP_WIDE, len(b))
            lengths = na[at:to, None] + nb[None, start:end]
            square = lengths - 2 * (ca[at:to] @ cb[start:end].T)
            i, j = np.nonzero(square < CLOSE * lengths)
            for some in range(0, len(i), STRIP_WIDE):
                ii, jj = i[some:some + STRIP_WIDE], j[some:some + STRIP_WIDE]
                gap = a[at + ii] - b[start + jj]
                square[ii, jj] = np.einsum("ij,ij->i", gap, gap)
            np.maximum(square, 0, out=square)
            total += float(wa[at:to] @ np.sqrt(square) @ wb[start:end])
    return total


def _tiles(folded: DataFrame, sizes: DataFrame, cluster: str, features: Sequence[str], clusters: int | None) -> DataFrame:
    """The folded points, once for each block of their cluster."""
    placed = folded.join(small(sizes.select(cluster, "blocks"), clusters), cluster).withColumn(
        "block", F.pmod(F.xxhash64(*features), F.col("blocks")).cast("int"))
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return paired.select(
        cluster, F.array(*[F.col(f).cast("double") for f in features]).alias("x"), "w", "block",
        F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))


def pair_sums(
    points: DataFrame, cluster: str, features: Sequence[str], block: int = BLOCK,
    clusters: int | None = None, weight: str | None = None,
) -> DataFrame:
    """``cluster, n, total``: members, and the sum of all their distances.

    Equal points are first folded into one with a weight: trips sit on zone
    centroids and whole hours, so a cluster has far fewer places than trips.
    A cluster's distinct points are hashed into blocks of bounded size and every
    pair of blocks becomes one group, so the work of a hot cluster is spread
    over as many tasks as it has block pairs. A task emits one sum. Clusters of more
    points than ``block`` are cut, but into more than ``SPLIT`` blocks only where these
    hold ``BLOCK`` points: a point travels ``SPLIT`` times however small ``block`` is.
    ``clusters`` is the number of clusters, if known; ``weight`` counts members when the
    points come folded. The folded points are stored when this is called, as
    their number is needed before they are placed.
    """
    features = list(features)
    folded = stored(points.groupBy(cluster, *features).agg(
        F.sum(F.lit(1) if weight is None else F.col(weight)).cast("double").alias("w")), "folded")
    held = F.count(F.lit(1))
    sizes = folded.groupBy(cluster).agg(
        F.least(F.ceil(held / block), F.greatest(F.lit(SPLIT), F.ceil(held / BLOCK))).cast("int").alias("blocks"),
        F.sum("w").alias("n"))
    tiles = spread(_tiles(folded, sizes, cluster, features, clusters), cluster, "lo", "hi")

    def tile(rows: pa.Table) -> pa.Table:
        lo, hi = rows.column("lo")[0].as_py(), rows.column("hi")[0].as_py()
        x = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(features))
        w, side = rows.column("w").to_numpy(), rows.column("block").to_numpy()
        a = side == lo
        if lo == hi:
            total = _tile_sum(x, w, x, w) / 2
        else:
            total = _tile_sum(x[a], w[a], x[~a], w[~a]) if a.any() and not a.all() else 0.0
        return pa.table([rows.column(cluster).slice(0, 1), pa.array([total])], names=[cluster, "total"])

    kind = points.schema[cluster].dataType.simpleString()
    sums = tiles.groupBy(cluster, "lo", "hi").applyInArrow(tile, f"`{cluster}` {kind}, total double")
    totals = sums.groupBy(cluster).agg(F.sum("total").alias("total"))
    return totals.join(sizes.select(cluster, "n"), cluster)


def mean_pair_distance(
    points: DataFrame, cluster: str, features: Sequence[str],
    alone: float | None = 0.0, clusters: Iterable[int] | None = None, block: int = BLOCK,
    weight: str | None = None,
) -> DataFrame:
    """``cluster, mean_distance``. A cluster with one member gets ``alone``.
    With ``clusters`` every listed one is reported, empty ones as ``alone``."""
    clusters = None if clusters is None else list(clusters)
    sums = pair_sums(points, cluster, features, block, None if clusters is None else len(clusters), weight)
    pairs = F.col("n") * (F.col("n") - 1) / 2
    lone = F.lit(alone).cast("double")
    mean = F.when(F.col("n") > 1, F.col("total") / pairs).otherwise(lone)
    out = sums.select(cluster, mean.alias("mean_distance"))
    if clusters is None:
        return out
    listed = points.sparkSession.createDataFrame([(int(c),) for c in clusters], f"`{cluster}` int")
    return listed.join(out, cluster, "left").fillna({} if alone is None else {"mean_distance": alone})


def _drawn(placed: DataFrame, plan: DataFrame, cluster: str, features: Sequence[str], seed: int | str) -> DataFrame:
    """``cluster, n, draws, mean_distance, half``: means of drawn pairs and half the width
    of their interval, for the clusters of ``plan`` (``cluster, n, strata, per``).

    Members stand in the order of their features. The first member of a pair is drawn from
    a stratum of neighbours, the second from all others; ``per`` pairs a stratum, by hash.
    Members are looked up by equality on the cell, as wide as a stratum, that holds them.
    """
    lo = F.expr("stratum * n div strata")
    hi = F.expr("(stratum + 1) * n div strata")
    strata = plan.withColumn("stratum", F.explode(F.sequence(F.lit(0).cast("long"), F.col("strata") - 1)))
    tickets = spread(strata, cluster, "stratum").withColumn("draw", F.explode(F.sequence(F.lit(1).cast("long"), F.col("per"))))
    u = [hashing.uniform(f"{seed}/{side}", F.col(cluster), F.col("stratum"), F.col("draw")) for side in ("first", "second")]
    ranks = tickets.withColumn("first", lo + F.floor(u[0] * (hi - lo))).withColumn(
        "second", F.floor(u[1] * (F.col("n") - 1))).withColumn(
        "second", F.col("second") + F.when(F.col("second") >= F.col("first"), 1).otherwise(0))
    ends = ranks.select(cluster, "n", "strata", "per", "stratum", "draw", (hi - lo).alias("width"), F.posexplode(
        F.array("first", "second")).alias("side", "rank")).withColumn("cell", F.expr("rank * strata div n"))
    known = placed.join(small(plan.select(cluster, "strata"), None), cluster)
    cells = known.withColumn("cell", F.explode(F.sequence(
        F.expr("position * strata div n"), F.expr("(position + w - 1) * strata div n"))))
    member = F.struct(*[F.col(f).cast("double").alias(f) for f in features])
    found = ends.join(cells.select(cluster, "cell", "position", "w", member.alias("member")), [cluster, "cell"]).filter(
        "rank >= position AND rank < position + w")
    pairs = found.groupBy(cluster, "n", "per", "stratum", "draw", "width").agg(
        *[F.max(F.when(F.col("side") == k, F.col("member"))).alias(f"m{k}") for k in (0, 1)])
    gap = sum((F.col(f"m0.{f}") - F.col(f"m1.{f}")) * (F.col(f"m0.{f}") - F.col(f"m1.{f}")) for f in features)
    share = F.col("width") / F.col("n")
    by_stratum = pairs.withColumn("d", F.sqrt(gap)).groupBy(cluster, "n", "per", "stratum", "width").agg(
        F.avg("d").alias("mean"), F.var_samp("d").alias("spread"))
    return by_stratum.groupBy(cluster, "n").agg(
        F.sum("per").alias("draws"), F.sum(share * F.col("mean")).alias("mean_distance"),
        (NORMAL_95 * F.sqrt(F.sum(share * share * F.col("spread") / F.col("per")))).alias("half"))


def sampled_pair_distance(
    points: DataFrame, cluster: str, features: Sequence[str], draws: int = DRAWS, error: float | None = None,
    seed: int = 42, alone: float | None = 0.0, clusters: Iterable[int] | None = None, weight: str | None = None,
) -> DataFrame:
    """``cluster, n, mean_distance, low, high, draws``: the mean distance of the pairs of a
    cluster from about ``draws`` of them, and an interval that holds it in 95 of 100 cases.

    The work grows with the distinct points and the draws, never with their pairs. A cluster
    whose distinct points have at most ``draws`` pairs is measured whole: no draws, and the
    interval is the mean. With ``error``, clusters whose interval is wider than that share of
    the mean on either side are drawn again, as often as the spread of the first draws asks
    for. Draws depend on the seed, the cluster and their number only. A cluster with one
    member gets ``alone``, and with ``clusters`` every listed one is reported.
    """
    features = list(features)
    folded = stored(points.groupBy(cluster, *features).agg(
        F.sum(F.lit(1) if weight is None else F.col(weight)).cast("long").alias("w")), "folded")
    placed = stored(group_positions(folded, [cluster], features, "w", total="n"), "placed")
    sizes = stored(placed.groupBy(cluster, "n").agg(F.count(F.lit(1)).alias("p")), "sizes")
    whole = F.col("p") * (F.col("p") - 1) / 2 <= draws
    per_stratum = lambda many: F.greatest(F.lit(2), F.ceil(many / F.col("strata"))).cast("long")
    plan = sizes.filter(~whole).select(
        cluster, "n", F.least(F.ceil(F.lit(draws) / 2), F.col("n")).cast("long").alias("strata")).withColumn(
        "per", per_stratum(F.lit(draws)))
    sampled = stored(_drawn(placed, plan, cluster, features, seed), "sampled")
    if error is not None:
        wide = F.col("half") > error * F.col("mean_distance")
        asked = F.least(F.lit(float(1 << 40)), F.col("draws") * F.pow(F.col("half") / (error * F.col("mean_distance")), 2) * 1.2)
        again = stored(sampled.filter(wide).select(cluster, "n", asked.alias("asked")).select(
            cluster, "n", F.least(F.ceil(F.col("asked") / 2), F.col("n")).cast("long").alias("strata"), "asked").withColumn(
            "per", per_stratum(F.col("asked"))).drop("asked"), "again")
        more = stored(_drawn(placed, again, cluster, features, f"{seed}/again"), "sampled")
        first, sampled = sampled, stored(sampled.join(small(again.select(cluster), None), cluster, "left_anti").unionByName(more), "sampled")
        forget(first, again, more)
    lone = F.lit(alone).cast("double")
    few = placed.join(small(sizes.filter(whole & (F.col("n") > 1)).select(cluster), None), cluster, "left_semi")
    exact = pair_sums(few, cluster, features, weight="w").select(
        cluster, F.col("n").cast("long").alias("n"), F.lit(0).cast("long").alias("draws"),
        (F.col("total") / (F.col("n") * (F.col("n") - 1) / 2)).alias("mean_distance"), F.lit(0.0).alias("half"))
    single = sizes.filter("n = 1").select(
        cluster, "n", F.lit(0).cast("long").alias("draws"), lone.alias("mean_distance"), F.lit(0.0).alias("half"))
    out = sampled.unionByName(exact).unionByName(single).select(
        cluster, "n", "mean_distance", (F.col("mean_distance") - F.col("half")).alias("low"),
        (F.col("mean_distance") + F.col("half")).alias("high"), "draws")
    if clusters is None:
        return out
    listed = points.sparkSession.createDataFrame([(int(c),) for c in clusters], f"`{cluster}` int")
    empty = {"n": 0, "draws": 0} | ({} if alone is None else {c: alone for c in ("mean_distance", "low", "high")})
    return listed.join(out, cluster, "left").fillna(empty)


def with_distance(
    trips: DataFrame, distances: DataFrame, cluster: str = "cluster", clusters: int | None = None
) -> DataFrame:
    """Add each trip's cluster distance; ``clusters`` is their number, if known."""
    return trips.join(small(distances, clusters), cluster, "left")


def busiest_clusters(trips: DataFrame, count: int = 10, cluster: str = "cluster") -> DataFrame:
    return (
        trips.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), cluster).limit(count))


def tightest_clusters(distances: DataFrame, count: int = 10, cluster: str = "cluster") -> DataFrame:
    return distances.orderBy(F.asc_nulls_last("mean_distance"), cluster).limit(count)


def of_clusters(
    trips: DataFrame, chosen: DataFrame, cluster: str = "cluster", count: int | None = 10
) -> DataFrame:
    """Trips of the chosen clusters, of which there are at most ``count``."""
    return trips.join(small(chosen.select(cluster), count), cluster, "left_semi")
