"""Exact top-k by inner product: norm-bucketed retrieval (Teflioudi et al., 2015).

Vectors are grouped by length into buckets of nearly equal norm, and large
buckets into parts. A first pass multiplies the queries with the longest parts
only; the k-th score found there bounds each query's result from below. In every
other part that bound gives the query a local cosine threshold, the bound by
the query's length and the part's greatest one. Above 1 the part is skipped. Otherwise
the threshold chooses how the part is pruned: a high one by coordinates (on the
query's largest coordinates a vector must lie in the range the threshold
leaves), a low one by length (vectors long enough to reach the bound at all).
What is left is verified by exact integer products. Queries pruned by length
keep a run of the longest vectors each and are verified together. A block of
queries goes only to vectors long enough for one of them, so what no bound
allows is not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripcast.durable import stored
from tripcast.llm.vectors import usable

K = 10
SCALE = 1024
PART = 4096            # vectors of a part
QUERIES = 4096         # queries of a block
STRIP = 256            # queries multiplied at a time
STEPS = 8              # norm buckets per doubling of the length
SEED_PARTS = 2         # longest parts that give the first bounds
FOCUS = 4              # coordinates tested when pruning by coordinates
BY_COORDINATE = 0.5    # local cosine threshold from which coordinates prune better than length
SLACK = 1e-9           # room for rounding in the bounds; verification is exact


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact: in doubles where they are small
    enough, else in integers of any size, held within a long."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a.astype(np.float64)).max()) * float(np.abs(b.astype(np.float64)).max()) * a.shape[1]
    if most < 2.0 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2.0 ** 62:
        return a @ b.T
    big = a.astype(object) @ b.astype(object).T
    return np.clip(big, -(2 ** 63), 2 ** 63 - 1).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= edge)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def candidates(query: np.ndarray, norm: float, bound: float, part: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Rows of a part (sorted by falling norm) that may score at least ``bound``."""
    if bound <= 0 or norm == 0:
        return np.arange(len(part)) if bound <= 0 else np.arange(0)
    threshold = bound / (norm * norms[0]) * (1 - SLACK) if norms[0] else np.inf
    if threshold > 1:
        return np.arange(0)
    long_enough = int(np.searchsorted(-norms, -(bound / norm) * (1 - SLACK), side="right"))
    rows = np.arange(long_enough)
    if threshold < BY_COORDINATE:
        return rows
    unit = query / norm
    for f in np.argsort(-np.abs(unit))[:FOCUS]:
        # the vector's angle to the axis differs from the query's by at most the threshold's angle
        own, width = np.arccos(np.clip(unit[f], -1, 1)), np.arccos(threshold)
        low, high = np.cos(min(np.pi, own + width)) - 1e-7, np.cos(max(0.0, own - width)) + 1e-7
        along = part[rows, f] / norms[rows]
        rows = rows[(along >= low) & (along <= high)]
    return rows


def _scores(queries: np.ndarray, part: np.ndarray, kept: list[np.ndarray]) -> list[np.ndarray]:
    """Each query's exact products with its kept rows. Where those are the first
    rows of the part, the queries share one product."""
    runs = [i for i, rows in enumerate(kept) if len(rows) and rows[-1] + 1 == len(rows)]
    out = [np.zeros(0, np.int64)] * len(kept)
    if runs:
        together = _exact(queries[runs], part[:max(len(kept[i]) for i in runs)])
        for at, i in enumerate(runs):
            out[i] = together[at, :len(kept[i])]
    for i in set(range(len(kept))).difference(runs):
        out[i] = _exact(queries[i:i + 1], part[kept[i]])[0]
    return out


def _search(k: int, prune: bool):
    def run(key: tuple, queries: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        if not len(queries) or not len(part):
            return empty
        part = part.sort_values(["norm", "vec_id"], ascending=[False, True])
        q, p = (np.stack(f["whole"].to_numpy()).astype(np.int64) for f in (queries, part))
        ids, norms = part["vec_id"].to_numpy(), part["norm"].to_numpy()
        asking, lengths, bounds = (queries[c].to_numpy() for c in ("vec_id", "norm", "bound"))
        plain, everything = p.astype(np.float64), np.arange(len(p))
        out = []
        for low in range(0, len(q), STRIP):
            strip = range(low, min(low + STRIP, len(q)))
            kept = [
                candidates(q[i].astype(np.float64), lengths[i], bounds[i], plain, norms)
                if prune and bounds[i] == bounds[i] else everything for i in strip]
            for i, rows, scores in zip(strip, kept, _scores(q[low:low + STRIP], p, kept)):
                good = ids[rows] != asking[i]
                if prune and bounds[i] == bounds[i]:
                    good &= scores >= bounds[i]
                rows, scores = rows[good], scores[good]
                best = _best(scores, ids[rows], k)
                out.append((np.full(len(best), asking[i]), ids[rows][best], scores[best]))
        return pd.DataFrame(dict(zip(empty.columns, map(np.concatenate, zip(*out)))))
    return run


def _met(queries: DataFrame, parts: DataFrame, k: int, prune: bool) -> DataFrame:
    keys = ["block", "dim", "bucket", "part"]
    return queries.groupBy(*keys).cogroup(parts.groupBy(*keys)).applyInPandas(
        _search(k, prune), "query_id long, vec_id long, score long")


def top_products(
    rows: DataFrame, is_query: Column, id_column: str = "vec_id", vector_column: str = "embedding", k: int = K,
    scale: int = SCALE,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: of each query row the ``k`` rows with
    the highest integer inner product, the query's own row left out.

    Components are floor(scale * x), with x as a double. ``is_query`` marks the
    stated query set; queries go in blocks and every block meets every part.
    Vectors that are null, empty or hold null or non-finite components take no
    part, nor do rows without an id; zero vectors do. Vectors meet those of
    their own length only. Rows that repeat an id are each a candidate, but not
    of a query with that id, and one of them asks. Ties go to the smaller id. Other columns are not
    read. Fewer candidates than ``k`` give fewer rows.
    """
    whole = F.transform(vector_column, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    good = stored(
        rows.filter(F.col(id_column).isNotNull() & usable(vector_column)).select(
            F.col(id_column).cast("long").alias("vec_id"), whole.alias("whole"),
            F.coalesce(is_query, F.lit(False)).alias("asks"))
        .withColumn("dim", F.size("whole"))
        .withColumn("norm", F.sqrt(F.aggregate("whole", F.lit(0.0), lambda s, x: s + x.cast("double") * x)))
        .withColumn("bucket", F.when(F.col("norm") > 0, F.floor(F.log2("norm") * STEPS)).otherwise(-1).cast("int")),
        "vectors")
    sizes = good.groupBy("dim", "bucket").agg(F.count("*").alias("n"))
    grid = stored(
        sizes.withColumn("parts", F.ceil(F.col("n") / F.lit(PART)).cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), "grid")
    asking = good.filter("asks").groupBy("vec_id").agg(F.min(F.struct("whole", "norm", "dim")).alias("row")).select(
        "vec_id", "row.*")
    blocks = max(1, -(-asking.count() // QUERIES))
    asking = stored(asking.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")), "queries")
    dealt = good.select("vec_id", "whole", "norm", "dim", "bucket").join(
        sizes.select("dim", "bucket", F.ceil(F.col("n") / F.lit(PART)).cast("int").alias("parts")), ["dim", "bucket"]
    ).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")
    rank = F.row_number().over(W.partitionBy("dim").orderBy(F.desc("bucket"), "part"))
    longest = grid.withColumn("rank", rank).filter(F.col("rank") <= SEED_PARTS).select(
        "dim", "bucket", "part", F.lit(True).alias("first"))
    placed = stored(grid.join(longest, ["dim", "bucket", "part"], "left").select(
        "dim", "bucket", "part", F.coalesce("first", F.lit(False)).alias("first"),
        F.pow(F.lit(2.0), (F.col("bucket") + 1) / F.lit(STEPS)).alias("longest")), "placed")
    fields = ["vec_id", "whole", "norm", "bound", "block", "dim", "bucket", "part"]

    def meet(queries: DataFrame, first: bool) -> DataFrame:
        some = placed.filter(F.col("first") == first).drop("first")
        # a vector shorter than this can't reach the query's bound
        need = F.when((F.col("bound") > 0) & ~F.isnan("bound") & (F.col("norm") > 0), F.col("bound") / F.col("norm"))
        queries = queries.withColumn("need", F.coalesce(need, F.lit(0.0)) * (1 - SLACK))
        blocks = stored(
            queries.groupBy("dim", "block").agg(F.min("need").alias("need"))
            .groupBy("dim").agg(F.collect_list(F.struct("block", "need")).alias("blocks")), "blocks")
        sent = dealt.join(some.drop("longest"), ["dim", "bucket", "part"]).join(blocks, "dim").withColumn(
            "block", F.explode(F.filter("blocks", lambda b: b["need"] <= F.col("norm"))["block"])).drop("blocks")
        asked = queries.join(some, "dim").filter(F.col("need") <= F.col("longest"))
        return _met(asked.select(*fields), sent, k, prune=not first)
    seeds = stored(meet(asking.withColumn("bound", F.lit(float("nan"))), True), "seeds")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    bounds = stored(
        seeds.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k)
        .select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("bound")), "bounds")
    bounded = asking.join(bounds, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("nan"))))
    found = seeds.unionByName(meet(bounded, False))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
