"""Near-duplicate vectors by Euclidean p-stable hashing (Datar et al., 2004).

For unit vectors a cosine of at least c is a distance of at most
sqrt(2 - 2 c). Each table hashes a vector by a few random Gaussian projections,
shifted and cut into steps of equal width; vectors that agree on all of them in
some table share a bucket. How many projections and tables are
needed follows from the number of vectors and the wanted recall at the threshold.

Buckets hold numbers and 64-bit sketches (the signs of further projections), not vectors.
In a bucket the vectors are named that have a partner near enough by sketch; only those
vectors are sent, to the buckets where they have one, and compared by exact cosine.

A pair may meet in many tables. A vector is sent with its keys in all tables, so the
pair is counted only in the first one, and no pair ever leaves a task: a task
sends the number of a vector's links, and links enough to connect them.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripcast.durable import forget, stored
from tripcast.llm.arrow import numbers, split_cells, whole_runs
from tripcast.llm.components import components

COSINE = 0.95
WIDTH = 1.0
MISSES = 5e-4          # share of pairs right at the threshold that no table brings together
STRANGERS = 1024       # unrelated vectors that a vector may meet in a table, by sketch only
UNSEEN = 1e-7          # share of pairs at the threshold whose sketches differ in too many bits
CELL = 2048            # rows of a bucket compared in one piece
STRIP = 256            # rows of a cell multiplied at a time


def agreement(distance: float, width: float = WIDTH) -> float:
    """Chance that one projection puts two vectors at this distance in one step."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


@dataclass(frozen=True)
class Tables:
    projections: int
    tables: int
    seed: int = 42
    width: float = WIDTH

    @staticmethod
    def sized(vectors: int, cosine: float = COSINE, misses: float = MISSES, width: float = WIDTH) -> Tables:
        near, far = agreement(math.sqrt(2 - 2 * cosine), width), agreement(math.sqrt(2), width)
        k = max(2, math.ceil(math.log(max(vectors, 1) / STRANGERS, 1 / far)) if vectors > STRANGERS else 2)
        return Tables(k, max(1, math.ceil(math.log(misses) / math.log1p(-near ** k))), width=width)

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """A 32-bit key per row and table."""
        rng = np.random.default_rng([self.seed, unit.shape[1]])
        directions = rng.standard_normal((unit.shape[1], self.projections * self.tables))
        shifts = rng.uniform(0, self.width, self.projections * self.tables)
        steps = np.floor((unit @ directions + shifts) / self.width).astype(np.int64).view(np.uint64)
        steps = steps.reshape(len(unit), self.tables, self.projections)
        mixed = np.full((len(unit), self.tables), unit.shape[1], dtype=np.uint64)
        for j in range(self.projections):
            mixed = (mixed ^ steps[:, :, j]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        return (mixed >> np.uint64(32)).astype(np.uint32)


    def sketches(self, unit: np.ndarray) -> np.ndarray:
        """The signs of 64 projections of each row, as bits."""
        rng = np.random.default_rng([self.seed + 1, unit.shape[1]])
        signs = unit @ rng.standard_normal((unit.shape[1], 64)) > 0
        return np.packbits(signs, axis=1, bitorder="little").view(np.uint64).ravel()


def sketch_bits(cosine: float, unseen: float = UNSEEN) -> int:
    """In how many of 64 signs a pair at this cosine may differ, but for the share ``unseen``."""
    p, held, bits = math.acos(max(-1.0, min(1.0, cosine))) / math.pi, 0.0, -1
    while held < 1 - unseen and bits < 64:
        bits += 1
        held += math.comb(64, bits) * p ** bits * (1 - p) ** (64 - bits)
    return bits


def _matrix(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix for each length of vector in a list column."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, flat[starts[at][:, None] + np.arange(n)[None, :]]


def usable(vector):
    """Not null or empty, no null, NaN or infinite component."""
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(
        vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))


def _signed(tables: Tables, kind: np.dtype):
    """Each class with its vector as bytes, its keys in all tables and its sketch."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in _matrix(batch.column(2)):
                wide = rows.astype(np.float64)
                wide /= np.abs(wide).max(axis=1, keepdims=True)
                unit = wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(pa.array(at)) for i in (0, 1)),
                     pa.array([r.tobytes() for r in rows.astype(kind)], pa.binary()),
                     pa.array([r.tobytes() for r in tables.keys(unit)], pa.binary()),
                     pa.array(tables.sketches(unit).view(np.int64))], names=["rep", "weight", "vector", "own", "sketch"])
    return run


def _buckets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per table; the last twelve bits of a bucket are the table."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(batch.num_rows, -1).astype(np.int64)
        many = keys.shape[1]
        bucket = ((keys << 12) | np.arange(many)).ravel()
        rep, sketch = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False), many) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(rep), pa.array(sketch)], names=["bucket", "rep", "sketch"])


def _partners(bits: int):
    """``cell, side, turn, rep`` of the rows that have a partner by sketch in their cell."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "cell"):
            cell, side, sketch = numbers(table, "cell"), numbers(table, "side"), numbers(table, "sketch").view(np.uint64)
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            needed = np.zeros(len(cell), bool)
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(cell)]):
                if e - s < 2:
                    continue
                own, half = sketch[s:e], side[s:e]
                for low in range(0, e - s, STRIP):
                    rows = slice(low, low + STRIP)
                    near = np.bitwise_count(own[rows, None] ^ own[None, :]) <= bits
                    near[np.arange(near.shape[0]), np.arange(low, low + near.shape[0])] = False
                    if half[0] != 2:
                        near &= half[rows, None] != half[None, :]
                    needed[s + low:s + low + near.shape[0]] |= near.any(1)
            if needed.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers(table, c)[needed]) for c in ("cell", "side", "turn", "rep")],
                    names=["cell", "side", "turn", "rep"])
    return run


def _spanning(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among 0..n-1 that connect what the given links connect."""
    order = np.argsort(np.r_[a, b], kind="stable")
    ends = np.r_[b, a][order]
    starts = np.searchsorted(np.r_[a, b][order], np.arange(n + 1))
    seen, left, right = np.zeros(n, bool), [], []
    for first in np.unique(a):
        if seen[first]:
            continue
        seen[first] = True
        todo = [first]
        while todo:
            at = todo.pop()
            found = ends[starts[at]:starts[at + 1]]
            found = np.unique(found[~seen[found]])
            seen[found] = True
            left += [at] * len(found)
            right += found.tolist()
            todo += found.tolist()
    return np.array(left, np.int64), np.array(right, np.int64)


def _links(cosine: float, kind: np.dtype):
    """Per vector of a cell its new links, weighted, and links that connect them."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "cell"):
            cell, rep, weight, side, turn = (numbers(table, c) for c in ("cell", "rep", "weight", "side", "turn"))
            own, vectors = (table.column(c).combine_chunks() for c in ("own", "vector"))
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            ends = np.r_[starts[1:], len(cell)]
            out: list[tuple] = []
            for s, e in zip(starts, ends):
                if e - s < 2:
                    continue
                lengths = np.array([len(v.as_buffer()) for v in vectors[s:e]])
                for length in np.unique(lengths):
                    at = s + np.flatnonzero(lengths == length)
                    if len(at) < 2:
                        continue
                    x = np.frombuffer(b"".join(vectors[i].as_buffer() for i in at), kind).reshape(len(at), -1)
                    x = x.astype(np.float64)
                    x /= np.abs(x).max(axis=1, keepdims=True)
                    norm = np.sqrt((x * x).sum(axis=1))
                    keys = None
                    found_a, found_b = [], []
                    for low in range(0, len(at), STRIP):
                        rows = slice(low, low + STRIP)
                        close = x[rows] @ x.T >= cosine * norm[rows, None] * norm[None, :]
                        a, b = np.nonzero(np.triu(close, low + 1))
                        a = a + low
                        ok = (side[at[a]] == 2) | (side[at[a]] != side[at[b]])
                        a, b = a[ok], b[ok]
                        if not len(a):
                            continue
                        if keys is None:
                            keys = np.frombuffer(
                                b"".join(own[i].as_buffer() for i in at), np.uint32).reshape(len(at), -1)
                        t = int(turn[at[0]])
                        fresh = np.ones(len(a), bool)
                        for earlier in range(t):
                            fresh &= keys[a, earlier] != keys[b, earlier]
                        found_a.append(a[fresh])
                        found_b.append(b[fresh])
                    if not found_a:
                        continue
                    a, b = np.concatenate(found_a), np.concatenate(found_b)
                    if not len(a):
                        continue
                    n = np.bincount(a, weight[at[b]], len(at)) + np.bincount(b, weight[at[a]], len(at))
                    linked = np.flatnonzero(n)
                    out.append((rep[at[linked]], np.full(len(linked), -1), n[linked].astype(np.int64)))
                    u, v = _spanning(len(at), a, b)
                    out.append((rep[at[u]], rep[at[v]], np.zeros(len(u), np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], names=["a", "b", "n"])
    return run


def near_vectors(
    rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", cosine: float = COSINE,
    misses: float = MISSES, cell: int = CELL,
) -> DataFrame:
    """Per row ``vec_id, n_links, component_id, kept``.

    Links are pairs found with a cosine of at least ``cosine``, in double
    precision. Equal vectors are one class with a weight, so copies never meet as
    pairs. Vectors that are null, empty, zero or hold a null or non-finite
    component link with nothing and are components of their own, as are vectors
    of different lengths to each other. Rows without an id count as no vector:
    no links, no component, not kept. Other columns are not read.
    """
    kind = np.dtype("<f8" if rows.schema[vector_column].dataType.elementType == T.DoubleType() else "<f4")
    some = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("vector"))
    good = some.filter(
        F.col("vec_id").isNotNull() & usable("vector") & F.exists("vector", lambda x: x != 0))
    exact = F.transform("vector", lambda x: x + F.lit(0).cast("float" if kind.itemsize == 4 else "double"))   # no -0
    good = good.withColumn("vector", exact)
    classes = stored(
        good.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
        .select("rep", "weight", "vector"), "classes")
    tables = Tables.sized(classes.count(), cosine, misses)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    signed = stored(classes.repartition(tasks, "rep").mapInArrow(
        _signed(tables, kind), "rep long, weight long, vector binary, own binary, sketch long"), "signed")
    hashed = stored(signed.select("rep", "sketch", "own").mapInArrow(
        _buckets, "bucket long, rep long, sketch long"), "hashed")
    cells = split_cells(hashed, "bucket", F.xxhash64("rep"), cell, "buckets")
    needed = stored(
        cells.withColumn("turn", F.col("bucket").bitwiseAND(F.lit(4095)).cast("int")).drop("bucket")
        .repartition(tasks, "cell").sortWithinPartitions("cell")
        .mapInArrow(_partners(sketch_bits(cosine)), "cell long, side int, turn int, rep long"), "needed")
    met = stored(
        needed.join(signed.drop("sketch"), "rep").repartition(tasks, "cell").sortWithinPartitions("cell")
        .mapInArrow(_links(cosine, kind), "a long, b long, n long"), "met")
    forget(hashed, needed, signed)
    degree = met.filter(F.col("b") == -1).groupBy("a").agg(F.sum("n").alias("others"))
    roots = components(met.filter(F.col("n") == 0), "a", "b")
    known = stored(
        classes.join(degree, classes["rep"] == degree["a"], "left").join(roots, classes["rep"] == roots["node"], "left")
        .select("vector", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                F.coalesce("root", "rep").alias("component_id")), "known")
    linked = good.join(known, "vector").select("vec_id", "n_links", "component_id")
    alone = some.filter(~F.coalesce(
        F.col("vec_id").isNotNull() & usable("vector") & F.exists("vector", lambda x: x != 0), F.lit(False))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
