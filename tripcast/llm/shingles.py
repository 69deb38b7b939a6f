"""Near duplicates by Jaccard similarity of word shingles, found by SimHash anchors.

A text's SimHash has 320 bits over its shingle set. At a similarity of 0.8 a bit differs
with a probability of 0.15, too often for anchors within a fixed radius. But the bits that
differ are those whose sum over the shingles is near zero, and a text knows its sums. So
it travels to those anchors of a covering code that its sums make nearest: in each of six
tables, of the pairs of code words of Hamming(15,11) for 30 of its bits, to the 16 with
the least sum over the bits they change. At a similarity of 0.8 two texts have no common
anchor with a probability of 2e-4, nearer pairs with less. Texts that meet at an anchor
and differ in at most 35 of 128 other bits are candidates (1e-4 differ in more at 0.8).

Families of texts connected by candidates then confirm on the shingle sets themselves,
each set sent once unless its family is larger than a cell.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripcast.durable import forget, stored
from tripcast.llm.arrow import long_rows, numbers, split_cells, whole_runs
from tripcast.llm.components import components
from tripcast.llm.simhash import without_copies

WIDTH = 5
SIMILAR = (4, 5)     # 0.8, as a fraction: sets are compared in whole numbers
TABLES, PROBES = 6, 16
HALF, HALF_BITS = 15, 11      # bits of a code word, and of its number
COMPARED, WORDS = 2, 5        # 64-bit words of a SimHash that are compared, and all: the others give the anchors
DIFFER = 35          # bits of the 128 compared in which candidates differ at most
CELL = 512           # texts of a family compared in one piece
MET = 4096           # fingerprints of an anchor compared in one piece
LANE, LANES = 255, 64         # hashes whose bits are added in bytes, and how many times as many are held
SMALL = 128          # anchors up to this size are compared by shifted copies
LISTED = 2_000_000   # texts with a candidate whose numbers are sent to every task: 16 MB

_DRAWN = np.random.default_rng(42)
SEEDS = _DRAWN.integers(0, 2**64, (WORDS, 1), dtype=np.uint64)
TIMES = np.uint64(int(_DRAWN.integers(0, 2**64, dtype=np.uint64)) | 1)
ONES = np.uint64(0x0101010101010101)


def _code() -> np.ndarray:
    """The words of the perfect Hamming(15,11) code as rows of -1 and 1."""
    bits = np.arange(1 << HALF)[:, None] >> np.arange(HALF) & 1
    syndrome = np.bitwise_xor.reduce(bits * np.arange(1, HALF + 1), axis=1)
    return (2 * bits[syndrome == 0] - 1).astype(np.float32)


CODE = _code()
TIES = _DRAWN.random(len(CODE), dtype=np.float32) / 2      # of equally near words all texts take the same


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of the distinct word shingles; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    some = {b" ".join(words)} if len(words) < width else set(map(b" ".join, zip(*[words[i:] for i in range(width)])))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in some), np.uint64, len(some)))


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """Of each bit of the SimHash: how many more shingles of a set have it than not."""
    ones = np.zeros((WORDS, 8, 8), np.int64)     # word, byte, bit
    for start in range(0, len(hashes), LANE * LANES):
        x = hashes[start:start + LANE * LANES] ^ SEEDS
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        lanes = np.zeros((WORDS, -(-x.shape[1] // LANE) * LANE), np.uint64)
        lanes[:, :x.shape[1]] = x ^ (x >> np.uint64(31))
        lanes = lanes.reshape(WORDS, -1, LANE)
        for bit in range(8):
            added = ((lanes >> np.uint64(bit)) & ONES).sum(axis=2)
            ones[:, :, bit] += added.view(np.uint8).reshape(WORDS, -1, 8).sum(axis=1, dtype=np.int64)
    return (2 * ones - len(hashes)).reshape(-1)


def anchors(sums: np.ndarray) -> np.ndarray:
    """A row of anchors, table and two code words in one number, for each row of bit sums."""
    first = 64 * COMPARED
    out = []
    for some in np.array_split(sums, len(sums) // 64 + 1):
        half = some[:, first:first + 2 * HALF * TABLES].reshape(-1, HALF).astype(np.float32)
        cost = np.abs(half).sum(axis=1, keepdims=True) - half @ CODE.T + TIES      # twice the sums of the bits changed
        words = np.argpartition(cost, PROBES - 1, axis=1)[:, :PROBES]
        cost = np.take_along_axis(cost, words, axis=1).reshape(-1, 2, PROBES)
        words = words.reshape(-1, 2, PROBES)
        both = (cost[:, 0, :, None] + cost[:, 1, None, :]).reshape(-1, PROBES * PROBES)
        pairs = ((words[:, 0, :, None] << HALF_BITS) + words[:, 1, None, :]).reshape(-1, PROBES * PROBES)
        least = np.argpartition(both, PROBES - 1, axis=1)[:, :PROBES]
        found = np.take_along_axis(pairs, least, axis=1).reshape(-1, TABLES, PROBES)
        out.append((found + (np.arange(TABLES) << 2 * HALF_BITS)[:, None]).reshape(-1, TABLES * PROBES))
    return np.concatenate(out).astype(np.int32)


def _named(prints: np.ndarray) -> np.ndarray:
    """One number for the two words of a fingerprint."""
    return (prints[:, 0] ^ (prints[:, 1] * TIMES)).view(np.int64)


def _signed(text_column: int, width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text.as_py(), width) for text in batch.column(text_column)]
            nodes = [xxhash.xxh64_intdigest(own.tobytes(), 42) for own in sets]
            sums = np.array([bit_sums(own) for own in sets], np.int64).reshape(-1, 64 * WORDS)
            prints = np.packbits(sums[:, :64 * COMPARED] > 0, axis=1, bitorder="little").view(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.array(nodes, np.uint64).view(np.int64)),
                 pa.array([len(own) for own in sets], pa.int32()), pa.array(_named(prints)),
                 pa.array([p.tobytes() for p in prints], pa.binary()),
                 pa.array([a.tobytes() for a in anchors(sums)], pa.binary())],
                names=["doc_id", "text", "node", "n", "print", "bits", "anchors"])
    return run


def _replicate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64).reshape(-1, COMPARED)
        found = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int32)
        first, second = np.repeat(prints, TABLES * PROBES, axis=0).T
        yield pa.RecordBatch.from_arrays(
            [pa.array(found), pa.array(np.ascontiguousarray(first)), pa.array(np.ascontiguousarray(second))],
            names=["anchor", "first", "second"])


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64) <= DIFFER


def _chosen(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of ``n`` rows linked by ``a, b``: the smallest row each can reach."""
    low = np.arange(n)
    while (low[a] != low[b]).any():
        least = np.minimum(low[a], low[b])
        np.minimum.at(low, low[a], least)
        np.minimum.at(low, low[b], least)
        low = low[low]
    return low


def _meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that connect the candidates among the fingerprints of each anchor."""
    for table in whole_runs(batches, "cell"):
        cell = numbers(table, "cell")
        prints = np.stack([numbers(table, "first"), numbers(table, "second")], axis=1).view(np.uint64)
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        sizes = np.diff(np.r_[starts, len(cell)])
        left, right = [], []
        for start, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
            rest = np.arange(start, start + size)
            while len(rest):
                todo, rest = [int(rest[0])], rest[1:]
                while todo and len(rest):
                    at = todo.pop()
                    near = _close(prints[rest], prints[at])
                    found, rest = rest[near], rest[~near]
                    left.append(np.full(len(found), at))
                    right.append(found)
                    todo += found.tolist()
        room = np.where(sizes <= SMALL, sizes, 1).repeat(sizes)     # rows of a small cell
        place = np.arange(len(cell)) - starts.repeat(sizes)
        for step in range(1, SMALL):
            at = np.flatnonzero(place + step < room)
            if not len(at):
                break
            at = at[_close(prints[at], prints[at + step])]
            left.append(at)
            right.append(at + step)
        if left:
            low = _chosen(len(cell), np.concatenate(left), np.concatenate(right))
            names, linked = _named(prints), np.flatnonzero(low != np.arange(len(cell)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[low[linked]]), pa.array(names[linked])], names=["a", "b"])


def spanning(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect the sets that are similar, as positions: each set taken
    up compares itself with those not yet reached."""
    sizes = np.array([len(s) for s in sets])
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    held = np.zeros(len(values), bool)
    links, rest = [], np.arange(len(sets))
    flat = codes.ravel()
    while len(rest):
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            at = todo.pop()
            held[:] = False
            held[flat[ends[at] - sizes[at]:ends[at]]] = True
            total = np.r_[0, np.cumsum(held[flat])]
            both = total[ends[rest]] - total[ends[rest] - sizes[rest]]
            near = both * SIMILAR[1] >= (sizes[rest] + sizes[at] - both) * SIMILAR[0]
            found = rest[near].tolist()
            links += [(at, b) for b in found]
            rest = rest[~near]
            todo += found
    return links


def _confirm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_runs(batches, "cell"):
        cell, node = numbers(table, "cell"), numbers(table, "node")
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        column = table.column("shingles")
        links = []
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(cell)]):
            if end - start > 1:
                sets = [np.frombuffer(column[i].as_py(), np.uint64) for i in range(start, end)]
                links += [(start + a, start + b) for a, b in spanning(sets)]
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])


def _sets(width: int, sent=None):
    """Shingle sets of the texts; of those on the list that is sent, if there is one."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if sent is not None:
                batch = batch.filter(pa.array(np.isin(batch.column(0).to_numpy(zero_copy_only=False), sent.value)))
            sets = [shingle_set(t.as_py(), width).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])
    return run


def _sets_of(texts: DataFrame, wanted: DataFrame, width: int, listed: int) -> DataFrame:
    """``node, shingles`` of the wanted nodes, once each. Texts are shuffled only
    when the list is too long to send."""
    schema = "node long, shingles binary"
    if wanted.count() > listed:
        once = texts.join(wanted, "node").groupBy("node").agg(F.first("text").alias("text"))
        return once.mapInArrow(_sets(width), schema)
    sent = texts.sparkSession.sparkContext.broadcast(np.array([r[0] for r in wanted.collect()], np.int64))
    return texts.mapInArrow(_sets(width, sent), schema).groupBy("node").agg(F.first("shingles").alias("shingles"))


def _families(classes: DataFrame, tasks: int) -> DataFrame:
    """``family, node`` of the texts that candidates connect with others; texts with equal
    fingerprints are candidates throughout."""
    met = classes.select("bits", "anchors").mapInArrow(_replicate, "anchor int, first long, second long")
    cells = split_cells(met.withColumn("anchor", F.col("anchor").cast("long")), "anchor", F.xxhash64("first", "second"), MET, "met")
    candidates = stored(
        cells.select("cell", "first", "second").repartition(tasks, "cell").sortWithinPartitions("cell")
        .mapInArrow(_meet, "a long, b long").distinct(), "candidates")
    roots = components(candidates, "a", "b").withColumnRenamed("node", "print")
    placed = stored(
        classes.select("node", "print").join(roots, "print", "left").select(
            "node", F.coalesce("root", "print").alias("family")), "families")
    several = placed.groupBy("family").agg(F.count("*").alias("c")).filter("c > 1").select("family")
    found = stored(placed.join(several, "family").select("family", "node"), "members")
    forget(candidates, placed)
    return found


def similar_texts(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH, cell: int = CELL,
    listed: int = LISTED,
) -> DataFrame:
    """``doc_id, component_id`` of every row: the smallest id it can reach through
    pairs of texts whose shingle sets have a Jaccard similarity of 0.8 or more.

    Texts with the same set are one node throughout. Null and blank texts have the
    empty set, which is similar to itself only. A null id is never the smallest one.
    """
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    signed = stored(
        long_rows(docs).select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
        .mapInArrow(_signed(1, width), "doc_id long, text string, node long, n int, print long, bits binary, anchors binary"),
        "signed")
    classes = stored(signed.groupBy("node").agg(
        F.min("doc_id").alias("first"), *(F.first(c).alias(c) for c in ("n", "print", "bits", "anchors"))), "classes")
    families = _families(classes.filter("n > 0"), tasks)
    wanted = stored(families.select("node"), "wanted")
    sets = stored(_sets_of(signed.select("node", "text"), wanted, width, listed), "sets")
    cells = split_cells(families, "family", F.xxhash64("node"), cell, "crowded")
    links = stored(
        cells.select("cell", "node").join(sets, "node").select("cell", "node", "shingles").repartition(tasks, "cell")
        .sortWithinPartitions("cell").mapInArrow(_confirm, "a long, b long").distinct(), "links")
    forget(families, wanted, sets)
    roots = components(links, "a", "b")
    placed = stored(
        classes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")), "placed")
    names = stored(placed.groupBy("root").agg(F.min("first").alias("component_id")), "names")
    named = stored(placed.join(names, "root").select("node", "component_id"), "named")
    found = stored(signed.select("doc_id", "node").join(named, "node").select("doc_id", "component_id"), "found")
    forget(signed, classes, placed, names, named)
    return found


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The documents that are the smallest of their component, as ``simhash.keep_one``."""
    return without_copies(docs, similar_texts(docs, id_column, text_column, **options), id_column)
