"""SimHash near-duplicates by anchor points of a covering code.

The 64 bits of a fingerprint are two halves of 32. Of two fingerprints that
differ in at most 4 bits one half differs in at most 2. The anchors of a half
are the words of the perfect Hamming code on its low 31 bits, with the top bit
kept as it is: every half lies within the covering radius 1 of an anchor. Two
halves at distance 2 have a half-way word within 1 of both, and the anchor of
that word lies within 1 + 1 = 2 of both. So each fingerprint is replicated to
every anchor within covering radius plus half the threshold of either half
(both sides travel, each its own part of the threshold): at most 17 anchors a
half of 2^27, whatever the corpus. Fingerprints that meet at an anchor are
compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripcast.durable import stored
from tripcast.llm.arrow import fresh, long_rows, numbers, split_cells, whole_runs
from tripcast.llm.components import components

THRESHOLD = 4
CELL = 2048          # rows of an anchor compared in one piece
BLOCK = 16_384       # shingles held as bits at a time
SMALL = 24           # cells up to this size are compared by shifted copies


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """SimHash of the word shingles of one text, as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(width)]))
        n = len(words) - width + 1
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, n, BLOCK):
        some = min(BLOCK, n - start)
        h = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in islice(shingles, some)), np.uint64, some)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_column: str, text_column: str, width: int = 4) -> DataFrame:
    """``doc_id, fp`` for every row; ``fp`` holds the 64 bits as a signed long."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])
    return long_rows(docs).select(F.col(id_column).cast("long"), text_column).mapInArrow(run, "doc_id long, fp long")


def _flips() -> tuple[np.ndarray, np.ndarray]:
    """Of each syndrome of the Hamming code: the patterns of weight 1 and 2 that
    lead to a code word, padded with the first one; and how many are real."""
    masks = np.zeros((32, 16), dtype=np.uint64)
    for s in range(1, 32):
        patterns = [1 << (s - 1)] + [
            (1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < (i ^ s)]
        masks[s] = np.array(patterns, dtype=np.uint64)
    return masks, np.array([1] + [16] * 31)


FLIPS, N_FLIPS = _flips()
PLACES = [(np.uint64(1 << (i - 1)), np.uint64(i)) for i in range(1, 32)]


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and anchors (half, code word and free bit in one number)."""
    rows, out = [], []
    index = np.arange(len(fps))
    for half in (0, 1):
        word = (fps >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        syndrome = np.zeros(len(fps), dtype=np.uint64)
        for bit, place in PLACES:
            syndrome ^= np.where(word & bit, place, np.uint64(0))
        s = syndrome.astype(np.int64)
        tag = np.uint64(half << 32)
        near = (word[:, None] ^ FLIPS[s]) | tag
        real = np.arange(16)[None, :] < N_FLIPS[s][:, None]
        rows += [np.repeat(index, 16)[real.ravel()], index]
        out += [near.ravel()[real.ravel()], (word ^ FLIPS[s, 0] ^ np.uint64(1 << 31)) | tag]
    return np.concatenate(rows), np.concatenate(out)


def _replicate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        rows, keys = anchors(fps.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(fps[rows])], names=["anchor", "fp"])


def spanning(fps: np.ndarray, threshold: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that connect what is within the threshold among ``fps``: each row
    taken up compares itself with the rows not yet reached."""
    left, right, rest = [], [], fps
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            at = todo.pop()
            close = np.bitwise_count(rest ^ at) <= threshold
            if close.any():
                found = rest[close]
                left.append(np.full(len(found), at))
                right.append(found)
                rest = rest[~close]
                todo.extend(found)
    return left, right


def _compare(threshold: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "cell"):
            cell, fps = numbers(table, "cell"), numbers(table, "fp").view(np.uint64)
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            sizes = np.diff(np.r_[starts, len(cell)])
            left, right = [], []
            for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
                a, b = spanning(fps[start:start + size], threshold)
                left += a
                right += b
            room = np.where(sizes <= SMALL, sizes, 1).repeat(sizes)     # rows of a small cell
            place = np.arange(len(cell)) - starts.repeat(sizes)
            for step in range(1, SMALL):
                at = np.flatnonzero(place + step < room)
                if not len(at):
                    break
                at = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= threshold]
                left.append(fps[at])
                right.append(fps[at + step])
            if left:
                a, b = np.concatenate(left), np.concatenate(right)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])
    return run


def link_fingerprints(distinct: DataFrame, threshold: int = THRESHOLD, cell: int = CELL) -> DataFrame:
    """Links ``a, b`` that connect every pair of the distinct fingerprints ``fp``
    within the threshold (at most 4); not all pairs of a close group."""
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError(f"the anchors cover thresholds from 0 to {THRESHOLD}")
    spread = distinct.select("fp").mapInArrow(_replicate, "anchor long, fp long")
    cells = split_cells(spread, "anchor", F.xxhash64("fp"), cell, "anchors")
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_cells = cells.select("cell", "fp").repartition(tasks, "cell").sortWithinPartitions("cell")
    return sorted_cells.mapInArrow(_compare(threshold), "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    width: int = 4, threshold: int = THRESHOLD, cell: int = CELL,
) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits) and
    ``component_id``, the smallest id it can reach through links.

    A null or empty text has fingerprint 0 and links like any other. Equal
    fingerprints are one class throughout, so copies cost one row. Repeated
    rows keep their place. A null id is never the smallest one; a component
    of null ids only has a null id. An empty table gives an empty result.
    Columns other than the two named are not read, so their names don't matter.
    """
    prints = stored(fingerprints(docs, id_column, text_column, width), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(link_fingerprints(classes, threshold, cell), "a", "b")
    placed = stored(
        classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
        .select("fp", "first", F.coalesce("root", "fp").alias("root")), "placed")
    names = stored(placed.groupBy("root").agg(F.min("first").alias("component_id")), "names")
    named = stored(placed.join(names, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_copies(docs: DataFrame, found: DataFrame, id_column: str) -> DataFrame:
    """``docs`` without the rows whose ``doc_id`` in ``found`` is not the smallest
    of its component. The ids to drop grow with the corpus, so they are always
    joined by shuffle."""
    (key,) = fresh(docs, "dropped_id")
    gone = stored(
        found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(key)).distinct(), "gone")
    return docs.join(gone.hint("merge"), docs[id_column] == gone[key], "left_anti")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The documents that are the smallest of their component, with all their
    columns. Rows that repeat an id stay or go together; rows without an id
    stay, as nothing says which of them is first."""
    return without_copies(docs, near_duplicates(docs, id_column, text_column, **options), id_column)
