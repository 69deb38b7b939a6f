"""Removing repeated passages by longest-previous-factor arrays.

A byte goes if it lies in a string of ``least`` bytes that also starts earlier, in a
smaller document or before in the same one. In suffix order the longest earlier match of
a position (its longest previous factor) is with the nearest smaller position before it or
after it, so a position starts a repeat if one of those two shares ``least`` bytes.

One suffix array of everything is too large for a task. Equal strings share the smallest
hash of their short grams, so suffixes are dealt into cells by that hash: a run of
neighbouring suffixes with the same smallest hash is one piece of text. Cells with one
occurrence only are dropped before any text moves. Each task sorts the suffixes of whole
cells and takes previous and next smaller positions there. Equal pieces have the same
suffixes, in order of position, so all but the first are earlier matched as a whole.

A gram that occurs very often (a passage in a third of all documents) has as many
different surroundings and would make one cell too large. Its suffixes are dealt by the
128-bit fingerprint of their first ``least`` bytes instead, each chunk of documents sending
the first of equal ones only, so a cell has at most one row a chunk.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripcast.durable import new_folder
from tripcast.llm.arrow import long_rows, whole_runs

LEAST = 100
CHUNK = 2 << 20          # bytes of documents handled together; a longer document is a chunk of its own
BLOCK = 4 << 20          # bytes hashed at a time
PIECE = 1 << 14          # suffixes in one piece of text at most
CROWDED = 4096           # occurrences of a gram above which its suffixes are dealt by fingerprint
SORTED = 1 << 20         # bytes of pieces put in suffix order at a time
BUCKET_BYTES = 16 << 20  # of text, per bucket of the stored chunks

BASES = tuple(np.uint64(b) for b in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
CHUNKS = "chunk long, ids array<bigint>, sizes array<bigint>, text binary"
PIECES = "cell long, doc_id long, chunk long, at int, start long, n int, piece binary, loops boolean"
SPANS = "chunk long, at int, start long, stop long"


def gram_hashes(text: np.ndarray, width: int, base: np.uint64 = BASES[0]) -> np.ndarray:
    """Mixed polynomial hash of the ``width`` bytes at each place that has them."""
    if len(text) < width:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        power, times = {1: text.astype(np.uint64) + np.uint64(1)}, {1: base}
        size = 1
        while 2 * size <= width:
            power[2 * size] = power[size][:-size] * times[size] + power[size][size:]
            times[2 * size] = times[size] * times[size]
            size *= 2
        out, have = power[size], size
        while have < width:      # append the largest power that still fits
            size = max(s for s in power if s <= width - have)
            out = out[:len(power[size]) - have] * times[size] + power[size][have:]
            have += size
        out = out ^ (out >> np.uint64(32))
        out *= np.uint64(0xD6E8FEB86659FD93)
        return out ^ (out >> np.uint64(32))


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values = pick(values[:-size], values[size:])
        size *= 2
    return pick(values[:len(values) - (width - size)], values[width - size:]) if width > size else values


def gram_width(least: int) -> int:
    """Length of the grams: a power of two, a third of ``least`` or so."""
    return max(1, 1 << max(0, (least // 3).bit_length() - 1))


def _blocks(sizes: np.ndarray, least: int, block: int) -> Iterator[tuple[int, int]]:
    """Byte ranges to hash at a time; one ends where it has no suffix of the next."""
    total, start = int(sizes.sum()), 0
    while start < total:
        stop = min(total, start + block)
        yield start, min(total, stop + least - 1)
        start = stop


class Chunk:
    """Documents one after the other in one array of bytes."""

    def __init__(self, text: bytes, sizes: list[int], least: int, block: int = BLOCK):
        self.text, self.least, self.block = np.frombuffer(text, np.uint8), least, block
        self.sizes = np.array(sizes, np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes

    def _has_suffix(self, start: int, stop: int) -> np.ndarray:
        """Of the places from ``start`` to ``stop``: those with ``least`` bytes left in their document."""
        ok = np.ones(stop - start, bool)
        for end, size in zip(self.ends.tolist(), self.sizes.tolist()):
            low, high = max(end - min(size, self.least - 1), start), min(end, stop)
            if low < high:
                ok[low - start:high - start] = False
        return ok

    def runs(self) -> Iterator[tuple]:
        """Per block: smallest hash, place and number of suffixes of each run of suffixes
        that share it; start of the block, hashes of all its grams, and which of them are
        smallest for a suffix."""
        gram = gram_width(self.least)
        width = self.least - gram + 1
        for start, stop in _blocks(self.sizes, self.least, self.block):
            hashes = gram_hashes(self.text[start:stop], gram)
            if len(hashes) < width:
                continue
            low = _slide(hashes, width, np.minimum)
            ok = self._has_suffix(start, start + len(low))
            begins = np.r_[True, (low[1:] != low[:-1]) | (ok[1:] != ok[:-1])]
            first = np.flatnonzero(begins)
            n = np.diff(np.r_[first, len(low)])
            real = ok[first]
            first, n = first[real], n[real]
            high = np.where(ok, low, np.uint64(0))
            padded = np.r_[np.zeros(width - 1, np.uint64), high, np.zeros(width - 1, np.uint64)]
            yield low[first], first + start, n, start, hashes, hashes == _slide(padded, width, np.maximum)


def _chunks(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 33
        made = 0
        held: list[tuple[int | None, bytes]] = []
        total = 0

        def close() -> pa.RecordBatch:
            nonlocal held, total, made
            held.sort(key=lambda d: (d[0] is not None, d[0] or 0))
            row = [[part + made], [[d for d, _ in held]], [[len(t) for _, t in held]], [b"".join(t for _, t in held)]]
            made, held, total = made + 1, [], 0
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, types)], names=["chunk", "ids", "sizes", "text"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or b""
                if held and total + len(text) > size:
                    yield close()
                held.append((doc_id, text))
                total += len(text)
        if held:
            yield close()
    return run


def _grams(least: int, block: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, sizes, text in zip(*(batch.column(c).to_pylist() for c in ("chunk", "sizes", "text"))):
                for *_, hashes, chosen in Chunk(text, sizes, least, block).runs():
                    grams, n = np.unique(hashes[chosen], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(grams.view(np.int64)), pa.array(np.full(len(grams), chunk)), pa.array(n.astype(np.int32))],
                        names=["gram", "chunk", "n"])
    return run


def _merged(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of the ranges, as ranges that don't touch."""
    if not len(starts):
        return starts, stops
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    new = np.r_[True, starts[1:] > stops[:-1]]
    first = np.flatnonzero(new)
    return starts[first], stops[np.r_[first[1:] - 1, len(stops) - 1]]


def _pieces(least: int, block: int, longest: int):
    """Of each chunk: the pieces of text of shared grams, equal ones once, and the spans
    that are later copies within the chunk."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _piece_table([])
        chunk, ids, sizes, text = (left.column(c)[0].as_py() for c in ("chunk", "ids", "sizes", "text"))
        grams = right.column("gram").to_numpy().view(np.uint64)
        order = np.argsort(grams)
        grams, crowded = grams[order], right.column("crowded").to_numpy(zero_copy_only=False)[order]
        own = Chunk(text, sizes, least, block)
        width = least - gram_width(least) + 1
        seen: set[tuple[int, bytes]] = set()
        rows, copies, often = [], [], []
        for low, first, n, base, hashes, _ in own.runs():
            where = np.minimum(np.searchsorted(grams, low), len(grams) - 1)
            shared = grams[where] == low
            low, first, n, many = low[shared], first[shared], n[shared], crowded[where[shared]]
            often += list(zip(first[many].tolist(), n[many].tolist()))
            for cell, at, count in zip(low[~many].tolist(), first[~many].tolist(), n[~many].tolist()):
                for some in range(at, at + count, longest):
                    stop = min(at + count, some + longest)
                    piece = text[some:stop + least - 1]
                    if (cell, piece) in seen:
                        copies.append((some, stop + least - 1))
                    else:
                        seen.add((cell, piece))
                        # a second place of the gram within the piece: it may repeat itself
                        within = hashes[some - base:stop - base + width - 1]
                        loops = stop - some > 1 and np.count_nonzero(within == np.uint64(cell)) > 1
                        rows.append((cell, some, stop - some, piece, loops))
        often.sort()      # runs go on across blocks
        for start, stop in _joined(often, block):
            prints = [gram_hashes(own.text[start:stop + least - 1], least, b) for b in BASES]
            for some, (a, b) in enumerate(zip(prints[0].tolist(), prints[1].tolist()), start):
                key = (a, b.to_bytes(8, "little"))
                if key in seen:
                    copies.append((some, some + least))
                else:
                    seen.add(key)
                    rows.append((a, some, 1, key[1], False))
        starts, stops = np.array(copies, np.int64).reshape(-1, 2).T
        at = np.searchsorted(own.ends, starts, side="right")       # a gap of one keeps documents apart
        starts, stops = _merged(starts + at, stops + at)
        at = np.searchsorted(own.ends + np.arange(len(ids)), starts, side="right")
        rows += [(None, a, n, None, False) for a, n in zip((starts - at).tolist(), (stops - starts).tolist())]
        return _piece_table(rows, chunk, ids, own)
    return run


def _joined(runs: list[tuple[int, int]], block: int) -> Iterator[tuple[int, int]]:
    """Runs of suffixes next to each other as one, ``block`` suffixes or so at most."""
    start = stop = 0
    for at, n in runs:
        if stop > start and (at != stop or stop - start >= block):
            yield start, stop
            start = at
        elif stop == start:
            start = at
        stop = at + n
    if stop > start:
        yield start, stop


def _piece_table(rows: list[tuple], chunk: int = 0, ids: list | None = None, own: Chunk | None = None) -> pa.Table:
    cell, place, n, piece, loops = zip(*rows) if rows else ((),) * 5
    places = np.array(place, np.int64)
    at = np.searchsorted(own.ends, places, side="right") if rows else np.zeros(0, np.int64)
    signed = pa.array(np.array([c or 0 for c in cell], np.uint64).view(np.int64))
    copied = pa.array([c is None for c in cell], pa.bool_())
    spread = pa.array(places * 31 + chunk, pa.int64())     # spans that are settled go anywhere
    return pa.table({
        "cell": pc.if_else(copied, spread, signed),
        "doc_id": pa.array(ids or [], pa.int64()).take(pa.array(at)), "chunk": pa.array(np.full(len(rows), chunk, np.int64)),
        "at": pa.array(at.astype(np.int32)), "start": pa.array(places - (own.starts[at] if rows else places)),
        "n": pa.array(n, pa.int32()), "piece": pa.array(piece, pa.binary()), "loops": pa.array(loops, pa.bool_())})


def repeats(text: np.ndarray, suffix: np.ndarray, position: np.ndarray, least: int) -> np.ndarray:
    """Whether each suffix, given by its place in ``text``, has a longest previous factor
    of ``least`` or more: prefix doubling on that many bytes gives suffix order with ties,
    and of the nearest smaller positions before and after one shares the rank."""
    def dense(values: np.ndarray) -> np.ndarray:
        return np.unique(values, return_inverse=True)[1].astype(np.uint64)

    if not len(suffix):
        return np.zeros(0, bool)
    size, ranks, top = 1, {1: text.astype(np.uint64)}, 256      # ranks lie below top; pairs must fit 64 bits
    while 2 * size <= least:
        if top * top > 1 << 64:
            ranks[size], top = dense(ranks[size]), len(text)
        both = ranks[size] * np.uint64(top)
        both[:len(both) - size] += ranks[size][size:]
        size, top = 2 * size, top * top
        ranks[size] = both
    whole, have = dense(ranks[size][suffix]), size
    while have < least:
        step = max(s for s in ranks if s <= least - have)
        after = dense(ranks[step][np.minimum(suffix + have, len(text) - 1)])
        whole = dense(whole * np.uint64(len(suffix)) + after)
        have += step
    order = np.lexsort((position, whole))
    place, rank = position[order], whole[order]
    out = np.zeros(len(suffix), bool)
    for step in (-1, 1):
        nearest = np.arange(len(order)) + step      # of the smaller positions on this side
        inside = lambda k: (k >= 0) & (k < len(order))
        todo = np.flatnonzero(inside(nearest))
        while len(todo):
            todo = todo[place[nearest[todo]] > place[todo]]
            nearest[todo] = nearest[nearest[todo]]
            todo = todo[inside(nearest[todo])]
        real = inside(nearest)
        out[real] |= rank[nearest[real]] == rank[real]
    flags = np.zeros(len(suffix), bool)
    flags[order] = out
    return flags


def _earlier(table: pa.Table, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, first suffixes and numbers of suffixes that are matched earlier, of whole cells."""
    column = {c: table.column(c).combine_chunks() for c in table.column_names}
    ids = column["doc_id"]
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    keys = [column[c].to_numpy(zero_copy_only=False) for c in ("start", "at", "chunk")]
    cell, n = (column[c].to_numpy(zero_copy_only=False) for c in ("cell", "n"))
    order = np.lexsort((*keys, ids.fill_null(0).to_numpy(zero_copy_only=False), known, cell))
    pieces, loops = column["piece"].to_pylist(), column["loops"].to_pylist()
    seen: set[tuple[int, bytes]] = set()
    kinds: dict[int, list[int]] = {}
    found = []
    for row in order.tolist():
        if pieces[row] is None:
            found.append(row)
            continue
        key = (int(cell[row]), pieces[row])
        if key in seen:
            found.append(row)
            continue
        seen.add(key)
        if len(pieces[row]) >= least:
            kinds.setdefault(key[0], []).append(row)
    rows, firsts = np.array(found, np.int64), np.zeros(len(found), np.int64)
    counts = n[rows].astype(np.int64)
    mixed = [r for some in kinds.values() if len(some) > 1 or loops[some[0]] for r in some]
    if mixed:
        text = np.frombuffer(b"".join(pieces[r] for r in mixed), np.uint8)
        sizes, many = np.array([len(pieces[r]) for r in mixed]), n[mixed].astype(np.int64)
        row_of = np.repeat(np.arange(len(mixed)), many)
        within = np.arange(len(row_of)) - np.repeat(np.cumsum(many) - many, many)
        suffix = (np.cumsum(sizes) - sizes)[row_of] + within
        hit = np.flatnonzero(repeats(text, suffix, np.arange(len(suffix)), least))
        rows = np.r_[rows, np.array(mixed)[row_of[hit]]]
        firsts, counts = np.r_[firsts, within[hit]], np.r_[counts, np.ones(len(hit), np.int64)]
    return rows, firsts, counts


def _match(least: int):
    def spans(table: pa.Table) -> pa.RecordBatch:
        rows, firsts, counts = _earlier(table, least)
        chunk, at, start = (table.column(c).to_numpy()[rows] for c in ("chunk", "at", "start"))
        settled = table.column("piece").combine_chunks().is_null().to_numpy(zero_copy_only=False)[rows]
        starts = start + firsts
        stops = starts + counts + np.where(settled, 0, least - 1)
        order = np.lexsort((starts, at, chunk))
        rows = np.stack([chunk[order], at[order], starts[order], stops[order]]) if len(order) else np.zeros((4, 0), np.int64)
        # neighbours of one document that touch are one span
        new = np.r_[True, (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0) | (rows[2][1:] > rows[3][:-1])][:rows.shape[1]]
        first = np.flatnonzero(new)
        stop = np.maximum.reduceat(rows[3], first) if len(first) else rows[3]
        return pa.RecordBatch.from_arrays(
            [pa.array(rows[0][first]), pa.array(rows[1][first].astype(np.int32)), pa.array(rows[2][first]), pa.array(stop)],
            names=["chunk", "at", "start", "stop"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for table in whole_runs(batches, "cell"):
            held.append(table)
            size += table.column("piece").nbytes
            if size >= SORTED:
                yield spans(pa.concat_tables(held).combine_chunks())
                held, size = [], 0
        if held:
            yield spans(pa.concat_tables(held).combine_chunks())
    return run


def _kept(left: pa.Table, right: pa.Table) -> pa.Table:
    """The documents of a chunk without their spans."""
    out: list[tuple] = []
    if left.num_rows:
        ids, sizes, text = (left.column(c)[0].as_py() for c in ("ids", "sizes", "text"))
        at, start, stop = (right.column(c).to_numpy() for c in ("at", "start", "stop"))
        order = np.argsort(at, kind="stable")
        edges = np.searchsorted(at[order], np.arange(len(ids) + 1))
        ends = np.cumsum(np.array(sizes, np.int64)).tolist()
        for k, (doc_id, size, end) in enumerate(zip(ids, sizes, ends)):
            some = order[edges[k]:edges[k + 1]]
            starts, stops = (x.tolist() for x in _merged(start[some], stop[some]))
            own = text[end - size:end]
            kept = b"".join(own[a:b] for a, b in zip([0, *stops], [*starts, size])) if starts else own
            out.append((doc_id, size, [{"start": a, "stop": b} for a, b in zip(starts, stops)], kept))
    columns = list(zip(*out)) or [()] * 4
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(span), pa.binary()))],
                    names=["doc_id", "n_bytes", "spans", "kept"])


def _stored_chunks(docs: DataFrame, id_column: str, text_column: str, size: int) -> tuple[DataFrame, int]:
    """The documents in chunks, stored by bucket of the chunk so that the two passes
    that bring something to a chunk move only that, not the texts."""
    spark = docs.sparkSession
    texts = long_rows(docs).select(F.col(id_column).cast("long"), F.col(text_column).cast("string").cast("binary"))
    total = docs.agg(F.sum(F.octet_length(F.col(text_column).cast("string")))).first()[0] or 0
    tasks = min(100_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES)))
    name = f"chunks_{uuid.uuid4().hex}"
    (texts.mapInArrow(_chunks(size), CHUNKS).repartition(tasks, "chunk").write.format("parquet")
     .option("path", new_folder(spark, "chunks")).option("compression", "zstd").bucketBy(tasks, "chunk").saveAsTable(name))
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")      # only the name; the files are needed on
    return found, tasks


def remove_repeats(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST, chunk: int = CHUNK,
    crowded: int = CROWDED, block: int = BLOCK, piece: int = PIECE,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_bytes``, ``spans`` (start and stop of each
    maximal removed run of bytes, from 0) and ``kept``, the other bytes as binary, since a
    span may end inside a character.

    A null text is an empty one; texts shorter than ``least`` lose nothing. Rows that
    share an id are different documents, in the order in which they were read; a null id
    is smaller than any other. A document of any length is handled whole, one at a time.
    An empty table gives an empty result. Columns other than the two named are not
    read, so their names don't matter. The other options bound memory; the result is the same.
    """
    if least < 2:
        raise ValueError("a repeat has two bytes or more")
    chunks, tasks = _stored_chunks(docs, id_column, text_column, chunk)
    grams = chunks.select("chunk", "sizes", "text").mapInArrow(_grams(least, block), "gram long, chunk long, n int")
    shared = (
        grams.withColumn("total", F.sum("n").over(W.partitionBy("gram"))).filter("total > 1")
        .select("chunk", "gram", (F.col("total") > crowded).alias("crowded")))
    pieces = chunks.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(_pieces(least, block, piece), PIECES)
    spans = (pieces.repartition(tasks, "cell").sortWithinPartitions("cell").mapInArrow(_match(least), SPANS))
    return chunks.groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(
        _kept, "doc_id long, n_bytes long, spans array<struct<start:bigint,stop:bigint>>, kept binary")
