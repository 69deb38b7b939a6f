"""Packing token sequences: best fit decreasing, certified by dual feasible functions.

Pieces are dealt by a hash of their row number into small groups, so that
repeated rows spread like any others. Each group packs its pieces by best
fit decreasing and takes the best lower bound of two families of dual feasible
functions (Fekete and Schepers, 2001). A group whose bins equal its bound is
certified; there only the loosest bin goes on, since the bound's rounding leaves
room that only other groups can fill. In a group with a gap all bins with room go
on. The pieces that went on are dealt anew, into groups with other neighbours,
and packed again; a round counts only if it needs fewer bins than before.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripcast.durable import forget, stored
from tripcast.llm.arrow import fresh, long_rows

CAPACITY = 1024
SEPARATOR = 2
GROUP = 2048           # pieces packed together
ROUNDS = 4

SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"      # what the pattern's \s takes
LONG_SPACE = re.compile(f"[{SPACE}]{{100000,}}")

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Byte-level BPE ids of a text as little-endian 32-bit numbers.

    The rank file holds the same vocabulary as the JSON file of the tokenizers
    library, whose added tokens are one id each where a text spells them out.
    Tests hold both to the same ids. The regex engine fails on a run of over a
    million white-space characters, so long runs are matched here: the pattern
    takes a run whole at the end of a text or before an added token, and else all
    but its last character.
    """

    def __init__(self, ranks_path: str, json_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        with open(json_path, encoding="utf-8") as whole:
            added = {t["content"]: t["id"] for t in json.load(whole)["added_tokens"]}
        ranks = {word: i for word, i in ranks.items() if i not in added.values()}
        self.bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
        self.added = tuple(added)

    def __call__(self, text: str) -> bytes:
        ids, at = array("I"), 0
        for run in LONG_SPACE.finditer(text):
            end = run.end()
            if end < len(text) and not text.startswith(self.added, end):
                end -= 1
            ids.extend(self.bpe.encode(text[at:run.start()], allowed_special="all"))
            ids.extend(self.bpe._encode_single_piece(text[run.start():end]))
            at = end
        ids.extend(self.bpe.encode(text[at:] if at else text, allowed_special="all"))
        return ids.tobytes()


def public_encoder() -> Callable[[], Encoder]:
    """The 50k byte-level vocabulary that every worker has installed."""
    def make() -> Encoder:
        import public_tokenizers

        return Encoder(
            public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"),
            public_tokenizers.PATTERN)
    return make


_ENCODERS: dict[str, Callable[[str], bytes]] = {}     # of one worker process


def pieces(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY,
    separator: int = SEPARATOR, encoder: Callable[[], Callable[[str], bytes]] | None = None, with_ids: bool = False,
) -> DataFrame:
    """The pieces of every document: its ids, then the separator; only what is
    longer than ``capacity`` is cut, and then the first piece takes the rest.

    Null and empty texts are one piece holding the separator. ``with_ids`` adds
    ``ids``, the piece's little-endian 32-bit ids.
    """
    make = encoder or public_encoder()
    tail = np.array([separator], dtype="<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{make.__module__}.{make.__qualname__}"
        if name not in _ENCODERS:
            _ENCODERS[name] = make()
        encode = _ENCODERS[name]
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + tail
                n = len(ids) // 4
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    part = ids[4 * a:4 * b]
                    rows.append((doc, k, a, b - a, zlib.crc32(part), *([part] if with_ids else [])))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if with_ids else [])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
            columns = list(zip(*rows)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
    return long_rows(docs).select(F.col(id_column).cast("long"), text_column).mapInArrow(
        run, PIECES + (", ids binary" if with_ids else ""))


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing of the sizes needs, by dual feasible functions."""
    if not len(sizes):
        return 0
    counts = np.bincount(sizes, minlength=capacity + 1)
    x = np.arange(capacity + 1)
    best = int(-(-int((counts * x).sum()) // capacity))
    for k in range(1, 13):                     # sizes rounded down to k-ths, exact multiples kept
        whole = (k + 1) * x // capacity
        part = np.where((k + 1) * x % capacity == 0, x * k, whole * capacity)    # in 1 / (k * capacity)
        best = max(best, -(-int((counts * part).sum()) // (k * capacity)))
    total, number = np.cumsum(counts * x), np.cumsum(counts)
    small = np.arange(1, capacity // 2 + 1)    # sizes below it count nothing, above capacity minus it a whole bin
    middle = total[capacity - small] - total[small - 1]
    large = number[capacity] - number[capacity - small]
    return max(best, int((large - (-middle // capacity)).max()))


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of every size, and the number of bins. The bit set of
    free spaces gives the tightest bin in one operation."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces, used = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = spaces >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            chosen = open_bins[space].pop()
            if not open_bins[space]:
                spaces &= ~(1 << space)
        else:
            space, chosen, used = capacity, used, used + 1
        bins[i], offsets[i] = chosen, capacity - space
        if space > size:
            open_bins[space - size].append(chosen)
            spaces |= 1 << (space - size)
    return bins, offsets, used


def _pack_group(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=False, ignore_index=True)
        sizes = rows["length"].to_numpy()
        bins, offsets, used = best_fit_decreasing(sizes, capacity)
        bound = lower_bound(sizes, capacity)
        fill = np.bincount(bins, weights=sizes, minlength=used)
        room = fill < capacity
        if used == bound and room.any():
            loosest = int(np.argmin(fill))
            room[:] = False
            room[loosest] = True
        rows["bin"], rows["offset"] = bins, offsets
        rows["goes_on"], rows["certified"] = room[bins], used == bound
        return rows
    return run


def pack(parts: DataFrame, capacity: int = CAPACITY, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``, plus ``certified``: whether the
    group that settled the piece met its lower bound.

    ``parts`` has the columns of ``pieces`` and maybe more, which are kept.
    Lengths run from 1 to ``capacity``; ties and repeated rows are packed as they
    come. An empty table packs into none. At the end each sequence's offsets are
    gapless from 0.
    """
    (row,) = fresh(parts, "row")
    rest = stored(parts.withColumn(row, F.monotonically_increasing_id()), "pieces")
    columns = rest.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    out = fields + ", bin long, offset long, goes_on boolean, certified boolean"
    full = rest.filter(F.col("length") >= capacity).select(
        *columns, F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    settled = [full]
    pool, open_bins = rest.filter(F.col("length") < capacity), None
    previous = None
    for turn in range(1, rounds + 1):
        n = pool.count()
        if not n:
            previous = None
            break
        groups = max(1, -(-n // (group << (turn - 1))))     # fewer pieces each round, in larger groups
        dealt = pool.withColumn("_group", F.pmod(F.xxhash64(F.lit(turn), row), F.lit(groups)))
        packed = stored(dealt.groupBy("_group").applyInPandas(
            _with_group(_pack_group(capacity), columns), f"_group long, {out}"), "packed")
        bins = packed.select("_group", "bin").distinct().count()
        if open_bins is not None and bins >= open_bins:
            forget(packed)
            break
        named = packed.withColumn(
            "sequence_id", F.lit(turn << 58) + F.col("_group") * F.lit(group << 10) + F.col("bin"))
        keep = [*columns, "sequence_id", "offset", "certified"]
        settled.append(named.filter(~F.col("goes_on")).select(*keep))
        previous = named.filter("goes_on").select(*keep)
        pool = packed.filter("goes_on").select(*columns)
        open_bins = packed.filter("goes_on").select("_group", "bin").distinct().count()
        if open_bins <= 1:
            break
    if previous is not None:
        settled.append(previous)
    out_rows = settled[0]
    for more in settled[1:]:
        out_rows = out_rows.unionByName(more)
    return out_rows.drop(row)


def _with_group(pack_group, columns):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        done = pack_group(rows[columns].copy())
        done.insert(0, "_group", key[0])
        return done
    return run


def pack_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """``pieces`` and ``pack`` in one: every document, whole, in sequences."""
    return pack(pieces(docs, id_column, text_column, **options), options.get("capacity", CAPACITY))
