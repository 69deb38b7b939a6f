"""Ranked lexical search over classes of equal bags.

A document matters to a set of items only by how often it holds their terms and by its
length factor m. So every document is restricted to the vocabulary of the items; documents
with the same bag (term numbers and counts) and the same m are one class, found by a hash
and verified on the whole bag. Each class is scored once, and its members take their
places by ascending id. A class of copies, however large, costs one score: of its members
only the ``limit`` smallest ids can be among the best, and each task sends on no more.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripcast.durable import forget, stored
from tripcast.llm.arrow import long_rows

LIMIT = 10
POSTINGS = 1_000_000     # terms of items that are sent to every task at a time, some 60 MB
CELLS = 1 << 22          # numbers in one dense block of scores

# A term is a run of ASCII letters and digits and of bytes above 0x7F; A-Z are lower-cased.
_LETTERS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_LETTERS).split()


def _postings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = Counter(terms(text))
            yield pa.RecordBatch.from_arrays(
                [pa.array([item] * len(own), pa.int64()), pa.array(list(own), pa.binary()),
                 pa.array(list(own.values()), pa.int64())], names=["item", "term", "times"])


def _bags(vocabulary):
    """``doc_id, n`` and the bag: pairs of term number and count, by number."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = vocabulary.value
        for batch in batches:
            sizes, bags = [], []
            for text in batch.column(1):
                own = terms(text.as_py())
                held = Counter(own)
                pairs = sorted((numbers[t], c) for t, c in held.items() if t in numbers)
                sizes.append(len(own))
                bags.append(np.array(pairs, "<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(bags, pa.binary())], names=["doc_id", "n", "bag"])
    return run


def _holders(size: int):
    """How many of a task's bags hold each term."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            pairs = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4").reshape(-1, 2)
            df += np.bincount(pairs[:, 0], minlength=size)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], names=["number", "df"])
    return run


class Items:
    """The items of one block: for groups of them the terms they hold and how often, as a
    dense table of at most ``cells`` numbers, or one item."""

    def __init__(self, item: np.ndarray, number: np.ndarray, times: np.ndarray, weight: np.ndarray,
                 cells: int = CELLS):
        order = np.argsort(item, kind="stable")
        item, number, times = item[order], number[order], times[order]
        self.names, starts = np.unique(item, return_index=True)
        ends = np.r_[starts[1:], len(item)]
        self.weight, self.cells, self.groups = weight, cells, []
        at = 0
        while at < len(self.names):
            stop, held = at, np.zeros(0, number.dtype)
            while stop < len(self.names):
                more = np.union1d(held, number[starts[stop]:ends[stop]])
                if stop > at and len(more) * (stop + 1 - at) > cells:
                    break
                held, stop = more, stop + 1
            some = slice(starts[at], ends[stop - 1])
            table = np.zeros((len(held), stop - at), np.int64)
            columns = np.repeat(np.arange(stop - at), ends[at:stop] - starts[at:stop])
            table[np.searchsorted(held, number[some]), columns] = times[some]
            # doubles are exact below 2^53; a factor is at most 10^6
            largest = int((table * weight[held][:, None]).sum(axis=0).max(initial=0)) * 1_000_000
            self.groups.append((at, held, table.astype(np.float64) if largest < 1 << 53 else table))
            at = stop


def _factors(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Best:
    """The best classes per item so far: highest score first, then smallest first member."""

    def __init__(self, items: int, limit: int):
        self.limit = limit
        self.least = np.ones(items, np.int64)       # the score that a class must reach
        self.item = self.score = np.zeros(0, np.int64)
        self.members: list[list] = []

    def add(self, item: np.ndarray, score: np.ndarray, members: list[list]) -> None:
        item, score, members = np.r_[self.item, item], np.r_[self.score, score], [*self.members, *members]
        first = [m[0]["id"] for m in members]
        known = np.array([f is not None for f in first], bool)
        order = np.lexsort((np.array([f or 0 for f in first], np.int64), known, -score, item))
        item, score = item[order], score[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        keep = place < self.limit
        full = place == self.limit - 1
        self.least[item[full]] = score[full]
        self.item, self.score, self.members = item[keep], score[keep], [members[i] for i in order[keep].tolist()]

    def rows(self) -> Iterator[tuple[int, int, int | None]]:
        """Their members, as many per item as can be among the best."""
        taken: Counter = Counter()
        for item, score, members in sorted(
                zip(self.item.tolist(), self.score.tolist(), self.members), key=lambda r: (r[0], -r[1])):
            for member in members:      # members of equal scores are told apart later
                taken[item] += 1
                yield item, score, member["id"]


def _scores(sent, limit: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = sent.value
        best = Best(len(items.names), limit)
        for batch in batches:
            bags, members = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            m = batch.column(0).to_numpy(zero_copy_only=False)
            pairs = np.frombuffer(b"".join(bags), "<u4").reshape(-1, 2).astype(np.int64)
            row = np.repeat(np.arange(len(bags)), [len(b) // 8 for b in bags])
            number = pairs[:, 0]
            worth = items.weight[number] * _factors(pairs[:, 1], m[row])
            for first, held, table in items.groups:
                at = np.minimum(np.searchsorted(held, number), len(held) - 1)
                own = held[at] == number
                step = max(1, items.cells // max(len(held), table.shape[1]))
                for start in range(0, len(bags), step):
                    some = slice(*np.searchsorted(row, [start, start + step]))
                    use = own[some]
                    dense = np.zeros((min(step, len(bags) - start), len(held)), table.dtype)
                    dense[row[some][use] - start, at[some][use]] = worth[some][use]
                    score = (dense @ table).astype(np.int64)
                    which, item = np.nonzero(score >= best.least[first:first + table.shape[1]])
                    if len(which):
                        best.add(item + first, score[which, item], [members[start + i] for i in which.tolist()])
        rows = list(best.rows())
        for start in range(0, len(rows), 10_000):
            item, score, ids = zip(*rows[start:start + 10_000])
            yield pa.RecordBatch.from_arrays(
                [pa.array(items.names[list(item)]), pa.array(score, pa.int64()), pa.array(ids, pa.int64())],
                names=["item", "score", "doc_id"])
    return run


def _rank_block(docs: DataFrame, postings: DataFrame, limit: int, cells: int) -> DataFrame:
    """``item, rank, doc_id, score`` for a block of items, whose postings fit every task."""
    sc = docs.sparkSession.sparkContext
    table = postings.toArrow()
    words = table.column("term").combine_chunks().dictionary_encode()
    vocabulary = sc.broadcast({t: i for i, t in enumerate(words.dictionary.to_pylist())})
    size = len(words.dictionary)
    bags = stored(docs.mapInArrow(_bags(vocabulary), "doc_id long, n long, bag binary").filter("n > 0"), "bags")
    n_docs, n_terms = bags.agg(F.count("*"), F.sum("n")).first()
    df = np.zeros(size, np.int64)
    counted = bags.select("bag").mapInArrow(_holders(size), "number long, df long").groupBy("number").agg(
        F.sum("df").alias("df")).toArrow()
    df[counted.column("number").to_numpy()] = counted.column("df").to_numpy()
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    items = sc.broadcast(Items(
        table.column("item").to_numpy(), words.indices.to_numpy().astype(np.int64), table.column("times").to_numpy(), weight,
        cells))
    m = F.expr(f"25 + (75L * n * {n_docs}L) div {n_terms or 1}L")
    bag = bags.filter(F.octet_length("bag") > 0).select("doc_id", m.alias("m"), "bag").withColumn("h", F.xxhash64("m", "bag"))
    same = W.partitionBy("h", "m", "bag")       # the hash brings together, the whole bag decides
    classes = stored(
        bag.withColumn("place", F.row_number().over(same.orderBy("doc_id"))).filter(F.col("place") <= limit)
        .groupBy("h", "m", "bag").agg(F.sort_array(F.collect_list(F.struct(F.col("doc_id").alias("id")))).alias("members"))
        .select("m", "bag", "members"), "classes")
    forget(bags)
    found = classes.mapInArrow(_scores(items, limit), "item long, score long, doc_id long")
    best = W.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    ranked = stored(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit), "ranked")
    forget(classes)
    return ranked


def rank_documents(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id",
    item_text_column: str = "text", limit: int = LIMIT, postings: int = POSTINGS,
    cells: int = CELLS,
) -> DataFrame:
    """``item_id, rank, doc_id, score`` of each item's ``limit`` best documents with a score
    above 0; equal scores by ascending id, a null id first. Scores are whole numbers: weight
    floor(1000 ln((2N + 2) / (2 df + 1))) times (10^9 tf) div (1000 tf + 8 m), summed over
    the item's terms, repeats included, with m = 25 + (75 n N) div L.

    Null and empty texts have no terms: such documents count nowhere and such items get no
    rows. Rows that share an id are separate documents, or separate items with a ranking
    each. Empty tables give an empty result. Columns other than the four named are not
    read. Items are taken in blocks of at most ``postings`` terms (or one item), one pass
    over the documents a block. A product that doesn't fit 64 bits is an error.
    """
    texts = long_rows(docs).select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").cast("binary").alias("text"))
    named = stored(items.select(
        F.monotonically_increasing_id().alias("item"), F.col(item_column).alias("item_id"),
        F.col(item_text_column).cast("string").cast("binary").alias("text")), "items")
    held = stored(named.select("item", "text").mapInArrow(_postings, "item long, term binary, times long"), "postings")
    total = held.count()
    blocks = -(-total // postings)
    spread = F.pmod(F.xxhash64("item"), F.lit(max(blocks, 1)))
    ranked = [_rank_block(texts, held.filter(spread == b), limit, cells) for b in range(blocks)]
    if not ranked:
        ranked = [docs.sparkSession.createDataFrame([], "item long, score long, doc_id long, rank int")]
    forget(held)
    return reduce(DataFrame.unionByName, ranked).join(named.select("item", "item_id"), "item").select(
        "item_id", "rank", "doc_id", "score")
