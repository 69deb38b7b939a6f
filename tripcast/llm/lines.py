"""Line deduplication by distinct-site spread.

A line is boilerplate if it stands on many sites. Each distinct text counts once, for its
first site, so copies of a document say nothing about its lines. Nor do near copies: a text
of which half or more, by length and by lines, is on many sites is itself spread by copying,
and a line needs its sites among the other texts. So every line of a header or footer goes,
however its lines follow each other, and the lines of copied documents stay, which
document deduplication handles. Sites are counted by HyperLogLog sketches per line hash
that merge by aggregation; lines near the threshold are counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripcast.durable import forget, stored
from tripcast.llm.arrow import fresh, long_rows

SITES = 10
COPIED = 0.5    # share of a text's length, and of its lines, on many sites from which it is no evidence
BAND = 0.1      # six standard errors of a sketch of 2^12 registers
LG_K = 12
LISTED = 2_000_000      # boilerplate lines that are sent to every task: 16 MB


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def line_table(docs: DataFrame, id_column: str, text_column: str, site_column: str) -> DataFrame:
    """``id, text, site, line, size`` per line that is not blank: hashes of the text and of
    the trimmed line, and its length; the site is stored by its name, to say which of
    several is first."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    each = F.transform(F.split(text, "\n"), lambda x: F.struct(
        F.xxhash64(_trimmed(x)).alias("line"), F.char_length(_trimmed(x)).cast("long").alias("size")))
    rows = docs.select(
        F.col(id_column).alias("id"), F.xxhash64(text).alias("text"),
        F.coalesce(F.col(site_column).cast("string"), F.lit("")).alias("site"), F.inline(each))
    return rows.filter("size > 0")


def _on_sites(pairs: DataFrame, sites: int, band: float) -> DataFrame:
    """Lines of ``line, site`` on as many sites; a null site is a site of its own."""
    sketched = stored(pairs.groupBy("line").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites")), "sketched")
    near, enough = F.abs(F.col("sites") - sites) <= band * sites, F.col("sites") >= sites
    close = pairs.join(sketched.filter(near).select("line"), "line").select("line", "site").distinct()
    exact = close.groupBy("line").agg(F.count("*").alias("sites"))
    found = stored(sketched.filter(~near & enough).select("line").unionByName(exact.filter(enough).select("line")), "lines")
    forget(sketched)
    return found


def spread_lines(lines: DataFrame, sites: int = SITES, copied: float = COPIED, band: float = BAND) -> DataFrame:
    """Hashes ``line`` of the boilerplate lines of a stored ``line_table``.

    A line on ``sites`` sites occurs that often, so all others are left out by
    count before any sketch is made.
    """
    often = stored(
        lines.groupBy("line").agg(F.count("*").alias("n")).filter(F.col("n") >= sites).select("line"), "often")
    once = stored(lines.select("text", "line", "size").distinct(), "once")
    whole = once.groupBy("text").agg(F.sum("size").alias("total"), F.count("*").alias("many"))
    first = lines.groupBy("text").agg(F.xxhash64(F.min("site")).alias("site"))
    texts = stored(whole.join(first, "text"), "texts")
    pairs = stored(once.join(often, "line").join(texts, "text"), "pairs")
    wide = _on_sites(pairs, sites, band)
    some = stored(pairs.join(wide, "line"), "some")
    copies = stored(
        some.groupBy("text", "total", "many").agg(F.sum("size").alias("length"), F.count("*").alias("n"))
        .filter((F.col("length") >= copied * F.col("total")) & (F.col("n") >= copied * F.col("many"))).select("text"), "copies")
    found = _on_sites(some.join(copies, "text", "left_anti"), sites, band)
    forget(often, once, texts, pairs, wide, some, copies)
    return found


def _without_listed(docs: DataFrame, text_column: str, bad: DataFrame, removed: str) -> DataFrame:
    """Texts without the lines of a short list, which every task holds sorted."""
    sent = docs.sparkSession.sparkContext.broadcast(
        np.sort(bad.select("line").toArrow().column(0).to_numpy()))
    where = docs.columns.index(text_column)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = sent.value
        for batch in batches:
            texts, gone = [], []
            for text in batch.column(where):
                own = (text.as_py() or "").split("\n")
                keys = np.array([
                    xxhash.xxh64_intdigest(x.strip(" \t\r").encode(), 42) for x in own], np.uint64).view(np.int64)
                at = np.minimum(np.searchsorted(listed, keys), max(len(listed) - 1, 0))
                hit = listed[at] == keys if len(listed) else np.zeros(len(own), bool)
                texts.append("\n".join(x for x, h in zip(own, hit) if not h) if text.is_valid else None)
                gone.append(int(hit.sum()))
            columns = list(batch.columns)
            columns[where] = pa.array(texts, batch.schema.types[where])
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(gone, pa.int32())], names=[*batch.schema.names, removed])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, `{removed}` int")


def _without_joined(docs: DataFrame, id_column: str, text_column: str, lines: DataFrame, bad: DataFrame,
                    removed: str) -> DataFrame:
    """Texts without the lines of a list of any length: each document is joined
    with its own lines on the list."""
    key, gone, own = fresh(docs, "own_id", "gone_lines", "lines")
    hit = stored(
        lines.join(bad, "line").select("id", "line").distinct().groupBy("id")
        .agg(F.collect_list("line").alias(gone)).withColumnRenamed("id", key), "hit")
    joined = docs.join(hit, docs[id_column].eqNullSafe(hit[key]), "left").withColumn(
        own, F.split(F.col(text_column), "\n"))
    kept = F.filter(own, lambda x: ~F.array_contains(F.col(gone), F.xxhash64(_trimmed(x))))
    whole = F.col(gone).isNull() | F.col(own).isNull()
    return joined.withColumns({
        text_column: F.when(whole, F.col(text_column)).otherwise(F.array_join(kept, "\n")),
        removed: F.when(whole, 0).otherwise(F.size(own) - F.size(kept))}).select(*docs.columns, removed)


def remove_spread_lines(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", site_column: str = "source",
    sites: int = SITES, copied: float = COPIED, removed: str | None = None, listed: int = LISTED,
) -> DataFrame:
    """All rows and columns of ``docs``, the text without its boilerplate lines;
    with ``removed``, a column of that name counts them.

    Lines compare trimmed; blank lines stay. A null text stays null, an empty
    one empty, and a text of boilerplate only becomes empty: no row is dropped.
    Rows that share an id, or have none, are handled together without mixing
    their texts, as whether a line goes hangs on the line alone. A list of at
    most ``listed`` lines is sent to the tasks and the texts are not shuffled; a
    longer one is joined. The rows are the same.
    """
    count = removed or fresh(docs, "removed_lines")[0]
    docs = long_rows(docs)
    lines = stored(line_table(docs, id_column, text_column, site_column), "lines")
    bad = spread_lines(lines, sites, copied)
    if bad.count() <= listed:
        clean = _without_listed(docs, text_column, bad, count)
    else:
        clean = _without_joined(docs, id_column, text_column, lines, bad, count)
    return clean if removed else clean.drop(count)
