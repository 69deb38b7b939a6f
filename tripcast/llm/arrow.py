"""Small helpers for work on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripcast.durable import stored


def long_rows(df: DataFrame) -> DataFrame:
    """``df``, with batches to and from Python kept to a thousand rows, as one
    row may be a long text. This is a setting of the session and stays."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names close to the given ones that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def whole_runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold every row of their keys; the input is sorted by ``key``.

    Only one run at a time is held beyond a batch, so the caller bounds the runs.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        changes = np.flatnonzero(keys[1:] != keys[:-1])
        first_differs = held and held[-1].column(key)[-1].as_py() != keys[0]
        if not len(changes):
            if first_differs:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch)
            continue
        cut = int(changes[-1]) + 1
        yield pa.Table.from_batches([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def split_cells(rows: DataFrame, bucket: str, row_hash: Column, limit: int, label: str) -> DataFrame:
    """Rows with a ``cell``, a bounded piece of their bucket's square of pairs.

    A bucket of at most ``limit`` rows is one cell. A larger one is dealt into
    chunks by ``row_hash`` and each chunk meets every other in a cell of its
    own, so no pair is lost and no task holds the bucket. ``side`` is 0 or 1 in
    the cell of two different chunks and 2 where a chunk meets itself. Only the
    buckets above the limit, at most rows / limit, are joined back.
    """
    sizes = stored(
        rows.groupBy(bucket).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit)
        .select(bucket, F.ceil(F.col("_n") / F.lit(limit)).cast("int").alias("_c")), label)
    dealt = rows.join(sizes, bucket, "left")
    single = dealt.filter(F.col("_c").isNull()).withColumns({"cell": F.col(bucket), "side": F.lit(2)})
    other = F.col("_o")
    many = (
        dealt.filter(F.col("_c").isNotNull()).withColumn("_k", F.pmod(row_hash, F.col("_c")).cast("int"))
        .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)))
        .withColumn("side", F.when(other == F.col("_k"), 2).when(F.col("_k") < other, 0).otherwise(1))
        .withColumn("cell", F.xxhash64(bucket, F.least("_k", "_o"), F.greatest("_k", "_o")))
        .drop("_k", "_o"))
    return single.unionByName(many).drop("_c")
