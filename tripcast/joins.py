"""Joins that hold up under hot keys, and spreading few rows over many tasks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 << 20     # estimated size of the largest table that is sent to every task
TEXT_BYTES, ITEMS = 40, 8       # guesses for what a schema doesn't tell
HOT_ROWS = 5_000_000     # rows of one key worth keeping out of a shuffle join
TASK_ROWS = 250_000      # narrow rows that one task sorts


def row_bytes(kind: T.DataType) -> int:
    """Estimated size of a value or, for a schema, of a row."""
    if isinstance(kind, T.StructType):
        return 16 + sum(8 + row_bytes(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return 16 + ITEMS * row_bytes(kind.elementType)
    return TEXT_BYTES if isinstance(kind, (T.StringType, T.BinaryType)) else 8


def fits(df: DataFrame, rows: int | None) -> bool:
    """Whether ``df``, known to have at most ``rows`` rows, may be broadcast."""
    return rows is not None and rows * row_bytes(df.schema) <= BROADCAST_BYTES


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equality join in which null matches null; the left keys are kept."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_r_{k}" for k in keys])


def join_groups(left: DataFrame, plan: DataFrame, keys: Sequence[str], groups: int) -> DataFrame:
    """Rows with their group's row of ``plan``, null matching null.

    ``plan`` is stored, has one row per group and the group's size in ``_n``;
    ``groups`` is its row count. A small plan is broadcast. Of a large one the
    groups above HOT_ROWS, of which there are at most all rows / HOT_ROWS, are
    broadcast and the rest joined by shuffle, so no task gets a hot group.
    """
    if fits(plan, groups):
        return join_same(left, F.broadcast(plan), keys)
    hot = plan.filter(F.col("_n") > HOT_ROWS)
    hot = small(hot, hot.count())
    busy = join_same(left, hot, keys)
    quiet = join_same(join_same(left, hot.select(*keys), keys, "left_anti"), plan.filter(F.col("_n") <= HOT_ROWS), keys)
    return busy.unionByName(quiet)


def small(df: DataFrame, rows: int | None) -> DataFrame:
    """Hint a broadcast when ``df`` is known to have at most ``rows`` rows and
    they are small; otherwise leave the choice to Catalyst's size check."""
    return F.broadcast(df) if fits(df, rows) else df


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Shuffle rows that are about to be multiplied into a full set of tasks.

    The explicit number keeps adaptive execution from merging the tasks again
    for being small: it sees the rows before they are multiplied.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *columns)


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks to sort or join ``rows`` narrow rows in, so that one holds no more of a larger
    table. As an explicit number it keeps adaptive execution from merging them again."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
