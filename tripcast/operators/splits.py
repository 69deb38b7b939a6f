"""Splitting rows into training, validation and hold-out parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripcast.durable import checkpointed
from tripcast.functions import hashing, timecols as tc
from tripcast.sources.trips import PICKUP_TIME


def week_sizes(df: DataFrame, ts: str = PICKUP_TIME) -> DataFrame:
    key = tc.iso_week_key(F.col(ts)).alias("week")
    return df.select(key).groupBy("week").agg(F.count(F.lit(1)).alias("n"))


def running_weeks(weeks: DataFrame) -> DataFrame:
    """Rows up to and including each week, and in total. One row per calendar
    week, so a single ordered window is small whatever the number of trips."""
    return weeks.withColumns({
        "upto": F.sum("n").over(W.orderBy("week")),
        "total": F.sum("n").over(W.partitionBy()),
    })


def week_parts(weeks: DataFrame, train: float = 0.6, val: float = 0.2) -> DataFrame:
    """``week, part``: whole weeks only. A week is training while the running
    share stays within ``train``, then validation within ``train + val``, then
    hold-out."""
    share = F.col("upto") / F.col("total")
    part = (
        F.when(share <= F.lit(train), "train")
        .when(share <= F.lit(train + val), "val")
        .otherwise("hold")
    )
    return running_weeks(weeks).withColumn("part", part)


def split_by_weeks(
    df: DataFrame, train: float = 0.6, val: float = 0.2, ts: str = PICKUP_TIME
) -> DataFrame:
    """Add ``part``. The week table has one row per calendar week: it is stored,
    so the weeks are counted once however often the split is read, and
    broadcast, so the trips are not shuffled."""
    parts = checkpointed(week_parts(week_sizes(df, ts), train, val).select("week", "part"))
    keyed = df.withColumn("week", tc.iso_week_key(F.col(ts)))
    return keyed.join(F.broadcast(parts), "week").drop("week")


def random_parts(
    df: DataFrame, id_col: str, seed: int, test: float = 0.15, val: float = 0.15
) -> DataFrame:
    """Add ``part``: ``test`` of all rows, then ``val`` of the rest, by hash."""
    out = hashing.uniform(f"{seed}/test", F.col(id_col)) < F.lit(test)
    held = hashing.uniform(f"{seed}/val", F.col(id_col)) < F.lit(val)
    return df.withColumn("part", F.when(out, "test").when(held, "val").otherwise("train"))
