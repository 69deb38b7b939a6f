"""Sliding windows over demand series.

All inputs are demand that has been counted already: at most 96 rows per day
and zone. Windows that must run across days are taken in blocks of positions,
each block borrowing its successor's first rows, so a long series is spread
over tasks instead of going to one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripcast.durable import stored
from tripcast.functions import timecols as tc

BLOCK = 65_536   # positions per window task


def with_position(
    series: DataFrame, value: str = "trips", day: str = "date", within: Sequence[str] = ("slot",)
) -> DataFrame:
    """Number the rows of a series 0, 1, 2... in time order.

    A row's number is its place within its day plus the rows of earlier days.
    Only the per-day counts, one row per calendar day, are ordered in one task
    and broadcast. The series is stored when this is called, as it is read twice.
    """
    series = stored(series, "series")
    before = F.sum("n").over(W.orderBy(day).rowsBetween(W.unboundedPreceding, -1))
    starts = series.groupBy(day).agg(F.count(value).alias("n")).select(
        day, F.coalesce(before, F.lit(0)).alias("_start")
    )
    place = F.row_number().over(W.partitionBy(day).orderBy(*within)) - 1
    numbered = series.join(F.broadcast(starts), day)
    return numbered.withColumn("pos", F.col("_start") + place).drop("_start")


def sliding_windows(
    numbered: DataFrame, value: str = "trips", width: int = 4, block: int = BLOCK,
    of_target: Sequence[str] = (),
) -> DataFrame:
    """Windows by position: ``pos, x0 .. x{width-1}, y``; ``y`` is the next
    value. A series of n rows has n - width windows. ``of_target`` names columns
    of the target's row to keep."""
    here = F.floor(F.col("pos") / block)
    lent = (F.col("pos") % block < width) & (here > 0)
    spread = numbered.select("pos", *of_target, F.col(value).cast("double").alias("v")).withColumn(
        "block", F.explode(F.when(lent, F.array(here - 1, here)).otherwise(F.array(here)))
    )
    along = W.partitionBy("block").orderBy("pos")
    steps = {f"x{k}": F.lead("v", k).over(along) for k in range(1, width)}
    targets = {c: F.lead(c, width).over(along) for c in of_target}
    out = spread.withColumns({**steps, **targets, "y": F.lead("v", width).over(along)})
    own = F.floor(F.col("pos") / block) == F.col("block")
    return out.filter(own & F.col("y").isNotNull()).select(
        "pos", *of_target, F.col("v").alias("x0"), *[f"x{k}" for k in range(1, width)], "y"
    )


def chronological_split(windows: DataFrame, share: float = 0.7) -> DataFrame:
    """Add ``part``: the first ``int(share * n)`` windows train, the rest
    validate."""
    n = windows.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    cut = F.floor(F.lit(share) * n)
    return windows.withColumn("part", F.when(F.col("pos") < cut, "train").otherwise("val"))


def zone_windows(grid: DataFrame, length: int = 3, horizon: int = 1) -> DataFrame:
    """Multivariate windows, long: per first slot and channel the ``length``
    inputs ``x*`` and, for zones, the ``horizon`` targets ``y*``.

    The channels are the zones and the slot of the day, named ``slot``, which
    has no target. A zone's series is bounded by the calendar.
    """
    clock = grid.select("slot_ts", "slot").distinct()
    rows = grid.select(
        "slot_ts", F.col("zone").alias("channel"), F.col("trips").cast("double").alias("v"),
        F.lit(True).alias("zonal"),
    ).unionByName(clock.select(
        "slot_ts", F.lit("slot").alias("channel"), F.col("slot").cast("double").alias("v"),
        F.lit(False).alias("zonal"),
    ))
    along = W.partitionBy("zonal", "channel").orderBy("slot_ts")
    steps = {f"s{k}": F.lead("v", k).over(along) for k in range(1, length + horizon)}
    full = rows.withColumns(steps).filter(F.col(f"s{length + horizon - 1}").isNotNull())
    step = lambda k: F.col("v") if k == 0 else F.col(f"s{k}")
    return full.select(
        "slot_ts", "channel", "zonal",
        *[step(k).alias(f"x{k}") for k in range(length)],
        *[F.when(F.col("zonal"), step(length + k)).alias(f"y{k}") for k in range(horizon)],
    )


def day_windows(series: DataFrame, width: int = 4, by: Sequence[str] = ()) -> DataFrame:
    """Windows inside one day: ``date, start, x0 .. , y``, kept when all
    ``width + 1`` slots are present; ``by`` tells series apart."""
    along = W.partitionBy(*by, "date").orderBy("slot")
    steps = {f"x{k}": F.lead("trips", k).over(along) for k in range(1, width)}
    out = series.withColumns({
        "x0": F.col("trips"), **steps,
        "y": F.lead("trips", width).over(along),
        "_last": F.lead("slot", width).over(along),
    })
    whole = out.filter(F.col("_last") == F.col("slot") + width)
    return whole.select(*by, "date", F.col("slot").alias("start"), *[f"x{k}" for k in range(width)], "y")


def day_order(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rank of every date present; one row per calendar day and series."""
    days = series.filter(F.col("trips").isNotNull()).select(*by, "date").distinct()
    return days.withColumn("day_rank", F.dense_rank().over(W.partitionBy(*by).orderBy("date")))


def day_pairs(series: DataFrame, width: int = 4, by: Sequence[str] = ()) -> DataFrame:
    """Windows present on a day and on the next day that has data, of each series that
    the columns ``by``, never null, tell apart.

    The pairs come from one ordered pass per start slot over the days, in place
    of a self join. The series is stored when this is called, as its days are
    ranked apart.
    """
    series = stored(series, "series")
    ranked = day_windows(series, width, by).join(F.broadcast(day_order(series, by)), [*by, "date"])
    along = W.partitionBy(*by, "start").orderBy("date")
    names = [f"x{k}" for k in range(width)] + ["y"]
    nexts = {f"{c}_val": F.lead(c).over(along) for c in names}
    paired = ranked.withColumns({
        **nexts, "date_val": F.lead("date").over(along), "_rank": F.lead("day_rank").over(along),
    }).filter(F.col("_rank") == F.col("day_rank") + 1)
    return paired.select(
        *by, F.col("date").alias("date_train"), "date_val",
        F.col("start").alias("window_start_hour"),
        tc.window_label(F.col("start"), width).alias("hours_used"),
        *[c for k in range(width) for c in (
            F.col(f"x{k}").alias(f"h{k}_train"), F.col(f"x{k}_val").alias(f"h{k}_val"))],
        F.col("y").alias("target_train"), F.col("y_val").alias("target_val"),
    )
