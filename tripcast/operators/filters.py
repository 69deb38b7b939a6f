"""Row filters and the columns derived from the pickup time."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripcast.functions import timecols as tc
from tripcast.sources.trips import COORDINATES, DROPOFF_ZONE, PICKUP_TIME, PICKUP_ZONE


def in_period(df: DataFrame, start: str, end: str, ts: str = PICKUP_TIME) -> DataFrame:
    """Rows with ``start <= ts < end``. Comparing the column itself lets the
    Parquet reader skip row groups; a filter on year and month would not."""
    low, high = (F.lit(v).cast("timestamp_ntz") for v in (start, end))
    return df.filter((F.col(ts) >= low) & (F.col(ts) < high))


def on_weekdays(df: DataFrame, first: int, last: int, ts: str = PICKUP_TIME) -> DataFrame:
    """Weekdays ``first`` to ``last``, Monday being 0."""
    return df.filter(tc.weekday_of(F.col(ts)).between(first, last))


@dataclass(frozen=True)
class Period:
    """Days from ``start`` to before ``end`` on weekdays ``first`` to ``last``."""

    start: str
    end: str
    first: int = 0
    last: int = 6


STUDY = Period("2024-01-01", "2024-03-01", 0, 2)     # the reference's months, Monday to Wednesday


def study_period(df: DataFrame, period: Period = STUDY, ts: str = PICKUP_TIME) -> DataFrame:
    return on_weekdays(in_period(df, period.start, period.end, ts), period.first, period.last, ts)


def with_trip_columns(df: DataFrame, ts: str = PICKUP_TIME) -> DataFrame:
    """Add hour, weekday, the cyclic hour and the unit measure ``trips``."""
    sin_hour, cos_hour = tc.cyclic_hour(tc.hour_of(F.col(ts)))
    return df.withColumns({
        "hour": tc.hour_of(F.col(ts)),
        "weekday": tc.weekday_of(F.col(ts)),
        "sin_hr": sin_hour,
        "cos_hr": cos_hour,
        "trips": F.lit(1),
    })


MIXTURE_FEATURES = ["sin_hr", "cos_hr", *COORDINATES]


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop rows with a null in any listed column."""
    return df.dropna(subset=list(columns))


def from_zones(df: DataFrame, zone_ids: Sequence[int], column: str = PICKUP_ZONE) -> DataFrame:
    """Keep rows of the listed zones."""
    return df.filter(F.col(column).isin(list(zone_ids)))


def at_hour_on(df: DataFrame, hour: int, weekday: int) -> DataFrame:
    return df.filter((F.col("hour") == hour) & (F.col("weekday") == weekday))


def without_zone(pickup: Column, dropoff: Column) -> Column:
    blank = lambda c: c.isNull() | (c.cast("string") == "")
    return blank(pickup) | blank(dropoff)


def trips_without_zone(df: DataFrame, pickup: str, dropoff: str, trips: str = "trips") -> DataFrame:
    """One row: trips lacking a pickup or a drop-off zone, and all trips."""
    lost = F.when(without_zone(F.col(pickup), F.col(dropoff)), F.col(trips)).otherwise(0)
    return df.agg(F.sum(lost).alias("trips_without_zone"), F.sum(trips).alias("trips"))


def of_zone(
    df: DataFrame, pickup_id: int | None = None, dropoff_id: int | None = None,
    pickup: str = PICKUP_ZONE, dropoff: str = DROPOFF_ZONE,
) -> DataFrame:
    """Filter by pickup zone, or else by drop-off zone, or not at all."""
    if pickup_id is not None:
        return df.filter(F.col(pickup) == pickup_id)
    if dropoff_id is not None:
        return df.filter(F.col(dropoff) == dropoff_id)
    return df
