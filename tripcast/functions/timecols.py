"""Time columns of a trip: hours, slots, dates, weeks and the cyclic hour.

Trip timestamps carry no time zone, so every function keeps TIMESTAMP_NTZ and
never goes through the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
SLOT_MINUTES = 15
SLOTS_PER_DAY = 96
HOURS_PER_DAY = 24
EPOCH_ORDINAL = 719163  # day number of 1970-01-01, counting 0001-01-01 as day 1


def parse_timestamp(ts: Column) -> Column:
    """Text or timestamp to a timestamp without time zone."""
    return ts.cast("timestamp_ntz")


def hour_of(ts: Column) -> Column:
    return F.hour(ts)


def weekday_of(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def date_of(ts: Column) -> Column:
    return F.to_date(ts)


def slot_of(ts: Column) -> Column:
    """Quarter hour of the day, 0 to 95."""
    return (F.hour(ts) * 4 + F.floor(F.minute(ts) / SLOT_MINUTES)).cast("int")


def floor_to_slot(ts: Column) -> Column:
    """Start of the quarter hour. Plain arithmetic, so null stays null (a
    ``window`` grouping would drop the row)."""
    past = F.make_dt_interval(
        F.lit(0), F.lit(0), F.minute(ts) % SLOT_MINUTES, F.date_part(F.lit("SECOND"), ts)
    )
    return ts - past


def at_time(date: Column, hours: Column | int = 0, minutes: Column | int = 0) -> Column:
    """Timestamp of a date plus hours and minutes."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return date.cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), as_column(hours).cast("int"), as_column(minutes).cast("int")
    )


def cyclic_hour(hour: Column) -> tuple[Column, Column]:
    """Sine and cosine of the hour's angle on a 24-hour dial."""
    angle = hour * (2 * F.pi()) / HOURS_PER_DAY
    return F.sin(angle), F.cos(angle)


def decode_hour(sin_hour: Column, cos_hour: Column) -> Column:
    """Nearest whole hour for a point near the dial; halves go to the even hour."""
    turn = F.pmod(F.atan2(sin_hour, cos_hour), 2 * F.pi()) / (2 * F.pi())
    return F.rint(turn * HOURS_PER_DAY).cast("int") % HOURS_PER_DAY


def day_number(date: Column) -> Column:
    """Ordinal day, 0001-01-01 being 1."""
    return F.datediff(date, F.lit("1970-01-01").cast("date")) + EPOCH_ORDINAL


def date_from_day_number(number: Column) -> Column:
    """Inverse of :func:`day_number` for real numbers, rounding halves to even."""
    days = F.rint(number).cast("int") - EPOCH_ORDINAL
    return F.date_add(F.lit("1970-01-01").cast("date"), days)


def iso_week_key(ts: Column) -> Column:
    """``YYYY-WW`` with the ISO year, so 2024-12-30 is in 2025-01."""
    return F.concat_ws(
        "-",
        F.date_part(F.lit("YEAROFWEEK"), ts).cast("string"),
        F.lpad(F.weekofyear(ts).cast("string"), 2, "0"),
    )


def window_label(start: Column, width: int) -> Column:
    """``"0,1,2,3"`` for a window of four starting at slot 0."""
    return F.array_join(F.sequence(start, start + (width - 1)).cast("array<string>"), ",")
