"""Trip counts by time and place.

Counts are sums over built-in aggregates, so each task reduces its own rows to
one per key before the shuffle and a hot zone or hour costs no more than a
quiet one. Demand stays long, ``(slot_ts, zone, trips)``; one column per zone is
made only on export.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripcast.durable import stored
from tripcast.functions import timecols as tc
from tripcast.joins import spread
from tripcast.operators.zoning import require_known_zones
from tripcast.sources.trips import DROPOFF_ZONE, PICKUP_TIME, PICKUP_ZONE


def trips_per(df: DataFrame, keys: Sequence[str], trips: str = "trips") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(trips).cast("long").alias("trips"))


def rows_per(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def trips_per_hour(df: DataFrame) -> DataFrame:
    return trips_per(df, ["hour"])


def day_slots(df: DataFrame, ts: str = PICKUP_TIME, trips: str = "trips") -> DataFrame:
    """Trips per date and quarter hour, with the slot's own timestamp."""
    keyed = df.select(
        tc.date_of(F.col(ts)).alias("date"), tc.slot_of(F.col(ts)).alias("slot"),
        F.col(trips).alias("trips"),
    )
    out = trips_per(keyed, ["date", "slot"])
    return out.withColumn("slot_ts", tc.at_time(F.col("date"), 0, F.col("slot") * tc.SLOT_MINUTES))


def day_slot_matrix(counts: DataFrame, slots: int = tc.SLOTS_PER_DAY, prefix: str = "s") -> DataFrame:
    """Counts of ``day_slots`` (or, with 24 slots, of ``day_hours``) as one row a date and
    one column a slot, ``s0`` on; a slot that nothing was counted in is null. The columns are
    named beforehand, so no pass looks for them."""
    wide = counts.groupBy("date").pivot("slot", list(range(slots))).agg(F.first("trips"))
    return wide.select("date", *[F.col(str(i)).alias(f"{prefix}{i}") for i in range(slots)])


def day_hours(
    df: DataFrame, ts: str = PICKUP_TIME, trips: str = "trips", by: Sequence[str] = ()
) -> DataFrame:
    """The hourly form: trips per date and hour; ``slot`` is the hour. ``by`` tells sets of
    trips apart."""
    keyed = df.select(
        *by, tc.date_of(F.col(ts)).alias("date"), tc.hour_of(F.col(ts)).alias("slot"),
        F.col(trips).alias("trips"),
    )
    out = trips_per(keyed, [*by, "date", "slot"])
    return out.withColumn("slot_ts", tc.at_time(F.col("date"), F.col("slot")))


def zone_demand(
    df: DataFrame, zone: str = "pu_zone", ts: str = PICKUP_TIME, trips: str = "trips"
) -> DataFrame:
    """Trips per quarter hour and zone; trips without a zone are left out."""
    keyed = df.filter(F.col(zone).isNotNull()).select(
        tc.floor_to_slot(F.col(ts)).alias("slot_ts"), F.col(zone).alias("zone"),
        F.col(trips).alias("trips"),
    )
    return trips_per(keyed, ["slot_ts", "zone"])


def part_demand(
    df: DataFrame, part: str = "part", zone: str = "pu_zone", ts: str = PICKUP_TIME, trips: str = "trips"
) -> DataFrame:
    """``zone_demand`` of several parts of the trips, in one pass."""
    keyed = df.filter(F.col(zone).isNotNull()).select(
        F.col(part), tc.floor_to_slot(F.col(ts)).alias("slot_ts"), F.col(zone).alias("zone"), F.col(trips).alias("trips"))
    return trips_per(keyed, [part, "slot_ts", "zone"])


def slot_grid(demand: DataFrame, zones: DataFrame, only_observed_days: bool = False) -> DataFrame:
    """Every quarter hour from the first to the last, for every zone.

    Zones times days are spread over the tasks before each is multiplied into its
    96 slots.
    """
    span = demand.agg(
        F.struct(F.min("slot_ts").alias("first"), F.max("slot_ts").alias("last")).alias("span")
    ).scalar()
    first, last = F.col("span.first"), F.col("span.last")
    by_day = (
        zones.select("ord", "zone", span.alias("span"))
        .withColumn("date", F.explode(F.sequence(first.cast("date"), last.cast("date"))))
    )
    if only_observed_days:
        seen = demand.select(F.to_date("slot_ts").alias("date")).distinct()
        by_day = by_day.join(seen, "date", "left_semi")
    slot = F.explode(F.sequence(F.lit(0), F.lit(tc.SLOTS_PER_DAY - 1)))
    return (
        spread(by_day, "zone", "date").withColumn("slot", slot)
        .withColumn("slot_ts", tc.at_time(F.col("date"), 0, F.col("slot") * tc.SLOT_MINUTES))
        .filter(F.col("slot_ts").between(first, last))
        .select("slot_ts", "slot", "ord", "zone")
    )


def demand_grid(
    demand: DataFrame, zones: DataFrame, only_observed_days: bool = False, strict: bool = True
) -> DataFrame:
    """Demand on the dense grid, zero where nothing was counted.

    Days the data skips are part of the grid unless ``only_observed_days``. A zone
    that the dimension lacks fails the job; unless ``strict``, its demand is left out.
    The demand is counted and stored when this is called, as the grid reads it twice.
    """
    demand = stored(demand, "demand")
    grid = slot_grid(demand, zones, only_observed_days)
    if strict:
        demand = require_known_zones(demand, zones, "zone")
    joined = grid.join(demand, ["zone", "slot_ts"], "left")
    return joined.select(
        "slot_ts", "slot", "ord", "zone",
        F.coalesce("trips", F.lit(0)).cast("int").alias("trips"),
    )


def zone_columns(grid: DataFrame, zone_names: Sequence[str]) -> DataFrame:
    """Export form: one row per slot, one column per zone, in the given order."""
    return grid.groupBy("slot_ts").pivot("zone", list(zone_names)).agg(F.first("trips"))


def od_hour_trips(
    df: DataFrame, pickup: str = PICKUP_ZONE, dropoff: str = DROPOFF_ZONE, trips: str = "trips"
) -> DataFrame:
    """Trips per pickup zone, drop-off zone and hour; trips without a zone are
    left out."""
    known = df.filter(F.col(pickup).isNotNull() & F.col(dropoff).isNotNull())
    return trips_per(known, [pickup, dropoff, "hour"], trips)


def od_trips(df: DataFrame, pickup: str = PICKUP_ZONE, dropoff: str = DROPOFF_ZONE) -> DataFrame:
    known = df.filter(F.col(pickup).isNotNull() & F.col(dropoff).isNotNull())
    return trips_per(known, [pickup, dropoff])


def od_matrix(
    od: DataFrame, dropoffs: Sequence, pickup: str = PICKUP_ZONE, dropoff: str = DROPOFF_ZONE
) -> DataFrame:
    """Pickup rows by drop-off columns, zero where no trip went."""
    wide = od.groupBy(pickup).pivot(dropoff, list(dropoffs)).agg(F.sum("trips"))
    return wide.fillna(0)


def od_submatrix(
    od: DataFrame, pairs: DataFrame, pickup: str = PICKUP_ZONE, dropoff: str = DROPOFF_ZONE
) -> DataFrame:
    """The long form of the matrix over the pickups and drop-offs of some
    sampled pairs: every combination, zero where no trip went.

    ``pairs`` is a small sample, so its drop-offs fit one array per pickup.
    """
    ends = pairs.agg(F.array_sort(F.collect_set(dropoff)).alias("ends")).select("ends").scalar()
    cells = (
        pairs.select(pickup).distinct()
        .select(pickup, F.explode(ends).alias(dropoff))
    )
    return cells.join(od, [pickup, dropoff], "left").fillna(0, ["trips"])


def od_pairs(df: DataFrame, pickup: str = PICKUP_ZONE, dropoff: str = DROPOFF_ZONE) -> DataFrame:
    return df.select(pickup, dropoff).distinct()


def fewest_daily_trips(df: DataFrame, ts: str = PICKUP_TIME) -> DataFrame:
    """One row: the smallest number of trips on any day present."""
    per_day = rows_per(df.select(tc.date_of(F.col(ts)).alias("date")), ["date"])
    return per_day.agg(F.min("n").alias("min_trips"))


def add_series(*series: DataFrame, keys: Sequence[str] = ("date", "slot")) -> DataFrame:
    """Union of counted series, summed again per key."""
    union = series[0]
    for other in series[1:]:
        union = union.unionByName(other)
    return trips_per(union, list(keys))
