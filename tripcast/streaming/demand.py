"""Demand per quarter hour and zone, counted as trips arrive.

The counts are a streaming aggregation: one state per open (slot, zone), reduced in each
task before the shuffle, and dropped by the trigger after the watermark has passed the slot's end. Trips of
a dropped slot come too late to change it; they are counted apart, as all trips of the slot
less those accepted. Every trigger writes its rows to a folder named after it, so a trigger
that is run again after a failure replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from tripcast.functions import timecols as tc
from tripcast.operators.demand import trips_per
from tripcast.sources.trips import PICKUP_TIME

DELAY = "1 hour"       # how much older than the newest trip seen a trip may be


def read_trip_files(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Trip files as a stream, the oldest first; files that arrive later are read later."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def _instant(ts: Column) -> Column:
    """Watermarks need instants: the wall clock of a trip, taken as UTC."""
    origin = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", origin, tc.parse_timestamp(ts)))


def _wall_clock(instant: Column) -> Column:
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.lit("1970-01-01").cast("timestamp_ntz"))


def stream_zone_demand(
    trips: DataFrame, zone: str = "pu_zone", ts: str = PICKUP_TIME, count: str = "trips", delay: str = DELAY,
) -> DataFrame:
    """``slot_ts, zone, trips`` as a streaming aggregation, for any sink. Trips without a
    zone or a time are left out, as are those of slots that the watermark has closed."""
    known = trips.filter(F.col(zone).isNotNull() & F.col(ts).isNotNull()).select(
        _instant(F.col(ts)).alias("at"), F.col(zone).alias("zone"), F.col(count).alias("trips")).withWatermark("at", delay)
    slot = F.window("at", f"{tc.SLOT_MINUTES} minutes").alias("slot")
    return known.groupBy(slot, "zone").agg(F.sum("trips").cast("long").alias("trips")).select(
        _wall_clock(F.col("slot.start")).alias("slot_ts"), "zone", "trips")


def _to_folder(folder: str) -> Callable[[DataFrame, int], None]:
    def write(rows: DataFrame, trigger: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/trigger={trigger}")
    return write


def start_demand(
    trips: DataFrame, folder: str, zone: str = "pu_zone", ts: str = PICKUP_TIME, count: str = "trips",
    delay: str = DELAY, **trigger,
) -> list[StreamingQuery]:
    """Start counting into ``folder``, which all executors share; with the same folder a
    later start goes on where the last one ended. ``trigger`` is Spark's, for example
    ``availableNow=True``. Two queries run: accepted counts as they change, and the plain
    counts of each trigger's trips, which hold no state."""
    accepted = stream_zone_demand(trips, zone, ts, count, delay)
    known = trips.filter(F.col(zone).isNotNull() & F.col(ts).isNotNull())
    arrived = known.select(tc.floor_to_slot(F.col(ts)).alias("slot_ts"), F.col(zone).alias("zone"), F.col(count).alias("trips"))

    def write_arrived(rows: DataFrame, number: int) -> None:
        _to_folder(f"{folder}/arrived")(trips_per(rows, ["slot_ts", "zone"]), number)

    return [
        accepted.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/_accepted_log")
        .foreachBatch(_to_folder(f"{folder}/accepted")).trigger(**trigger).start(),
        arrived.writeStream.option("checkpointLocation", f"{folder}/_arrived_log")
        .foreachBatch(write_arrived).trigger(**trigger).start(),
    ]


def count_available(trips: DataFrame, folder: str, **options) -> None:
    """Count all that has arrived and stop."""
    for query in start_demand(trips, folder, availableNow=True, **options):
        query.awaitTermination()


def read_demand(spark: SparkSession, folder: str) -> DataFrame:
    """``slot_ts, zone, trips, late``: accepted trips and those that came too late. The
    count of a slot only grows, so its last update is its largest."""
    accepted = spark.read.parquet(f"{folder}/accepted").groupBy("slot_ts", "zone").agg(F.max("trips").alias("trips"))
    arrived = spark.read.parquet(f"{folder}/arrived").groupBy("slot_ts", "zone").agg(F.sum("trips").alias("arrived"))
    trips = F.coalesce("trips", F.lit(0)).cast("long")
    return arrived.join(accepted, ["slot_ts", "zone"], "left").select(
        "slot_ts", "zone", trips.alias("trips"), (F.col("arrived") - trips).alias("late"))
