"""Counts on streams, read from files that are written one after the other."""

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.fixtures import given
from checks.registry import query, text
from tripcast.durable import new_folder
from tripcast.operators import demand, zoning
from tripcast.streaming import demand as stream

FILES = 4


def arriving(spark, sf, label):
    """The trips with their zone names, in files by time of arrival, and their schema."""
    named = zoning.name_zones(fx.trips(spark, sf), fx.zones(spark, sf)).withColumn("trips", F.lit(1))
    first, last = named.agg(F.min("tpep_pickup_datetime"), F.max("tpep_pickup_datetime")).first()
    step = (last - first) / FILES
    folder = new_folder(spark, label)
    for k in range(FILES):
        at = F.col("tpep_pickup_datetime")
        low = at >= F.lit(first + k * step) if k else F.lit(True)
        high = at < F.lit(first + (k + 1) * step) if k < FILES - 1 else F.lit(True)
        named.filter(low & high).coalesce(1).write.parquet(f"{folder}/file={k}")
    return folder, named.schema


@query("a3_stream_zone_demand", given("zone_demand", """
SELECT CAST(slot_ts AS VARCHAR) AS slot_ts, zone, CAST(trips AS BIGINT) AS trips, CAST(0 AS BIGINT) AS late FROM zone_demand"""))
def _(spark, sf):
    files, schema = arriving(spark, sf, "arriving")
    out = new_folder(spark, "stream")
    stream.count_available(stream.read_trip_files(spark, f"{files}/*", schema, 1), out)
    return stream.read_demand(spark, out).select(text("slot_ts"), "zone", "trips", "late")


@query("a5_stream_demand_grid", given("grid", """
SELECT CAST(slot_ts AS VARCHAR) AS slot_ts, slot, ord, zone, trips FROM grid"""))
def _(spark, sf):
    files, schema = arriving(spark, sf, "arriving")
    out = new_folder(spark, "stream")
    stream.count_available(stream.read_trip_files(spark, f"{files}/*", schema, 1), out)
    grid = demand.demand_grid(stream.read_demand(spark, out).drop("late"), fx.zones(spark, sf))
    return grid.select(text("slot_ts"), "slot", "ord", "zone", "trips")
