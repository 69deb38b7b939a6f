"""Streaming demand: late trips, restarts and the watermark."""

import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tripcast.durable import new_folder
from tripcast.streaming import demand as stream

SCHEMA = "tpep_pickup_datetime timestamp_ntz, pu_zone string, trips int"
NOON = datetime(2024, 1, 1, 12)


def trip(minutes, zone="a", trips=1):
    return (NOON + timedelta(minutes=minutes), zone, trips)


@pytest.fixture
def arrivals(spark):
    """A folder of trip files and a function that adds one."""
    folder = new_folder(spark, "arrivals")

    def add(*rows):
        spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.parquet(f"{folder}/{uuid.uuid4().hex}")
    return folder, add


def count(spark, folder, out, **options):
    schema = spark.createDataFrame([], SCHEMA).schema
    stream.count_available(stream.read_trip_files(spark, f"{folder}/*", schema, 1), out, **options)
    return {((r.slot_ts - NOON) // timedelta(minutes=1), r.zone): (r.trips, r.late) for r in stream.read_demand(spark, out).collect()}


def test_late_trips_are_counted_apart(spark, arrivals):
    folder, add = arrivals
    add(trip(0), trip(14.9), trip(15), trip(0, "b"), trip(0, None), (None, "a", 1))
    add(trip(240, trips=3))                       # the watermark passes 15:00 when this trigger ends,
    add(trip(242))                                # and this one closes the slots before it
    add(trip(5), trip(5, "b", 2), trip(7, "c"))   # three hours late
    add(trip(185, "a"), trip(241))                # late by less than the hour
    got = count(spark, folder, new_folder(spark, "counts"))
    assert got == {(0, "a"): (2, 1), (15, "a"): (1, 0), (0, "b"): (1, 2), (0, "c"): (0, 1), (180, "a"): (1, 0), (240, "a"): (5, 0)}


def test_a_longer_delay_accepts_them(spark, arrivals):
    folder, add = arrivals
    add(trip(0))
    add(trip(240))
    add(trip(242))
    add(trip(5))
    assert count(spark, folder, new_folder(spark, "counts"), delay="1 day") == {(0, "a"): (2, 0), (240, "a"): (2, 0)}


def test_a_restart_goes_on(spark, arrivals):
    """Open slots outlive the first run; files already counted are not counted again."""
    folder, add = arrivals
    out = new_folder(spark, "counts")
    add(trip(0), trip(1))
    assert count(spark, folder, out) == {(0, "a"): (2, 0)}
    add(trip(2), trip(90))
    assert count(spark, folder, out) == {(0, "a"): (3, 0), (90, "a"): (1, 0)}
    assert count(spark, folder, out) == {(0, "a"): (3, 0), (90, "a"): (1, 0)}
    add(trip(3))       # the watermark stands at 12:30
    assert count(spark, folder, out) == {(0, "a"): (3, 1), (90, "a"): (1, 0)}


def test_slots_do_not_hang_on_the_session_zone(spark, arrivals):
    folder, add = arrivals
    add(trip(0), trip(20))
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kathmandu")      # 5 h 45 min
        assert count(spark, folder, new_folder(spark, "counts")) == {(0, "a"): (1, 0), (15, "a"): (1, 0)}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_closed_slots_leave_the_state(spark, arrivals):
    """The state holds open slots only, however many were counted."""
    folder, add = arrivals
    out = new_folder(spark, "counts")
    for hour in range(0, 12, 3):
        add(*[trip(60 * hour + 15 * k, z) for k in range(4) for z in "abc"])
    schema = spark.createDataFrame([], SCHEMA).schema
    queries = stream.start_demand(stream.read_trip_files(spark, f"{folder}/*", schema, 1), out, availableNow=True)
    for query in queries:
        query.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in queries[0].recentProgress if p["stateOperators"]]
    assert max(states) <= 24 and stream.read_demand(spark, out).count() == 48
    # after the last trigger the four slots of the newest hour are open
    assert spark.read.format("statestore").load(f"{out}/_accepted_log").filter(F.col("value").isNotNull()).count() == 12
