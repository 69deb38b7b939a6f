import datetime as dt

import numpy as np
import pytest
from pyspark.errors import PySparkException

from tripcast import joins
from tripcast.operators import demand, filters, zoning
from tripcast.sources import sinks, trips as trip_source, zones as zone_source
from tripcast.durable import new_folder

ZONES = "ord int, zone_id int, zone string, cx double, cy double, minx double, maxx double, miny double, maxy double"


@pytest.fixture
def zones(frame):
    box = lambda *v: v[:3] + tuple(map(float, v[3:]))
    return frame(ZONES, box(0, 10, "A", 1, 1, 0, 2, 0, 2), box(1, 20, "B", 2, 2, 1, 3, 1, 3), box(2, 30, "C", 9, 9, 8, 10, 8, 10))


def test_last_box_wins_and_edges_are_closed(frame, zones):
    points = frame("id int, x double, y double", (1, 0.5, 0.5), (2, 1.5, 1.5), (3, 1.0, 1.0), (4, 2.0, 0.0),
                   (5, 3.0, 3.0), (6, 5.0, 5.0), (7, None, 1.0), (8, 10.0, 10.0), (9, 1e18, -1e18))
    got = zoning.BoxIndex(zones).locate(points, "x", "y", "zid", "zone").orderBy("id").collect()
    assert [r["zone"] for r in got] == ["A", "B", "B", "A", "B", None, None, "C", None]


def test_location_without_broadcast_is_the_same(frame, zones, monkeypatch):
    rng = np.random.default_rng(0)
    points = frame("id int, x double, y double", *[(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(-1, 11, (500, 2)))])
    one = zoning.BoxIndex(zones).locate(points, "x", "y", "zid", "zone").orderBy("id").collect()
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    two = zoning.BoxIndex(zones, grid=5).locate(points, "x", "y", "zid", "zone").orderBy("id").collect()
    assert one == two
    boxes = [r.asDict() for r in zones.orderBy("ord").collect()]
    for row in one:
        want = None
        for b in boxes:
            if b["minx"] <= row["x"] <= b["maxx"] and b["miny"] <= row["y"] <= b["maxy"]:
                want = b["zone_id"]
        assert row["zid"] == want


def test_centroids_of_repeated_zone_take_the_last(frame, zones):
    again = zones.unionByName(frame(ZONES, (9, 10, "A2", 7.0, 7.0, 0.0, 1.0, 0.0, 1.0)))
    trips = frame("PULocationID int, DOLocationID int", (10, 20), (99, None))
    got = zoning.attach_centroids(trips, again).orderBy("PULocationID").collect()
    assert [tuple(r) for r in got] == [(10, 20, 7.0, 7.0, 2.0, 2.0), (99, None, None, None, None, None)]


def test_unknown_zones_are_listed_or_refused(frame, zones):
    rows = frame("pu_zone string", ("A",), ("X",), (None,))
    assert [r["zone"] for r in zoning.unknown_zones(rows, zones).collect()] == ["X"]
    with pytest.raises(PySparkException, match="zone not in the dimension: X"):
        zoning.require_known_zones(rows, zones).collect()
    wide = zoning.require_known_zones(rows.selectExpr("*", "1 AS hour"), zones)
    for use in (wide.count, wide.groupBy("hour").count().collect, wide.select("hour").collect):
        with pytest.raises(PySparkException, match="zone not in the dimension: X"):
            use()
    assert zoning.require_known_zones(rows.filter("pu_zone = 'A' OR pu_zone IS NULL"), zones).count() == 2


def test_geometry_with_hole(frame):
    ring = lambda zone, r, pts: [(zone, r, i, float(x), float(y)) for i, (x, y) in enumerate(pts)]
    outer = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    hole = [(0, 0), (0, 2), (2, 2), (2, 0), (0, 0)]     # the other way round
    triangle = [(-74, 40), (-71, 40), (-74, 43), (-74, 40)]
    vertices = frame("zone_id int, ring int, seq int, lon double, lat double",
                     *ring(1, 0, outer), *ring(1, 1, hole), *ring(2, 0, triangle))
    got = {r["zone_id"]: r for r in zone_source.zone_geometry(vertices).collect()}
    assert got[1]["cx"] == pytest.approx((16 * 2 - 4 * 1) / 12) and got[1]["maxx"] == 4
    assert (got[2]["cx"], got[2]["cy"]) == pytest.approx((-73, 41))


def test_zone_names_keep_file_order(frame, spark):
    path = new_folder(spark, "names")
    sinks.write_csv(frame("LocationID int, zone string", (7, "A, B"), (3, "C"), (5, "D")).coalesce(1), path)
    got = zone_source.read_zone_names(spark, path).orderBy("ord").collect()
    assert [tuple(r) for r in got] == [(0, 7, "A, B"), (1, 3, "C"), (2, 5, "D")]


def test_missing_columns_fail_early(frame):
    with pytest.raises(ValueError, match="hour"):
        trip_source.require_columns(frame("a int", (1,)), ["a", "hour"])


def at(text):
    return dt.datetime.fromisoformat(text)


def trips(frame, *rows):
    return frame("tpep_pickup_datetime timestamp_ntz, pu_zone string, trips int", *rows)


def test_grid_fills_every_slot_and_zone(frame, zones):
    t = trips(frame, (at("2024-01-03 23:50:00"), "A", 1), (at("2024-01-03 23:59:59"), "A", 2),
              (at("2024-01-04 00:20:00"), "B", 1), (at("2024-01-04 00:20:00"), None, 5))
    grid = demand.demand_grid(demand.zone_demand(t), zones)
    rows = grid.orderBy("slot_ts", "ord").collect()
    assert len(rows) == 3 * 3 and sum(r["trips"] for r in rows) == 4
    assert [r["slot"] for r in rows[::3]] == [95, 0, 1] and rows[0]["trips"] == 3
    wide = demand.zone_columns(grid, ["A", "B", "C"]).orderBy("slot_ts").collect()
    assert [tuple(r)[1:] for r in wide] == [(3, 0, 0), (0, 0, 0), (0, 1, 0)]


def test_grid_of_observed_days(frame, zones):
    t = trips(frame, (at("2024-01-01 12:00:00"), "A", 1), (at("2024-01-05 12:00:00"), "A", 1))
    counted = demand.zone_demand(t)
    assert demand.demand_grid(counted, zones).count() == (4 * 96 + 1) * 3
    assert demand.demand_grid(counted, zones, only_observed_days=True).count() == (48 + 49) * 3


def test_od_leaves_out_trips_without_zone(frame):
    t = frame("PULocationID int, DOLocationID int, hour int, trips int", (1, 2, 3, 1), (1, 2, 3, 1), (None, 2, 3, 1))
    assert [tuple(r) for r in demand.od_hour_trips(t).collect()] == [(1, 2, 3, 2)]
    wide = demand.od_matrix(demand.od_trips(t), [2, 4]).collect()
    assert [tuple(r) for r in wide] == [(1, 2, 0)]


def test_submatrix_has_every_combination(frame):
    od = frame("PULocationID int, DOLocationID int, trips long", (1, 2, 5), (3, 4, 7), (1, 4, 9))
    pairs = frame("PULocationID int, DOLocationID int", (1, 2), (3, 4))
    got = sorted(tuple(r) for r in demand.od_submatrix(od, pairs).collect())
    assert got == [(1, 2, 5), (1, 4, 9), (3, 2, 0), (3, 4, 7)]


def test_filters(frame):
    t = frame("tpep_pickup_datetime timestamp_ntz, PULocationID int, DOLocationID int",
              (at("2024-01-01 00:00:00"), 1, 2), (at("2024-01-04 10:00:00"), 1, 3), (at("2024-03-04 10:00:00"), 2, 2))
    assert filters.study_period(t).count() == 1
    assert filters.study_period(t, filters.Period("2023-01-01", "2023-01-02")).count() == 0
    assert filters.of_zone(t, 1, 2).count() == 2 and filters.of_zone(t, None, 2).count() == 2
    lost = filters.trips_without_zone(
        frame("pu string, do string, trips int", ("a", "b", 2), ("", "b", 3), (None, "b", 4)), "pu", "do").first()
    assert tuple(lost) == (7, 9)


def test_same_join_matches_nulls(frame):
    a, b = frame("k int, x int", (None, 1), (2, 3)), frame("k int, y int", (None, 5), (4, 6))
    assert [tuple(r) for r in joins.join_same(a, b, ["k"]).collect()] == [(None, 1, 5)]


def test_period_filter_reaches_the_scan(spark, frame):
    path = new_folder(spark, "trips")
    sinks.write_parquet(frame("tpep_pickup_datetime timestamp_ntz, PULocationID int, DOLocationID int",
                              (at("2024-01-01 00:00:00"), 1, 2)), path)
    df = filters.study_period(trip_source.read_trips(spark, path)).select("PULocationID")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(tpep_pickup_datetime" in plan and "DOLocationID" not in plan
