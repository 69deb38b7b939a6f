import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripcast.operators import splits, windows


def series(frame, values, per_day=10):
    start = dt.date(2024, 1, 1)
    return frame("date date, slot int, trips long", *[
        (start + dt.timedelta(days=i // per_day), i % per_day, int(v)) for i, v in enumerate(values)])


@pytest.mark.parametrize("block", [4, 5, 7, 1000])
@pytest.mark.parametrize("n,width", [(10, 4), (23, 3), (4, 4), (3, 4)])
def test_sliding_windows(frame, n, width, block):
    values = np.arange(n) ** 2
    got = windows.sliding_windows(windows.with_position(series(frame, values)), width=width, block=block)
    rows = [tuple(r) for r in got.orderBy("pos").collect()]
    assert rows == [(i, *map(float, values[i:i + width + 1])) for i in range(max(0, n - width))]


def test_chronological_split_truncates(frame):
    w = windows.sliding_windows(windows.with_position(series(frame, range(13))))
    parts = [r["part"] for r in windows.chronological_split(w).orderBy("pos").collect()]
    assert parts == ["train"] * 6 + ["val"] * 3


def test_zone_windows_count(frame):
    grid = frame("slot_ts timestamp_ntz, slot int, zone string, trips int", *[
        (dt.datetime(2024, 1, 1) + dt.timedelta(minutes=15 * i), i, z, i * k) for i in range(20) for k, z in enumerate("ab")])
    got = windows.zone_windows(grid, 8, 1)
    assert got.count() == 12 * 3 and got.filter("channel = 'slot' AND y0 IS NULL").count() == 12
    row = got.filter("channel = 'b'").orderBy("slot_ts").first()
    assert [row[f"x{k}"] for k in range(8)] == list(range(8)) and row["y0"] == 8


def test_day_pairs_against_loops(frame):
    rng = np.random.default_rng(3)
    data = {}
    for day in (1, 2, 4, 5, 9):                       # days 3, 6, 7, 8 are absent
        for slot in range(12):
            if rng.uniform() < 0.85:
                data[dt.date(2024, 1, day), slot] = int(rng.integers(1, 9))
    got = windows.day_pairs(frame("date date, slot int, trips long", *[(d, s, v) for (d, s), v in data.items()]), 3)
    want = []
    days = sorted({d for d, _ in data})
    for a, b in zip(days, days[1:]):
        for s in range(12 - 3):
            need = range(s, s + 4)
            if all((d, k) in data for d in (a, b) for k in need):
                row = [a, b, s, ",".join(map(str, range(s, s + 3)))]
                for k in range(s, s + 3):
                    row += [data[a, k], data[b, k]]
                want.append((*row, data[a, s + 3], data[b, s + 3]))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def weeks(frame, sizes):
    monday = dt.datetime(2024, 1, 1)
    return frame("tpep_pickup_datetime timestamp_ntz, id int", *[
        (monday + dt.timedelta(weeks=w, hours=i), 100 * w + i) for w, n in enumerate(sizes) for i in range(n)])


def test_weekly_split(frame):
    df = weeks(frame, [3, 3, 3, 3, 2])
    parts = splits.week_parts(splits.week_sizes(df)).orderBy("week").collect()
    assert [p["part"] for p in parts] == ["train", "train", "val", "hold", "hold"]
    assert splits.split_by_weeks(df).groupBy("part").count().orderBy("part").collect()[0]["count"] == 5


def test_first_week_too_large_leaves_training_empty(frame):
    parts = splits.week_parts(splits.week_sizes(weeks(frame, [9, 1]))).orderBy("week").collect()
    assert [p["part"] for p in parts] == ["hold", "hold"]


def test_random_parts_cover_everything(spark):
    rows = splits.random_parts(spark.range(20000), "id", 5)
    share = {r["part"]: r["n"] / 20000 for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert share["test"] == pytest.approx(0.15, abs=0.01) and share["val"] == pytest.approx(0.1275, abs=0.01)


@pytest.mark.parametrize("name", ["a5_demand_grid", "w1_sliding_windows", "w2_zone_windows", "w3_day_pairs"])
def test_trips_are_read_once(spark, name):
    from checks import all_queries

    reads = all_queries()[0][name](spark, "/root/testdata/sf0.001").inputFiles()
    assert reads and not any("events" in f for f in reads)      # only the stored counts are read again
