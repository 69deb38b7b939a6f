"""Places in groups, quantiles, coordinate mapping and sampled distances."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripcast.durable import stored
from tripcast import joins
from tripcast.operators import distance, ranking, results


def test_positions_count_weights_before(frame):
    rng = random.Random(4)
    rows = [(rng.choice([None, "a", "b"]), v, rng.randint(1, 9)) for v in rng.sample(range(1000), 200)]
    df = frame("g string, v int, w int", *rows).repartition(7)
    got = {(r.g, r.v): (r.position, r.total, r.plain) for r in ranking.group_positions(
        ranking.group_positions(df, ["g"], ["v"], name="plain", total="rows"), ["g"], ["v"], "w").collect()}
    assert len(got) == len(rows)
    for g, v, _ in rows:
        own = [(x, w) for h, x, w in rows if h == g]
        assert got[g, v] == (sum(w for x, w in own if x < v), sum(w for _, w in own), sum(x < v for x, _ in own))


def test_quantiles_equal_the_exact_ones(frame):
    rng = random.Random(6)
    rows = [(None, 3.0), ("one", 5.5), ("none", None), ("nan", 1.0), ("nan", 2.0)] + [
        ("ties", float(rng.choice([1, 1, 1, 2, 7]))) for _ in range(101)] + [("wide", rng.random()) for _ in range(1000)]
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: (r.n, r.quantiles) for r in results.grouped_quantiles(
        frame("g string, v double", *rows), ["g"], "v", shares).collect()}
    assert set(got) == {None, "one", "nan", "ties", "wide"}
    for g, (n, q) in got.items():
        own = [v for h, v in rows if h == g]
        assert n == len(own) and np.allclose(q, np.quantile(own, shares), rtol=1e-12)


def test_quantiles_of_one_large_group_spread(spark):
    """No task orders more than a part of a group of 10^6 values."""
    df = spark.range(1_000_000, numPartitions=8).select(F.lit(1).alias("g"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")     # this is a small group after all
    placed = stored(results._value_positions(df, ["g"], "v"), "placed")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = placed.withColumn("p", F.input_file_name()).groupBy("p").count().toPandas()["count"]
    assert parts.sum() == placed.count() and parts.max() < 0.3 * parts.sum()
    q = results._quantiles(placed, ["g"], "v", [0.5]).first()
    values = np.array([r.v for r in df.select("v").collect()])
    assert q.n == 1_000_000 and q.quantiles[0] == np.quantile(values, 0.5)


def test_coordinates_are_put_in_order_once(spark, frame):
    real = frame("rid long, PU_longitude double, PU_latitude double", *[(i, float(i % 7), -float(i)) for i in range(40)])
    synth = frame("sid long, PU_longitude double, PU_latitude double, DO_longitude double, DO_latitude double",
                  *[(i, float(-i) if i % 5 else None, float(i % 3), 1.0, 2.0) for i in range(25)])
    stages = []
    original = ranking.group_positions
    try:
        ranking.group_positions = lambda *a, **k: stages.append(1) or original(*a, **k)
        got = {r.sid: r for r in ranking.quantile_map_coordinates(synth, real, "sid", "rid").collect()}
    finally:
        ranking.group_positions = original
    assert len(stages) == 2 and len(got) == 25
    for column, order in (("PU_longitude", sorted((i % 7, i) for i in range(40))), ("PU_latitude", sorted((-i, i) for i in range(40)))):
        own = sorted((r[column], r.sid) for r in synth.collect() if r[column] is not None)
        for place, (_, sid) in enumerate(own):
            assert got[sid][column] == order[place * 40 // len(own)][0]
        assert all(got[r.sid][column] is None for r in synth.collect() if r[column] is None)
    assert all(r.DO_longitude is None and r.DO_latitude is None for r in got.values())


POINTS = [(math.sin(i * 1.7) * i, (i * 37 % 101) / 7.0, 1 + i % 4) for i in range(150)]


def weighted_mean(points):
    total = n = 0
    for i, (x, y, w) in enumerate(points):
        n += w
        total += sum(w * v * math.hypot(x - a, y - b) for a, b, v in points[i + 1:])
    return total / (n * (n - 1) / 2)


def clusters_of(frame, copies):
    return frame("cluster int, x double, y double, n int", *[(c, *p) for c in range(copies) for p in POINTS])


def test_intervals_hold_the_mean_in_95_of_100_cases(frame):
    """Copies of one cluster have draws of their own."""
    mean = weighted_mean(POINTS)
    rows = distance.sampled_pair_distance(clusters_of(frame, 300), "cluster", ["x", "y"], 100, weight="n").collect()
    assert len(rows) == 300 and all(r.draws == 100 and r.n == sum(p[2] for p in POINTS) for r in rows)
    held = np.mean([r.low <= mean <= r.high for r in rows])
    assert 0.90 <= held <= 0.99
    assert abs(np.mean([r.mean_distance for r in rows]) / mean - 1) < 0.01      # no bias


def test_an_error_bound_is_met(frame):
    mean = weighted_mean(POINTS)
    rows = distance.sampled_pair_distance(clusters_of(frame, 30), "cluster", ["x", "y"], 60, error=0.02, weight="n").collect()
    assert np.mean([(r.high - r.low) / 2 <= 0.025 * r.mean_distance for r in rows]) > 0.9
    assert np.mean([abs(r.mean_distance / mean - 1) <= 0.02 for r in rows]) > 0.85


def test_small_clusters_are_measured_whole(frame):
    rows = [(1, 0.0, 0.0)] * 3 + [(1, 3.0, 4.0)] + [(2, 1.0, 1.0)] + [(3, 5.0, 5.0)] * 4
    got = {r.cluster: r for r in distance.sampled_pair_distance(
        frame("cluster int, x double, y double", *rows), "cluster", ["x", "y"], 10, clusters=range(1, 6), alone=None).collect()}
    assert got[1].mean_distance == got[1].low == got[1].high == 2.5 and got[1].draws == 0
    assert got[2].mean_distance is None and got[2].n == 1 and got[3].mean_distance == 0.0
    assert got[4].n == 0 and got[4].mean_distance is None


def test_a_point_with_a_third_of_all_members(frame):
    points = [(1, float(i), 0.0, 1) for i in range(200)] + [(1, 500.0, 0.0, 100)]
    exact = weighted_mean([p[1:] for p in points])
    r, = distance.sampled_pair_distance(frame("cluster int, x double, y double, n int", *points), "cluster", ["x", "y"],
                                        2000, weight="n").collect()
    assert r.draws >= 2000 and abs(r.mean_distance - exact) <= 2 * (r.high - r.mean_distance)


@pytest.mark.parametrize("draws, error", [(200, None), (None, 0.05)])
def test_compactness_with_drawn_pairs(frame, draws, error):
    from tripcast.plans import compactness

    trips = frame("trip_id long, tpep_pickup_datetime timestamp_ntz, PULocationID int, DOLocationID int, PU_longitude double, "
                  "PU_latitude double, DO_longitude double, DO_latitude double", *[
        (i, __import__("datetime").datetime(2024, 1, 1 + i % 9, i % 24, i % 60), 4, 4, i % 13 * 0.01, i % 7 * 0.02, i % 5 * 0.01, i % 11 * 0.03)
        for i in range(400)])
    options = dict(k=2, max_passes=4, zones=[4])
    whole = {r.cluster: r.mean_distance for r in compactness.cluster_distances(trips, **options).collect()}
    for r in compactness.cluster_distances(trips, draws=draws, error=error, **options).collect():
        assert abs(r.mean_distance - whole[r.cluster]) <= 1e-9 + 2 * (r.high - r.mean_distance)


def test_coordinates_are_mapped_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(joins, "TASK_ROWS", 50)
    rows = spark.range(500).selectExpr("id AS trip_id", *[f"CAST(id * {k + 1} % 501 AS DOUBLE) AS {c}" for k, c in enumerate(ranking.COORDINATES)])
    mapped = ranking.quantile_map_coordinates(rows, rows, "trip_id", "trip_id")
    assert mapped.rdd.getNumPartitions() == 40        # 2,000 values
    assert sorted(map(tuple, mapped.select(rows.columns).collect())) == sorted(map(tuple, rows.collect()))
