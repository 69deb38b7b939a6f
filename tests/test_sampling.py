import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripcast import joins
from tripcast.operators import dating, ranking, sampling
from tripcast.sources.trips import COORDINATES


def hot_hours(spark, n=9000):
    """One hour holds a third of all rows."""
    return spark.range(n).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 8).otherwise(F.col("id") % 24).cast("int").alias("hour"))


def counts(df, key="hour"):
    return {r[key]: r["n"] for r in df.groupBy(key).agg(F.count("*").alias("n")).collect()}


@pytest.mark.parametrize("partitions", [1, 7])
def test_exact_take_is_the_smallest_digests(spark, partitions):
    df = hot_hours(spark).repartition(partitions)
    plan = df.groupBy("hour").agg(F.count("*").alias("n")).withColumn("keep", F.floor(F.col("n") * 0.37))
    got = {(r["hour"], r["id"]) for r in sampling.take_exact(df, ["hour"], plan, "id", 9).collect()}
    import hashlib
    want = set()
    rows = df.collect()
    for h in {r["hour"] for r in rows}:
        ids = sorted((r["id"] for r in rows if r["hour"] == h), key=lambda i: hashlib.md5(f"9:{i}".encode()).hexdigest())
        want |= {(h, i) for i in ids[:int(len(ids) * 0.37)]}
    assert got == want


def test_hot_groups_apart_give_the_same(spark, monkeypatch):
    df = hot_hours(spark)
    plan = df.groupBy("hour").agg(F.count("*").alias("n")).withColumn("keep", F.floor(F.col("n") * 0.6))
    want = {r["id"] for r in sampling.take_exact(df, ["hour"], plan, "id", 9).collect()}
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 300)
    monkeypatch.setattr(joins, "HOT_ROWS", 1000)
    got = sampling.take_exact(df, ["hour"], plan, "id", 9)
    assert {r["id"] for r in got.collect()} == want and got.count() == len(want)


def test_take_edges(frame):
    df = frame("g int, id int", *[(g, 10 * (g or 0) + i) for g in (1, 2, 3, None) for i in range(5)])
    plan = frame("g int, n long, keep long", (1, 5, 0), (2, 5, 5), (None, 5, 2))
    assert counts(sampling.take_exact(df, ["g"], plan, "id", 1), "g") == {2: 5, None: 2}


def test_equal_frequency(spark):
    df = hot_hours(spark)
    goal = {8: 100, 1: 2000, 2: 5}
    real = spark.createDataFrame([(h, n) for h, n in goal.items()] + [(23, 7), (30, 9)], "hour int, trips long")
    got = sampling.equal_frequency(df.filter("hour <> 23"), real, "id", 4)
    assert counts(got) == goal
    assert got.select("id").distinct().count() == sum(goal.values())
    chosen = got.filter("hour = 8").collect()
    assert all("#" not in r["id"] for r in chosen)


def test_draws_reach_the_whole_group(spark):
    df = spark.range(50).select("id", F.lit(1).alias("hour"))
    real = spark.createDataFrame([(1, 5000)], "hour int, trips long")
    used = sampling.equal_frequency(df, real, "id", 4).select(F.split("id", "#")[0].alias("s")).groupBy("s").count().collect()
    assert len(used) == 50 and max(r["count"] for r in used) < 160


def test_perturbed_counts_stay_near(spark):
    before = counts(hot_hours(spark))
    after = counts(sampling.perturb_counts(hot_hours(spark), "id", 11))
    goal = {r["hour"]: r["goal"] for r in sampling.noisy_counts(
        hot_hours(spark).groupBy("hour").agg(F.count("*").alias("n")), 11).collect()}
    assert after == goal and after != before
    assert all(abs(after[h] - before[h]) <= 0.25 * before[h] + 1 for h in before)


def test_cap(frame):
    real = frame("PULocationID int, DOLocationID int, hour int, trips int", *[(1, 1, 1, 1)] * 5, *[(None, 1, 1, 1)] * 100)
    synth = frame("id int, PULocationID int, DOLocationID int, hour int, trips int",
                  *[(i, 1, 1, 1, 1) for i in range(20)], *[(100 + i, 2, 1, 1, 1) for i in range(3)],
                  *[(200 + i, None, 1, 1, 1) for i in range(4)])
    got = sampling.cap_groups(synth, real, "id", 1)
    assert counts(got, "PULocationID") == {1: 6, None: 4}
    hundred = frame("PULocationID int, DOLocationID int, hour int, trips int", *[(1, 1, 1, 1)] * 100)
    many = frame("id int, PULocationID int, DOLocationID int, hour int, trips int", *[(i, 1, 1, 1, 1) for i in range(300)])
    assert sampling.cap_groups(many, hundred, "id", 1).count() == 111     # ceil(100 * 1.1) in floating point


def test_even_days(frame):
    rows = [(i, dt.datetime(2024, 1, 1 + i % 4, 5)) for i in range(40)] + [(99, dt.datetime(2024, 1, 1, 6))]
    df = frame("id int, tpep_pickup_datetime timestamp_ntz", *rows)
    got = sampling.even_days(df, 10, "id", 3)
    assert got.count() == 40 and got.columns == df.columns
    with pytest.raises(Exception, match="too few trips"):
        sampling.even_days(df, 11, "id", 3).collect()


def test_shares(spark):
    assert sampling.sample_exact_share(spark.range(10), 0.25, "id", 1).count() == 2      # 2.5 rounds to even
    assert sampling.sample_exact_share(spark.range(10), 1.0, "id", 1).count() == 10
    assert abs(sampling.sample_share(spark.range(10000), 0.3, "id", 1).count() - 3000) < 200


def test_pairs(frame):
    pairs = frame("a int, b int", *[(i % 5, i % 3) for i in range(60)])
    assert sampling.sample_pairs(pairs, 4, ["a", "b"], 1).count() == 4
    assert sampling.sample_pairs(pairs, 99, ["a", "b"], 1).count() == 15


def test_dates_follow_the_real_shares(spark, frame):
    days = [dt.datetime(2024, 1, 1, 8)] * 30 + [dt.datetime(2024, 1, 2, 8)] * 10 + [dt.datetime(2024, 1, 5, 9)]
    p = dating.date_probabilities(frame("tpep_pickup_datetime timestamp_ntz", *[(d,) for d in days]))
    synth = spark.range(8000).select("id", F.lit(8).alias("hour"))
    got = counts(dating.assign_dates(synth, p, "id", 5), "date")
    assert got[dt.date(2024, 1, 1)] == pytest.approx(6000, abs=150) and sum(got.values()) == 8000
    night = synth.withColumn("hour", F.lit(3))
    assert set(counts(dating.assign_dates(night, p, "id", 5), "date")) == {dt.date(2024, 1, d) for d in (1, 2, 5)}
    assert dating.assign_dates(synth, p.limit(0), "id", 5).filter("date IS NOT NULL").count() == 0
    assert dating.stamp(synth, dating.DateLookup(p.limit(0)), "id", 5).count() == 0
    minutes = {r["m"] for r in dating.stamp(synth, dating.DateLookup(p), "id", 5).select(F.minute("tpep_pickup_datetime").alias("m")).distinct().collect()}
    assert minutes == {0, 15, 30, 45}


def test_quantile_map(frame):
    synth = frame("id int, x double", (1, 5.0), (2, 1.0), (3, 3.0), (4, None))
    real = frame("id int, x double", *[(i, v) for i, v in enumerate([10.0, 20.0, 30.0, 40.0, 50.0, 60.0, None])])
    got = {r["id"]: r["x"] for r in ranking.quantile_map(synth, real, "x", "id", "id").collect()}
    assert got == {1: 50.0, 2: 10.0, 3: 30.0, 4: None}
    empty = {r["id"]: r["x"] for r in ranking.quantile_map(synth, real.limit(0), "x", "id", "id").collect()}
    assert empty == {1: None, 2: None, 3: None, 4: None}


def test_global_rank_with_one_hot_value(spark):
    df = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") * 7 % 11).alias("x"))
    rows = ranking.global_rank(df.repartition(5), ["x", "id"]).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(6000))
    assert [(r["x"], r["id"]) for r in rows] == sorted((r["x"], r["id"]) for r in rows)


def test_jitter_spread(spark):
    df = spark.range(5000).select("id", *[F.lit(1.0).alias(c) for c in COORDINATES])
    moved = dating.jitter(df, "id", 2).select(*COORDINATES).toPandas().to_numpy()
    np.testing.assert_allclose(moved.std(0), 0.0005, rtol=0.05)
    assert abs(np.corrcoef(moved.T) - np.eye(4)).max() < 0.06


def test_draws_are_joined_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(joins, "TASK_ROWS", 50)
    rows = spark.range(600).selectExpr("id AS trip_id", "CAST(id % 3 AS INT) AS hour")
    goals = spark.createDataFrame([(h, 1000) for h in range(3)], "hour int, trips long")
    drawn = sampling.equal_frequency(rows, goals, "trip_id", 42)
    assert drawn.rdd.getNumPartitions() >= 3000 // 50
    assert {r["hour"]: r["count"] for r in drawn.groupBy("hour").count().collect()} == {0: 1000, 1: 1000, 2: 1000}
