import datetime as dt

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tripcast.functions import hashing, timecols as tc, vectors


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def at(text):
    return F.lit(text).cast("timestamp_ntz")


def test_slots(spark):
    got = one(spark, *[tc.slot_of(at(f"2024-01-01 {t}")) for t in ("00:14:59", "00:15:00", "23:59:59.999999")])
    assert got == (0, 1, 95)


def test_floor_keeps_null_and_drops_fractions(spark):
    got = one(spark, tc.floor_to_slot(at("2024-01-01 10:29:59.999")), tc.floor_to_slot(F.lit(None).cast("timestamp_ntz")))
    assert got == (dt.datetime(2024, 1, 1, 10, 15), None)


def test_decode_undoes_encode(spark):
    hours = spark.range(24).select(F.col("id").cast("int").alias("h"))
    s, c = tc.cyclic_hour(F.col("h"))
    assert hours.select("h", tc.decode_hour(s, c).alias("d")).filter("h <> d").count() == 0


def test_weekday_and_iso_week(spark):
    assert one(spark, tc.weekday_of(at("2024-12-30")), tc.iso_week_key(at("2024-12-30")),
               tc.iso_week_key(at("2021-01-03"))) == (0, "2025-01", "2020-53")


def test_day_numbers(spark):
    day, ordinal = F.lit("2024-02-29").cast("date"), dt.date(2024, 2, 29).toordinal()
    number = tc.day_number(day)
    got = one(spark, number, *[tc.date_from_day_number(number + x) for x in (0.5, -0.5, 1.5, 0.4)])
    assert got == (ordinal, *[dt.date.fromordinal(round(ordinal + x)) for x in (0.5, -0.5, 1.5, 0.4)])


def test_rebuilt_times_may_leave_the_day(spark):
    day = F.lit("2024-01-01").cast("date")
    assert one(spark, tc.at_time(day, 24), tc.at_time(day, -1), tc.at_time(day, 3, 45)) == (
        dt.datetime(2024, 1, 2), dt.datetime(2023, 12, 31, 23), dt.datetime(2024, 1, 1, 3, 45))


def test_window_label(spark):
    assert one(spark, tc.window_label(F.lit(3), 4)) == ("3,4,5,6",)


def test_growth_weighting(spark):
    weighted = lambda xs: one(spark, *vectors.growth_weighting([F.lit(float(x)) for x in xs]))
    assert weighted([2, 4, 8, 16]) == (2, 8, 32, 128)
    np.testing.assert_allclose(weighted([0, 3, 3, 3]), (0, 9000, 9000, 9000))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(-100, 100), min_size=2, max_size=12), st.sampled_from([1, 3, 5, 25]))
def test_moving_average_matrix(values, kernel):
    x, reach = np.array(values), (kernel - 1) // 2
    padded = np.concatenate([np.repeat(x[0], reach), x, np.repeat(x[-1], reach)])
    want = [padded[i:i + kernel].mean() for i in range(len(x))]
    np.testing.assert_allclose(vectors.moving_average_matrix(len(x), kernel) @ x, want, atol=1e-9)


def test_trend_and_rest_add_up(spark):
    xs = [F.lit(float(v)) for v in (1, 5, 2, 8)]
    trend, rest = vectors.trend_and_rest(xs, 3)
    assert np.allclose(one(spark, *[t + r for t, r in zip(trend, rest)]), (1, 5, 2, 8))


def test_hash_numbers_look_random(spark):
    rows = spark.range(20000).select(
        hashing.uniform(1, F.col("id")).alias("u"), *[
            z.alias(f"z{i}") for i, z in enumerate(hashing.gaussians(hashing.digest(1, F.col("id"))))]).toPandas()
    assert 0 <= rows["u"].min() and rows["u"].max() < 1 and abs(rows["u"].mean() - 0.5) < 0.01
    z = rows[["z0", "z1", "z2", "z3"]].to_numpy()
    np.testing.assert_allclose(z.mean(0), 0, atol=0.03)
    np.testing.assert_allclose(np.cov(z.T), np.eye(4), atol=0.04)
