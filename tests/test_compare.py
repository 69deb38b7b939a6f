import numpy as np
import pytest

from tripcast.operators import compare


def column(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "x double")


@pytest.mark.parametrize("seed", range(3))
def test_histograms_match_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    a, b = (rng.integers(0, 24, 300), rng.integers(3, 20, 500)) if seed else (rng.normal(size=300), rng.normal(1, 2, 500))
    lo, hi = min(a.min(), b.min()), max(a.max(), b.max())
    edges = np.linspace(lo, hi, 51)
    p, q = (np.histogram(v, edges, density=True)[0] for v in (a, b))
    density = compare.densities(column(spark, a), column(spark, b), "x")
    got = density.orderBy("bin").toPandas()
    np.testing.assert_allclose(got["d_real"], p)
    np.testing.assert_allclose(got["d_synth"], q)
    p, q = np.where(p == 0, 1e-8, p), np.where(q == 0, 1e-8, q)
    row = compare.divergence(density).first()
    assert row["kl"] == pytest.approx(np.sum(p * np.log(p / q)))
    assert row["wd"] == pytest.approx(np.abs(np.cumsum(p) - np.cumsum(q)).sum())


def test_equal_values_have_no_density(spark):
    rows = compare.densities(column(spark, [2, 2]), column(spark, [2]), "x").orderBy("bin").collect()
    assert rows[-1]["n_real"] == 2 and rows[-1]["d_real"] is None and rows[0]["n_real"] == 0


def test_hours_without_real_trips(spark):
    real = spark.createDataFrame([(1, 2)], "hour int, trips int")
    synth = spark.createDataFrame([(1, 3), (5, 1)], "hour int, trips int")
    rows = {r["hour"]: r for r in compare.compare_hours(real, synth).collect()}
    assert len(rows) == 24 and rows[1]["diff_pct"] == 50 and rows[5]["diff_pct"] is None and rows[7]["synth_trips"] == 0


def test_gap_without_real_trips(spark):
    some = spark.createDataFrame([(2,)], "trips int")
    assert compare.total_gap(some, some.limit(0)).first()["gap"] == 0
    assert compare.total_gap(some, some).first()["gap"] == 0
