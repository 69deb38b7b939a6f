import numpy as np
import pytest

from pyspark.sql import functions as F

from checks import fixtures as fx
from tripcast.operators import filters, mixture, sampling
from tripcast.operators.scaling import Scaler
from tripcast.plans import comparison, compactness, day_pairs, enrich, hour_model, series_models, zone_forecast
from tripcast.durable import new_folder
from tripcast.sources import sinks
from tripcast.sources.trips import ENRICHED_SCHEMA, read_trips

SF = "/root/testdata/sf0.001"


def test_enrich_files(spark):
    raw, out = new_folder(spark, "raw"), new_folder(spark, "enriched")
    sinks.write_parquet(fx.trips(spark, SF).drop("trip_id"), raw)
    enrich.enrich_files(spark, [raw], fx.zones(spark, SF), out)
    back = read_trips(spark, out, schema=ENRICHED_SCHEMA)
    assert back.count() == fx.trips(spark, SF).count() and back.filter("DO_longitude IS NULL").count() == 0


def test_day_pair_experiment(spark):
    rows = day_pairs.run(fx.enriched(spark, SF), ks=(2,), runs=1, epochs=(20, 40), multiplier=2, ridge=0.01, max_passes=4).collect()
    assert {(r["data_type"], r["epochs"], r["metric"]) for r in rows} == {
        (t, e, m) for t in ("real", "synthetic", "real+synthetic") for e in (20, 40) for m in ("R²", "MAE", "RMSE", "MAPE")}


def test_zone_forecast_is_repeatable(spark):
    args = dict(k=2, multiplier=1, trials=2, max_passes=3, ridge=0.01, fit_dates_on="train", rezone_real=False)
    run = lambda: sorted(map(tuple, zone_forecast.run(fx.enriched(spark, SF), fx.zones(spark, SF), **args).collect()))
    first = run()
    assert [r[0] for r in first] == ["real", "real+synthetic", "synthetic"]
    for a, b in zip(first, run()):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-9)


def test_compactness_reports_every_cluster(spark):
    rows = compactness.cluster_distances(
        fx.enriched(spark, SF), k=3, zones=list(range(25)), max_passes=4).orderBy("cluster").collect()
    assert [r["cluster"] for r in rows] == [0, 1, 2] and all(r["mean_distance"] >= 0 for r in rows)


def enriched_file(spark):
    """Written by one month with ids of 32 bits, one of 64."""
    paths = [new_folder(spark, "month"), new_folder(spark, "month")]
    t = fx.enriched(spark, SF).drop("trip_id")
    early = F.col("tpep_pickup_datetime") < F.lit("2024-01-16").cast("timestamp_ntz")
    sinks.write_parquet(t.filter(early), paths[0])
    sinks.write_parquet(
        t.filter(~early).withColumns({c: F.col(c).cast("long") for c in ("PULocationID", "DOLocationID")}), paths[1])
    return read_trips(spark, *paths, schema=ENRICHED_SCHEMA, row_id="trip_id"), t.count()


def test_months_of_other_types_and_row_ids(spark):
    rows, n = enriched_file(spark)
    assert rows.count() == n == rows.select("trip_id").distinct().count()
    assert rows.drop("trip_id").schema == ENRICHED_SCHEMA
    first = sorted(r[0] for r in sampling.sample_share(rows, 0.2, "trip_id", 3).select("trip_id").collect())
    assert first == sorted(r[0] for r in sampling.sample_share(rows, 0.2, "trip_id", 3).select("trip_id").collect())


def test_missing_column_fails_at_reading(spark):
    path = new_folder(spark, "short")
    sinks.write_parquet(fx.trips(spark, SF).drop("DOLocationID"), path)
    with pytest.raises(ValueError, match="DOLocationID"):
        read_trips(spark, path)


def test_workloads_run_from_files(spark):
    rows, n = enriched_file(spark)
    always = filters.Period("1990-01-01", "2100-01-01")
    assert compactness.cluster_distances(rows, k=2, zones=list(range(25)), max_passes=2).count() == 2
    assert hour_model.sweep(rows, ks=(2,), multiplier=1, max_passes=2, weekdays=(0, 6)).count() == 1
    assert series_models.run(
        rows, ks=(2,), multiplier=1, rates=(0.01,), epochs=(5,), max_passes=2, weekdays=(0, 6)).count() == 2
    assert day_pairs.run(rows, ks=(2,), runs=1, epochs=(5,), max_passes=2, period=always).count() == 12
    assert zone_forecast.run(
        rows, fx.zones(spark, SF), k=2, multiplier=1, trials=1, max_passes=2, period=always).count() == 3


def test_comparison_workload(spark):
    rows, n = enriched_file(spark)
    out = new_folder(spark, "comparison")
    always = filters.Period("1990-01-01", "2100-01-01")
    done = comparison.run(rows, fx.zones(spark, SF), out, k=3, multiplier=2, runs=2, max_passes=3, period=always)
    assert len(done) == 2
    for i, one in enumerate(done, 1):
        lost, drawn = one.lost.first()
        sums = one.table.agg(F.sum("real_trips"), F.sum("synth_trips")).first()
        assert 0 < sums[0] <= n and sums[1] == drawn - lost
        back = sinks.read_csv(spark, f"{out}/run={i}", one.table.schema)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, one.table.collect()))


def test_sweep_measures_all_mixtures_at_once(spark, frame):
    """As many jobs for three mixtures as for one, and the rows that each has alone."""
    import numpy as np

    from tripcast.operators import linear, mixture
    from tripcast.operators.scaling import Scaler

    rng = np.random.default_rng(8)
    rows = [(int(h), *map(float, c)) for h, c in zip(rng.integers(0, 24, 300), rng.normal([-73.9, 40.7, -73.8, 40.8], 0.05, (300, 4)))]
    train = frame("hour int, PU_longitude double, PU_latitude double, DO_longitude double, DO_latitude double", *rows)
    scaler = Scaler.fit(train, hour_model.FEATURES)
    scaled = scaler.transform(train)
    products = {p: linear.Products.collect(scaled, hour_model.COORDINATES, "hour") for p in ("train", "val")}
    cells = [(k, mixture.Mixture(np.full(k, 1 / k), rng.normal(0, 1, (k, 5)), np.stack([np.eye(5)] * k))) for k in (2, 3, 5)]
    sc, jobs = spark.sparkContext, []

    def measured(some):
        sc.setJobGroup(f"cells-{len(jobs)}", "")
        out = hour_model.measure(some, train, scaled, products, scaler, 400, 42, 10).toPandas()
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"cells-{len(jobs)}")))
        return out
    try:
        together = measured(cells)
        alone = [measured([cell]) for cell in cells]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert together["n_clusters"].tolist() == [2, 3, 5]
    for i, one in enumerate(alone):
        assert np.allclose(together.iloc[[i]].to_numpy(float), one.to_numpy(float), rtol=1e-9, atol=1e-12)
    assert max(jobs) - min(jobs) <= 1


def test_day_pair_cells_share_their_jobs(spark):
    """Every cell has the rows it has alone, and more cells take no more jobs."""
    import numpy as np

    from tripcast.operators import dating, demand, mixture
    from tripcast.operators.scaling import Scaler

    real = fx.real(spark, SF)
    features = filters.MIXTURE_FEATURES
    scaler = Scaler.fit(filters.complete(real, features), features)
    hours, lookup = demand.trips_per_hour(real), dating.DateLookup(dating.date_probabilities(real))
    counted = demand.day_hours(real).select("date", "slot", "trips")
    rng = np.random.default_rng(2)
    cells = [(k, 40 + k + t, mixture.Mixture(np.full(k, 1 / k), rng.normal(0, 1, (k, 6)), np.stack([np.eye(6)] * k)))
             for k in (2, 3) for t in range(2)]
    sc, jobs = spark.sparkContext, []

    def result(some):
        sc.setJobGroup(f"pairs-{len(jobs)}", "")
        drawn = day_pairs.synthetic_counts(spark, some, scaler, 1500, hours, lookup)
        out = day_pairs.train_cells(counted, drawn, (5, 20)).collect()
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"pairs-{len(jobs)}")))
        return {(r.data_type, r.nc, r.seed, r.epochs, r.metric): r.value for r in out}
    try:
        together, one, last = result(cells), result(cells[:1]), result(cells[-1:])
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len({k[1:3] for k in together}) == 4
    for alone, (k, seed, _) in ((one, cells[0]), (last, cells[-1])):
        assert set(alone) == {key for key in together if key[1:3] == (k, seed)} and len(alone) >= 2 * 2 * 4
        assert all(abs(together[key] - v) <= 1e-9 * max(1, abs(v)) for key, v in alone.items() if v is not None)
    assert max(jobs) - min(jobs) <= 1


def test_drawn_trips_are_summed_without_a_filter_that_repeats_the_draw(spark, monkeypatch):
    model = mixture.Mixture(np.full(2, 0.5), np.zeros((2, 5)), np.stack([np.eye(5)] * 2))
    monkeypatch.setattr(hour_model, "stored", lambda df, label: df)
    sums = hour_model.drawn_sums(spark, [(2, model)], 500, Scaler(hour_model.FEATURES, [12.0] * 5, [5.0] * 5), 42)
    plan = sums._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan
    drawn = mixture.draw(spark, model, 500, hour_model.FEATURES, 44).toPandas()
    got = sums.toPandas()
    assert got["n"].sum() == 500 and np.isclose(got["y_y"].sum(), (drawn["hour"] ** 2).sum())
