import numpy as np
import pytest
from pyspark.sql import functions as F

from tripcast.functions.vectors import moving_average_matrix
from tripcast.operators import distance, linear, metrics, mixture, results
from tripcast.operators.scaling import Scaler, scale_parameters

XY = ["x", "y"]


def planted(spark, n=4000, seed=0):
    rng = np.random.default_rng(seed)
    side = rng.uniform(size=n) < 0.3
    points = np.where(side[:, None], rng.normal([4, 4], [0.5, 1.0], (n, 2)), rng.normal([-3, 0], [1.0, 0.4], (n, 2)))
    return points, spark.createDataFrame(points.tolist(), "x double, y double")


def test_fold_is_exact(spark):
    df = spark.createDataFrame([(1.0, 2.0)] * 3 + [(0.0, 1.0), (None, 1.0)], "x double, y double")
    folded = mixture.fold_points(df, XY)
    assert sorted(tuple(r) for r in folded.collect()) == [(0.0, 1.0, 1), (1.0, 2.0, 3)]
    model = mixture.Mixture(np.array([.4, .6]), np.array([[0., 0], [1, 1]]), np.array([np.eye(2)] * 2))
    whole = df.dropna().withColumn("n", F.lit(1))
    one, two = (mixture._gather(p, XY, [model])[0] for p in (folded, whole))
    np.testing.assert_allclose(one[0], two[0]) and np.testing.assert_allclose(one[1], two[1])


@pytest.mark.parametrize("kind", ["full", "diag"])
def test_planted_mixture_is_found(spark, kind):
    points, df = planted(spark)
    model = mixture.fit_mixture(mixture.fold_points(df, XY), XY, 2, 1e-6, kind, max_passes=60, tolerance=1e-6)
    order = np.argsort(model.means[:, 0])
    np.testing.assert_allclose(model.weights[order], [0.7, 0.3], atol=0.03)
    np.testing.assert_allclose(model.means[order], [[-3, 0], [4, 4]], atol=0.1)
    np.testing.assert_allclose(np.diagonal(model.covariances[order], axis1=1, axis2=2), [[1, .16], [.25, 1]], atol=0.15)


def test_likelihood_never_falls(spark):
    _, df = planted(spark, 800, 5)
    model = mixture.fit_mixture(mixture.fold_points(df, XY), XY, 4, 0.0, max_passes=15, tolerance=-1)
    assert len(model.history) == 15 and (np.diff(model.history) > -1e-6).all()


def test_sums_match_numpy(spark):
    points, df = planted(spark, 500, 2)
    model = mixture.Mixture(
        np.array([.5, .5]), np.array([[-1., 0], [2, 1]]), np.array([[[2, .3], [.3, 1]], [[1, -.2], [-.2, 3]]]))
    sums, likelihood = mixture._gather(mixture.fold_points(df, XY).repartition(5), XY, [model])[0]
    dens = np.stack([
        w * np.exp(-.5 * np.einsum("ni,ij,nj->n", points - m, np.linalg.inv(c), points - m))
        / (2 * np.pi * np.sqrt(np.linalg.det(c))) for w, m, c in zip(model.weights, model.means, model.covariances)], 1)
    share = dens / dens.sum(1, keepdims=True)
    assert likelihood == pytest.approx(np.log(dens.sum(1)).sum())
    np.testing.assert_allclose(sums[:, 0], share.sum(0))
    np.testing.assert_allclose(sums[:, 1:3], share.T @ points)
    np.testing.assert_allclose(sums[:, 3:].reshape(2, 2, 2), np.einsum("nk,ni,nj->kij", share, points, points))
    labels = mixture.assign_clusters(df, XY, model).toPandas()
    np.testing.assert_array_equal(labels["cluster"], [dens[i].argmax() for i in range(500)])


def test_parameter_counts():
    assert mixture.parameter_count(2, 3, "full") == 19 and mixture.parameter_count(2, 3, "diag") == 13
    with pytest.raises(ValueError):
        mixture.parameter_count(2, 3, "tied")
    with pytest.raises(ValueError):
        mixture.Candidate(2, kind="spherical")


def test_selection_prefers_the_right_size(spark):
    _, df = planted(spark)
    chosen = mixture.select_mixture(
        mixture.fold_points(df, XY), XY, [mixture.Candidate(k, 1e-6) for k in (1, 2)], 40, 1e-6)
    assert chosen.best.k == 2 and chosen.runs.count() == 2
    one = chosen.runs.filter("k = 1").first()
    np.testing.assert_allclose(one["bic"], 5 * np.log(4000) - 2 * one["log_likelihood"])


def test_draws_have_the_moments_and_survive_a_table(spark):
    model = mixture.Mixture(
        np.array([.25, .75]), np.array([[0., 0, 0, 0, 0], [5, 1, 2, 3, 4]]),
        np.array([np.eye(5), np.diag([1., 2, 3, 4, 5]) + .5]))
    back = mixture.Mixture.from_rows(model.to_table(spark).collect())
    drawn = mixture.draw(spark, back, 30000, list("abcde"), 3).toPandas()
    assert len(drawn) == 30000 and drawn["sample_id"].nunique() == 30000
    assert (drawn["component"] == 1).mean() == pytest.approx(0.75, abs=0.01)
    mine = drawn.loc[drawn["component"] == 1, list("abcde")].to_numpy()
    np.testing.assert_allclose(mine.mean(0), model.means[1], atol=0.06)
    np.testing.assert_allclose(np.cov(mine.T), model.covariances[1], atol=0.2)


def test_scaler(spark):
    df = spark.createDataFrame([(1.0, 7.0, 1), (3.0, 7.0, 3)], "a double, b double, n int")
    plain = {r["feature"]: (r["mean"], r["scale"]) for r in scale_parameters(df, ["a", "b"]).collect()}
    assert plain == {"a": (2.0, 1.0), "b": (7.0, 1.0)}
    weighted = Scaler.fit(df, ["a"], weight="n")
    assert weighted.means == [2.5] and weighted.scales[0] == pytest.approx(np.sqrt(0.75))
    there = weighted.inverse(weighted.transform(df)).select("a").collect()
    assert [r["a"] for r in there] == [1.0, 3.0]
    with pytest.raises(ValueError):
        Scaler.fit(df.limit(0), ["a"])


@pytest.mark.parametrize("block", [3, 8, 5000])
def test_pair_distance_against_loops(spark, block):
    rng = np.random.default_rng(1)
    points = np.vstack([rng.normal(size=(40, 3)), np.repeat(rng.normal(size=(1, 3)), 30, 0), [[9, 9, 9]]])
    cluster = [0] * 25 + [1] * 15 + [0] * 30 + [2]          # cluster 0: thirty copies of one point
    df = spark.createDataFrame([(c, *map(float, p)) for c, p in zip(cluster, points)], "cluster int, a double, b double, c double")
    got = {r["cluster"]: r["mean_distance"] for r in distance.mean_pair_distance(df, "cluster", list("abc"), 0.0, range(4), block).collect()}
    for c in (0, 1):
        mine = points[[i for i, k in enumerate(cluster) if k == c]]
        gaps = [np.linalg.norm(a - b) for i, a in enumerate(mine) for b in mine[i + 1:]]
        assert got[c] == pytest.approx(np.mean(gaps))
    assert got[2] == 0.0 and got[3] == 0.0
    alone = {r["cluster"]: r["mean_distance"] for r in distance.mean_pair_distance(df, "cluster", list("abc"), None).collect()}
    assert alone[2] is None and len(alone) == 3


def test_pair_distance_golden(spark):
    df = spark.createDataFrame([(0, 0.0), (0, 3.0), (0, 6.0)], "cluster int, a double")
    assert distance.mean_pair_distance(df, "cluster", ["a"]).first()["mean_distance"] == 4


# ---- linear models ----

def regression(n=60, width=4, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(3, 2, (n, width))
    return x, x @ rng.normal(size=width) + 1.5 + rng.normal(0, .3, n)


def products(spark, x, y):
    names = [f"x{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], ", ".join(f"{c} double" for c in [*names, "y"]))
    return linear.Products.collect(df, names, "y")


def adam(grad, parameters, rate, epochs):
    """The optimiser on raw gradients, for comparison."""
    m, v = np.zeros_like(parameters), np.zeros_like(parameters)
    for t in range(1, epochs + 1):
        g = grad(parameters)
        m, v = .9 * m + .1 * g, .999 * v + .001 * g * g
        parameters = parameters - rate * (m / (1 - .9 ** t)) / (np.sqrt(v / (1 - .999 ** t)) + 1e-8)
    return parameters


def test_path_equals_descent_on_the_rows(spark):
    x, y = regression()
    z = np.hstack([x, np.ones((len(x), 1))])
    start = linear.initial_weights(4, 1, 7)
    p = products(spark, x, y)
    path = linear.gradient_path(p, p, start, 0.01, [5, 80])
    for e in (5, 80):
        want = adam(lambda w: 2 / len(y) * z.T @ (z @ w - y[:, None]), start, 0.01, e)
        np.testing.assert_allclose(path.at[e], want, rtol=1e-8)
    assert path.val_loss[-1] == pytest.approx(np.mean((z @ path.at[80] - y[:, None]) ** 2))
    np.testing.assert_allclose(p.least_squares()[:, 0], np.linalg.lstsq(z, y, rcond=None)[0], rtol=1e-8)
    assert p.r2(p.least_squares()) > 0.9


def test_products_add(spark):
    (x, y), (a, b) = regression(seed=1), regression(seed=2)
    both = products(spark, np.vstack([x, a]), np.concatenate([y, b]))
    added = products(spark, x, y) + products(spark, a, b)
    np.testing.assert_allclose(added.zz, both.zz)
    np.testing.assert_allclose(added.sse(np.ones((5, 1))), both.sse(np.ones((5, 1))))


def test_early_stop_restores_the_best(spark):
    (x, y), (a, b) = regression(seed=1), regression(seed=9)
    train, val = products(spark, x, y), products(spark, a, b)
    start = train.least_squares() + 0.3
    best = linear.gradient_path(train, val, start, 0.05, [500], patience=10, min_delta=1e-4)
    last = linear.gradient_path(train, val, start, 0.05, [500], patience=10, min_delta=1e-4, restore="last")
    assert len(best.val_loss) < 500
    assert val.mse(best.at[500]) <= min(best.val_loss) + 1e-4 and val.mse(last.at[500]) == pytest.approx(best.val_loss[-1])


def test_decomposed_path_equals_two_heads(spark):
    width, outputs, kernel, epochs = 6, 1, 3, 40
    x, y = regression(50, width)
    p = products(spark, x, y)
    path = linear.decomposed_path(p, p, 3, 0.01, [epochs], kernel)
    smooth = moving_average_matrix(width, kernel)
    trend = x @ smooth.T
    z = np.hstack([x - trend, np.ones((50, 1)), trend, np.ones((50, 1))])
    start = np.vstack([linear.initial_weights(width, outputs, 3), linear.initial_weights(width, outputs, 4)])
    heads = adam(lambda w: 2 / 50 * z.T @ (z @ w - y[:, None]), start, 0.01, epochs)
    one = np.hstack([x, np.ones((50, 1))])
    np.testing.assert_allclose(one @ path.at[epochs], z @ heads, rtol=1e-8)


def test_several_models_in_one_pass(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "x0 double, x1 double")
    got = linear.score_models(spark, df, ["x0", "x1"], {("a", 1): [1, 1, 0], ("b", 2): [0, 2, .5]}, ["kind", "epochs"])
    assert sorted((r["kind"], r["epochs"], r["predicted"]) for r in got.collect()) == [("a", 1, 3.0), ("b", 2, 4.5)]


# ---- metrics and results ----

def accuracy(spark, pairs):
    return metrics.accuracy(spark.createDataFrame(pairs, "y double, p double"), "y", "p").first()


def test_metric_goldens(spark):
    assert accuracy(spark, [(0.0, 1.0), (2.0, 3.0)])["mape"] == pytest.approx(50)
    assert accuracy(spark, [(1.0, 1.0), (1.0, 3.0)])["smape"] == pytest.approx(50, abs=1e-5)
    got = accuracy(spark, [(1.0, 1.1), (2.0, 1.9), (3.0, 3.5)])
    assert got["r2"] == pytest.approx(0.865) and got["rmse"] == pytest.approx(np.sqrt(0.09))
    assert accuracy(spark, [(1.0, 5.0)])["r2"] is None
    assert accuracy(spark, [(1.0, 1.0), (1.0, 1.0)])["r2"] == 1 and accuracy(spark, [(1.0, 1.0), (1.0, 2.0)])["r2"] == 0
    assert accuracy(spark, [(0.0, 1.0), (0.0, 2.0)])["mape"] is None
    assert accuracy(spark, [(1e-12, 1.0), (0.0, 2.0)])["mape"] is None


def test_front(spark):
    trials = spark.createDataFrame(
        [("s", 0, .5, 10.), ("s", 1, .6, 12.), ("s", 2, .5, 9.), ("s", 3, .6, 12.), ("s", 4, .4, 9.), ("s", 5, None, 1.), ("t", 6, .1, 99.)],
        "study string, trial int, r2 double, smape double")
    front = {r["trial"] for r in results.pareto_front(trials, ["study"]).collect()}
    assert front == {1, 2, 3, 6}


def test_best_run_ignores_infinite_values(spark):
    runs = spark.createDataFrame(
        [(0, float("-inf"), 1.), (1, 5., 2.), (2, 5., 1.), (3, float("nan"), 0.), (4, None, 0.)], "id int, bic double, aic double")
    assert results.best_by_information(runs).first()["id"] == 2


def test_box_statistics(spark):
    values = [1., 2., 3., 4., 100.]
    rows = spark.createDataFrame([("m", 1, 1, "real", v) for v in values], "metric string, nc int, epochs int, data_type string, value double")
    got = results.box_statistics(rows).first()
    assert (got["q1"], got["median"], got["q3"], got["low"], got["high"], got["outliers"]) == (2, 3, 4, 1, 4, 1)


def test_start_weighs_every_point(spark):
    from tripcast.operators import mixture

    rng = np.random.default_rng(8)
    rare, heavy = rng.normal(0, 1, (495, 2)), rng.normal(50, 1, (5, 2))
    rows = [(*map(float, x), 1) for x in rare] + [(*map(float, x), 100_000) for x in heavy]
    points = spark.createDataFrame(rows, "a double, b double, n long")
    split = spark.createDataFrame(
        [r for r in rows if r[2] == 1] + [(a, b, 25_000) for a, b, n in rows if n > 1 for _ in range(4)],
        "a double, b double, n long").repartition(5)
    one, two = (
        mixture.fit_mixture(p, ["a", "b"], 3, max_passes=1, seed=4) for p in (points, split))
    assert np.allclose(one.means, two.means) and np.allclose(one.weights, two.weights)
    assert one.weights[np.linalg.norm(one.means, axis=1) > 40].sum() > 0.99
    assert not one.converged and mixture.fit_mixture(points, ["a", "b"], 2, seed=4).converged


def test_centres_are_drawn_by_weight_and_distance(spark):
    from tripcast.operators import mixture

    points = spark.createDataFrame([(0.0, 1), (1.0, 6), (3.0, 3)], "x double, n long").coalesce(1)
    first = [mixture.spread_centres(points, ["x"], 1, s)[0, 0] for s in range(60)]
    assert 22 <= first.count(1.0) <= 50 and first.count(0.0) < first.count(3.0) + 8
    assert len(set(mixture.spread_centres(points, ["x"], 3, 1)[:, 0])) == 3
    assert len(mixture.spread_centres(points, ["x"], 5, 1)) == 5


def _blobs(frame, many=12):
    rng = np.random.default_rng(3)
    middles = rng.uniform(-20, 20, (many, 2))
    rows = [(float(x), float(y), int(n)) for m in middles for (x, y), n in zip(rng.normal(m, 1, (40, 2)), rng.integers(1, 5, 40))]
    return frame("x double, y double, n long", *rows)


def test_oversampled_starts_are_no_worse_than_drawn_ones(frame):
    points = _blobs(frame)
    candidates = [mixture.Candidate(8, 1e-3, "full", s) for s in range(10)]
    ends = {
        start: np.median([ll for _, ll in mixture.fit_mixtures(points, XY, candidates, 4, -1.0, start=start)])
        for start in ("oversampled", "drawn")}
    assert ends["oversampled"] >= ends["drawn"]


def test_candidates_take_as_many_jobs_for_any_number(spark, frame):
    points = _blobs(frame)
    sc = spark.sparkContext

    def jobs(name, draws):
        sc.setJobGroup(name, name)
        found = mixture.draw_candidates(points, XY, draws)
        return len(sc.statusTracker().getJobIdsForGroup(name)), found

    try:
        few, _ = jobs("few", {1: 2})
        many, found = jobs("many", {1: 60, 2: 5, 3: 7})
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert few == many
    assert {s: len(x) for s, x in found.items()} == {s: 1 + mixture.DRAW_ROUNDS * n for s, n in ((1, 60), (2, 5), (3, 7))}
    assert all(len(np.unique(x, axis=0)) == len(x) for x in found.values())
    again = mixture.draw_candidates(points.repartition(5), XY, {2: 5})
    assert np.array_equal(again[2], found[2])


def test_candidates_run_out(frame):
    """Three distinct points: all are found once, and more centres than points repeat."""
    points = frame("x double, y double, n long", (0.0, 0.0, 5), (1.0, 0.0, 1), (0.0, 9.0, 2))
    assert len(mixture.draw_candidates(points, XY, {1: 10})[1]) == 3
    centres, = mixture.oversampled_centres(points, XY, [mixture.Candidate(5)], 1)
    assert centres.shape == (5, 2) and np.isfinite(centres).all()
    model = mixture.fit_mixture(points, XY, 5, 1e-3, max_passes=3)
    assert np.isfinite(model.means).all() and abs(model.weights.sum() - 1) < 1e-9


def test_joint_density_of_far_points():
    """The common origin keeps degrees of longitude exact; strips join."""
    rng = np.random.default_rng(1)
    spread = np.array([np.cov(rng.normal(size=(3, 50))) * 1e-4 + 1e-6 * np.eye(3) for _ in range(4)])
    model = mixture.Mixture(np.full(4, 0.25), rng.normal([-73.9, 40.7, 12], 0.01, (4, 3)), spread)
    x = rng.normal([-73.9, 40.7, 12], 0.02, (500, 3))
    want = np.empty((500, 4))
    for c in range(4):
        gap = x - model.means[c]
        want[:, c] = np.log(0.25) - 0.5 * np.linalg.slogdet(2 * np.pi * spread[c])[1] - 0.5 * np.einsum(
            "ni,ij,nj->n", gap, np.linalg.inv(spread[c]), gap)
    assert np.allclose(model.joint(x), want, rtol=1e-9, atol=1e-7)


def test_small_blocks_send_a_point_to_few_groups(spark):
    points = spark.range(3000).selectExpr("1 AS cluster", "CAST(id AS DOUBLE) AS a", "CAST(id % 7 AS DOUBLE) AS b", "1D AS w")
    sent = []
    plain = distance._tiles
    try:
        distance._tiles = lambda *args: sent.append(plain(*args)) or sent[0]
        row = distance.pair_sums(points, "cluster", ["a", "b"], block=2).first()
    finally:
        distance._tiles = plain
    x = np.array([(i, i % 7) for i in range(3000)], float)
    want = sum(np.sqrt(((x[i + 1:] - x[i]) ** 2).sum(1)).sum() for i in range(2999))
    assert row["n"] == 3000 and abs(row["total"] - want) < 1e-9 * want
    assert sent[0].count() <= 3000 * distance.SPLIT       # 1,500 blocks asked for


def test_pair_sums_of_close_points_far_from_the_origin():
    rng = np.random.default_rng(5)
    near = 1e6 + np.repeat(rng.normal(size=(40, 3)), 5, axis=0) + rng.normal(0, 1e-6, (200, 3))
    w = rng.integers(1, 4, 200).astype(float)
    want = sum(w[i] * w[j] * np.sqrt(((near[i] - near[j]) ** 2).sum()) for i in range(200) for j in range(200))
    assert abs(distance._tile_sum(near, w, near, w) - want) < 1e-12 * want
    few = near[:5]
    close = sum(np.sqrt(((p - q) ** 2).sum()) for p in few for q in few)
    assert abs(distance._tile_sum(few, np.ones(5), few, np.ones(5)) - close) < 1e-12 * close
