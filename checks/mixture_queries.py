"""Scaling, mixtures and cluster distances."""

import numpy as np
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.fixtures import SEED, given, u_sql, z_sql
from checks.registry import long, query, r6
from checks.source_queries import PAIR_SQL, labelled
from tripcast.operators import distance, filters, mixture, results, scaling
from tripcast.plans import compactness, settings

FEATURES = filters.MIXTURE_FEATURES
RIDGE = 0.001


def complete(spark, sf):
    return filters.complete(fx.real(spark, sf), FEATURES)


@query("a11_scale_parameters", given("reals", "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg({c}), 6) + 0.0 AS mean, round(stddev_pop({c}), 6) AS scale FROM reals WHERE PU_longitude IS NOT NULL"
    for c in FEATURES)))
def _(spark, sf):
    p = scaling.scale_parameters(complete(spark, sf), FEATURES)
    return p.select("feature", (F.round("mean", 6) + F.lit(0.0)).alias("mean"), r6("scale"))


@query("m1_scale_and_back", given("reals", """+
k AS (SELECT * FROM reals WHERE PU_longitude IS NOT NULL)
SELECT trip_id, """ + ", ".join(
    f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) + 0.0 AS {c}_scaled, round({c}, 6) + 0.0 AS {c}_back"
    for c in FEATURES) + " FROM k"))
def _(spark, sf):
    rows = complete(spark, sf)
    s = scaling.Scaler.fit(rows, FEATURES)
    scaled = s.transform(rows).withColumns({f"{c}_scaled": F.col(c) for c in FEATURES})
    return s.inverse(scaled).select(
        "trip_id", *[(F.round(f"{c}_scaled", 6) + F.lit(0.0)).alias(f"{c}_scaled") for c in FEATURES],
        *[(F.round(c, 6) + F.lit(0.0)).alias(f"{c}_back") for c in FEATURES])


@query("m1_fold_points", given("reals", """
SELECT hour, round(PU_longitude, 6) AS lon, round(PU_latitude, 6) AS lat, count(*) AS n FROM reals WHERE PU_longitude IS NOT NULL GROUP BY ALL"""))
def _(spark, sf):
    points = mixture.fold_points(fx.real(spark, sf), ["hour", "PU_longitude", "PU_latitude"])
    return points.select(F.col("hour").cast("int").alias("hour"), r6("PU_longitude", "lon"), r6("PU_latitude", "lat"), "n")


def mixture_from_labels(df, label, features, kind, ridge=RIDGE):
    """A mixture whose components are the labels: shares, means, covariances."""
    spreads = [
        F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features)
        if i == j or kind == "full"]
    rows = df.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)], *spreads
    ).orderBy(label).collect()   # one row per label
    d, total = len(features), sum(r["n"] for r in rows)
    cov = np.array([[[r[f"c{i}_{j}"] if i == j or kind == "full" else 0.0 for j in range(d)] for i in range(d)] for r in rows])
    return mixture.Mixture(
        np.array([r["n"] / total for r in rows]), np.array([[r[f"m{i}"] for i in range(d)] for r in rows]),
        cov + ridge * np.eye(d), kind)


# Weekday components over the real trips, diagonal covariances: plain SQL can follow each step.
_D = range(len(FEATURES))


def _components(features, label, rows, ridge=RIDGE):
    means = ", ".join(f"avg({c}) AS m{i}" for i, c in enumerate(features))
    spreads = ", ".join(f"var_pop({c}) + {ridge} AS v{i}" for i, c in enumerate(features))
    return f"(SELECT {label} AS c, count(*) / (SELECT count(*) FROM {rows}) AS w, {means}, {spreads} FROM {rows} GROUP BY 1)"


def _joint(features, alias="r"):
    terms = " ".join(
        f"- 0.5 * ln(2 * pi() * p.v{i}) - 0.5 * ({alias}.{c} - p.m{i}) * ({alias}.{c} - p.m{i}) / p.v{i}" for i, c in enumerate(features))
    return f"ln(p.w) {terms}"


_SCORED = f"""+
rows AS (SELECT trip_id, weekday, {', '.join(FEATURES)} FROM reals WHERE PU_longitude IS NOT NULL AND DO_longitude IS NOT NULL),
p AS {_components(FEATURES, 'weekday', 'rows')},
j AS (SELECT r.trip_id, p.c, {_joint(FEATURES)} AS lp FROM rows r CROSS JOIN p),
t AS (SELECT trip_id, max(lp) + ln(sum(exp(lp - mx))) AS ll FROM (SELECT *, max(lp) OVER (PARTITION BY trip_id) AS mx FROM j) x GROUP BY trip_id)
"""


def weekday_mixture(spark, sf):
    return mixture_from_labels(complete(spark, sf), "weekday", FEATURES, "diag")


def _updated(spark, sf, model, points, features, ridge):
    """The mixture after one pass, as rows (component, weight, means, variances)."""
    sums = mixture.expected_sums(points, features, [model]).filter(F.col("component") >= 0)
    wide = sums.groupBy("component").pivot("pos", list(range(1 + 2 * len(features)))).agg(F.first("value"))
    d = len(features)
    mean = lambda i: F.col(f"`{1 + i}`") / F.col("`0`")
    total = points.agg(F.sum("n")).scalar()
    return wide.select(
        long("component"), r6(F.col("`0`") / total, "weight"), *[(F.round(mean(i), 6) + F.lit(0.0)).alias(f"m{i}") for i in range(d)],
        *[r6(F.col(f"`{1 + d + i}`") / F.col("`0`") - mean(i) * mean(i) + F.lit(ridge), f"v{i}") for i in range(d)])


@query("m2_expectation_pass_diag", given("reals", _SCORED + f"""
, s AS (SELECT r.*, j.c, exp(j.lp - t.ll) AS g FROM rows r JOIN j USING (trip_id) JOIN t USING (trip_id))
SELECT CAST(c AS BIGINT) AS component, round(sum(g) / (SELECT count(*) FROM rows), 6) AS weight,
  {', '.join(f'round(sum(g * {c}) / sum(g), 6) + 0.0 AS m{i}' for i, c in enumerate(FEATURES))},
  {', '.join(f'round(sum(g * {c} * {c}) / sum(g) - (sum(g * {c}) / sum(g)) * (sum(g * {c}) / sum(g)) + {RIDGE}, 6) AS v{i}' for i, c in enumerate(FEATURES))}
FROM s GROUP BY c"""))
def _(spark, sf):
    points = mixture.fold_points(complete(spark, sf), FEATURES)
    return _updated(spark, sf, weekday_mixture(spark, sf), points, FEATURES, RIDGE)


_LINES = ["qty", "price"]


def _lines(spark, sf):
    return fx.table(spark, sf, "lineitem").selectExpr(
        "l_linestatus AS label", "l_quantity / 50 AS qty", "l_extendedprice / 100000 AS price")


@query("m2_expectation_pass_full", f"""
WITH rows AS (SELECT row_number() OVER () AS id, l_linestatus AS label, l_quantity / 50 AS qty, l_extendedprice / 100000 AS price FROM lineitem),
p AS (SELECT label, count(*) / (SELECT count(*) FROM rows) AS w, avg(qty) AS mq, avg(price) AS mp, var_pop(qty) + {RIDGE} AS a, covar_pop(qty, price) AS b,
  var_pop(price) + {RIDGE} AS d FROM rows GROUP BY label),
j AS (SELECT r.*, p.label AS c, ln(w) - ln(2 * pi()) - 0.5 * ln(a * d - b * b)
  - 0.5 * (d * (qty - mq) * (qty - mq) - 2 * b * (qty - mq) * (price - mp) + a * (price - mp) * (price - mp)) / (a * d - b * b) AS lp FROM rows r CROSS JOIN p),
g AS (SELECT c, qty, price, exp(lp - max(lp) OVER w) / sum(exp(lp - m)) OVER w AS g, 1 AS one FROM (SELECT *, max(lp) OVER (PARTITION BY id) AS m FROM j) x WINDOW w AS (PARTITION BY id)),
s AS (SELECT c, sum(g) AS n, sum(g * qty) AS sq, sum(g * price) AS sp, sum(g * qty * qty) AS sqq, sum(g * qty * price) AS sqp, sum(g * price * price) AS spp FROM g GROUP BY c)
SELECT rank() OVER (ORDER BY c) - 1 AS component, round(n / (SELECT count(*) FROM rows), 6) AS weight, round(sq / n, 6) AS m0, round(sp / n, 6) AS m1,
  round(sqq / n - sq * sq / n / n + {RIDGE}, 6) AS v00, round(sqp / n - sq * sp / n / n, 6) AS v01, round(spp / n - sp * sp / n / n + {RIDGE}, 6) AS v11 FROM s""")
def _(spark, sf):
    model = mixture_from_labels(_lines(spark, sf), "label", _LINES, "full")
    points = mixture.fold_points(_lines(spark, sf), _LINES)
    (sums, _), = mixture._gather(points, _LINES, [model])
    new = mixture.maximise(sums, 2, "full", RIDGE)
    return spark.createDataFrame([
        (c, *[round(float(v), 6) + 0.0 for v in (
            new.weights[c], *new.means[c], new.covariances[c][0, 0], new.covariances[c][0, 1], new.covariances[c][1, 1])])
        for c in range(new.k)], "component long, weight double, m0 double, m1 double, v00 double, v01 double, v11 double")


def _pass_sql(before, after, ridge, features=FEATURES):
    """One expectation and maximisation from parameter table to parameter table."""
    updates = ", ".join(
        f"sum(g * {c}) / sum(g) AS m{i}, sum(g * {c} * {c}) / sum(g) - (sum(g * {c}) / sum(g)) * (sum(g * {c}) / sum(g)) + {ridge} AS v{i}"
        for i, c in enumerate(features))
    return f"""
{after}_j AS (SELECT r.*, p.c, {_joint(features)} AS lp FROM rows r CROSS JOIN {before} p),
{after}_g AS (SELECT *, exp(lp - mx) / sum(exp(lp - mx)) OVER (PARTITION BY trip_id) AS g FROM (SELECT *, max(lp) OVER (PARTITION BY trip_id) AS mx FROM {after}_j) x),
{after} AS (SELECT c, sum(g) / (SELECT count(*) FROM rows) AS w, {updates} FROM {after}_g GROUP BY c)"""


def _likelihood_sql(p):
    return f"""(SELECT sum(ll) FROM (SELECT trip_id, max(lp) + ln(sum(exp(lp - mx))) AS ll FROM (SELECT *, max(lp) OVER (PARTITION BY trip_id) AS mx
  FROM (SELECT r.trip_id, {_joint(FEATURES)} AS lp FROM rows r CROSS JOIN {p} p) a) b GROUP BY trip_id) c)"""


_ROWS_P = _SCORED.split("j AS (")[0].rstrip().rstrip(",")


@query("m2_three_passes", given("reals", _ROWS_P + "," + ",".join(
    _pass_sql(a, b, RIDGE) for a, b in (("p", "p1"), ("p1", "p2"), ("p2", "p3"))) + f"""
SELECT CAST(c AS INT) AS component, round(w, 6) AS weight, {', '.join(f'round(m{i}, 6) + 0.0 AS m{i}, round(v{i}, 6) AS v{i}' for i in _D)} FROM p3"""))
def _(spark, sf):
    points = mixture.fold_points(complete(spark, sf), FEATURES)
    start = weekday_mixture(spark, sf)
    (model, _), = mixture.fit_mixtures(
        points, FEATURES, [mixture.Candidate(7, RIDGE, "diag")], 3, -1.0, starts=[start])
    table = model.to_table(spark)
    return table.select(
        "component", r6("weight"), *[(F.round(F.col("mean")[i], 6) + F.lit(0.0)).alias(f"m{i}") for i in _D],
        *[r6(F.col("covariance")[7 * i], f"v{i}") for i in _D])


_RIDGES = (0.001, 0.01, 0.0005)


@query("m6_select_from_start", given("reals", _ROWS_P + "," + ",".join(
    _pass_sql(f"p{i}_{k}" if k else "p", f"p{i}_{k + 1}", r) for i, r in enumerate(_RIDGES) for k in range(2)) + " " + " UNION ALL ".join(f"""
SELECT {i} AS trial, 7 AS k, CAST({r} AS DOUBLE) AS ridge, round({_likelihood_sql(f'p{i}_2')}, 3) AS log_likelihood,
  round(90 * ln((SELECT count(*) FROM rows)) - 2 * {_likelihood_sql(f'p{i}_2')}, 3) AS bic""" for i, r in enumerate(_RIDGES))))
def _(spark, sf):
    points = mixture.fold_points(complete(spark, sf), FEATURES)
    start = weekday_mixture(spark, sf)
    chosen = mixture.select_mixture(
        points, FEATURES, [mixture.Candidate(7, r, "diag") for r in _RIDGES], 2, -1.0, starts=[start] * len(_RIDGES))
    return chosen.runs.select("trial", "k", "ridge", F.round("log_likelihood", 3).alias("log_likelihood"), F.round("bic", 3).alias("bic"))


@query("m2_fit_mixture")
def _(spark, sf):
    folded = mixture.fold_points(fx.real(spark, sf), FEATURES)
    scaler = scaling.Scaler.fit(folded, FEATURES, weight="n")
    model = mixture.fit_mixture(scaler.transform(folded), FEATURES, 8, RIDGE, max_passes=25)
    return model.to_table(spark)


@query("m3_assign_clusters", given("reals", _SCORED + "SELECT trip_id, CAST(arg_max(c, lp) AS INT) AS cluster FROM j GROUP BY trip_id"))
def _(spark, sf):
    return mixture.assign_clusters(complete(spark, sf), FEATURES, weekday_mixture(spark, sf)).select("trip_id", "cluster")


@query("m4_information", given("reals", _SCORED + f"""
SELECT count(*) AS rows, CAST(6 + 7 * 12 AS BIGINT) AS parameters, round(sum(ll), 4) AS log_likelihood,
  round(90 * ln(count(*)) - 2 * sum(ll), 4) AS bic, round(180 - 2 * sum(ll), 4) AS aic FROM t"""))
def _(spark, sf):
    s = mixture.model_scores(complete(spark, sf), FEATURES, weekday_mixture(spark, sf))
    return s.select("rows", "parameters", *[F.round(c, 4).alias(c) for c in ("log_likelihood", "bic", "aic")])


def _points_sql():
    """Draws of the weekday mixture, one per complete trip."""
    values = []
    for i, c in enumerate(FEATURES):
        z = z_sql(f"42/point{i // 4}", "n.id", which=i % 4)
        values.append(f"p.m{i} + sqrt(p.v{i}) * {z} AS {c}")
    return f"""
e AS (SELECT *, coalesce(sum(w) OVER (ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo,
  CASE WHEN c = (SELECT max(c) FROM p) THEN 2 ELSE sum(w) OVER (ORDER BY c) END AS hi FROM p),
n AS (SELECT id, {u_sql('42/component', 'id')} AS u FROM (SELECT unnest(range((SELECT count(*) FROM rows))) AS id) x),
drawn AS (SELECT n.id, p.c, {', '.join(values)} FROM n JOIN e p ON n.u >= p.lo AND n.u < p.hi)"""


@query("m5_draw_points", given("reals", _ROWS_P + "," + _points_sql() + " SELECT id AS sample_id, CAST(c AS INT) AS component, " + ", ".join(
    f"round({c}, 6) + 0.0 AS {c}" for c in FEATURES) + " FROM drawn"))
def _(spark, sf):
    rows = complete(spark, sf).count()
    drawn = mixture.draw(spark, weekday_mixture(spark, sf), rows, FEATURES, SEED)
    return drawn.select("sample_id", "component", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in FEATURES])


@query("m5_draw_trips", given("reals", _ROWS_P + "," + _points_sql() + """
SELECT id AS sample_id, CAST(round_even((atan2(sin_hr, cos_hr) / (2 * pi()) + CASE WHEN atan2(sin_hr, cos_hr) < 0 THEN 1 ELSE 0 END) * 24, 0) AS INT) % 24 AS hour,
  round(PU_longitude, 6) AS pu_lon, round(PU_latitude, 6) AS pu_lat, round(DO_longitude, 6) AS do_lon, round(DO_latitude, 6) AS do_lat, 1 AS trips FROM drawn"""))
def _(spark, sf):
    rows = complete(spark, sf).count()
    plain = scaling.Scaler(FEATURES, [0.0] * 6, [1.0] * 6)
    drawn = mixture.draw_trips(spark, weekday_mixture(spark, sf), rows, plain, SEED)
    return drawn.select("sample_id", "hour", r6("PU_longitude", "pu_lon"), r6("PU_latitude", "pu_lat"),
                        r6("DO_longitude", "do_lon"), r6("DO_latitude", "do_lat"), "trips")


def _scaled_points(spark, sf):
    folded = mixture.fold_points(fx.real(spark, sf), FEATURES)
    return scaling.Scaler.fit(folded, FEATURES, weight="n").transform(folded)


@query("m6_select_mixture")
def _(spark, sf):
    candidates = mixture.random_candidates(4, SEED, (2, 6), (1e-4, 1e-3), ("full", "diag"))
    return mixture.select_mixture(_scaled_points(spark, sf), FEATURES, candidates, 8).runs


@query("m7_best_of_seeds")
def _(spark, sf):
    candidates = [c for s in (1, 2) for c in mixture.random_candidates(2, s, (2, 5), (1e-4, 1e-3))]
    chosen = mixture.select_mixture(_scaled_points(spark, sf), FEATURES, candidates, 8)
    return results.best_by_information(chosen.runs)


X64 = [f"x{i}" for i in range(64)]


def clusters64(spark, sf):
    return labelled(spark, sf).withColumnRenamed("label", "cluster")


@query("j8_pair_sums", """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.label AS cluster, sum(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) AS s
  FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1)
SELECT cluster, (SELECT CAST(count(*) AS DOUBLE) FROM e WHERE label = cluster) AS n, round(s, 6) AS total FROM p""")
def _(spark, sf):
    # small blocks, so that several tiles per cluster are exercised
    return distance.pair_sums(clusters64(spark, sf), "cluster", X64, block=16).select("cluster", "n", r6("total"))


@query("d2_mean_pair_distance", PAIR_SQL + """
SELECT CAST(r.c AS INT) AS cluster, coalesce(round(m, 6), 0) AS mean_distance FROM (SELECT unnest(range(12)) AS c) r LEFT JOIN p ON p.cluster = r.c""")
def _(spark, sf):
    out = distance.mean_pair_distance(clusters64(spark, sf), "cluster", X64, 0.0, range(12))
    return out.select("cluster", r6("mean_distance"))


_TRIP_FEATURES = compactness.FEATURES
_EVENING = f"""+
rows AS (SELECT *, DOLocationID AS cluster FROM reals WHERE PU_longitude IS NOT NULL),
z AS (SELECT trip_id, cluster, hour AS h, weekday AS wd, {', '.join(f'({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS f{i}' for i, c in enumerate(_TRIP_FEATURES))} FROM rows),
ev AS (SELECT * FROM z {{where}}),
pairs AS (SELECT a.cluster, avg(sqrt({' + '.join(f'(a.f{i} - b.f{i}) * (a.f{i} - b.f{i})' for i in range(6))})) AS m
  FROM ev a JOIN ev b ON a.cluster = b.cluster AND a.trip_id < b.trip_id GROUP BY 1),
dist AS (SELECT c.cluster, pairs.m FROM (SELECT DISTINCT cluster FROM ev) c LEFT JOIN pairs USING (cluster))
"""
_AT_18 = "WHERE h = 18 AND wd = 2"


def trip_clusters(spark, sf):
    """Complete real trips, standardised; the drop-off zone is the cluster."""
    rows = filters.complete(fx.real(spark, sf), _TRIP_FEATURES).withColumns(
        {"cluster": F.col("DOLocationID"), "h": F.col("hour"), "wd": F.col("weekday")})
    return scaling.Scaler.fit(rows, _TRIP_FEATURES).transform(rows)


def evening(spark, sf):
    return trip_clusters(spark, sf).filter((F.col("h") == 18) & (F.col("wd") == 2))


@query("d2_trip_clusters", given("reals", _EVENING.replace("{where}", "") + "SELECT cluster, round(m, 6) AS mean_distance FROM dist"))
def _(spark, sf):
    out = distance.mean_pair_distance(trip_clusters(spark, sf), "cluster", _TRIP_FEATURES)
    return out.select("cluster", r6("mean_distance"))


@query("d1_evening_distance", given("reals", _EVENING.replace("{where}", _AT_18) + "SELECT cluster, round(m, 6) AS mean_distance FROM dist"))
def _(spark, sf):
    out = distance.mean_pair_distance(evening(spark, sf), "cluster", _TRIP_FEATURES, None)
    return out.select("cluster", r6("mean_distance"))


@query("j3_with_distance", given("reals", _EVENING.replace("{where}", _AT_18) + """
SELECT trip_id, ev.cluster, round(m, 6) AS mean_distance FROM ev LEFT JOIN dist ON ev.cluster = dist.cluster"""))
def _(spark, sf):
    e = evening(spark, sf)
    d = distance.mean_pair_distance(e, "cluster", _TRIP_FEATURES, None)
    return distance.with_distance(e, d).select("trip_id", "cluster", r6("mean_distance"))


_GAPS = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in _TRIP_FEATURES)
_DRAWN_PAIRS = f"""+
rows AS (SELECT DOLocationID AS cluster, hour AS h, weekday AS wd, {', '.join(f'({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}' for c in _TRIP_FEATURES)}
  FROM reals WHERE PU_longitude IS NOT NULL),
f AS (SELECT cluster, {', '.join(_TRIP_FEATURES)}, CAST(count(*) AS BIGINT) AS w FROM rows {{where}} GROUP BY ALL),
p AS (SELECT *, CAST(sum(w) OVER (PARTITION BY cluster) AS BIGINT) AS n, count(*) OVER (PARTITION BY cluster) AS p,
  CAST(coalesce(sum(w) OVER (PARTITION BY cluster ORDER BY {', '.join(_TRIP_FEATURES)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS position FROM f),
plan AS (SELECT DISTINCT cluster, n, CAST(least({{draws}} // 2, n) AS BIGINT) AS strata FROM p WHERE p * (p - 1) / 2 > {{draws}}),
t AS (SELECT *, unnest(range(CAST(greatest(2, ceil({{draws}} / strata)) AS BIGINT))) + 1 AS draw FROM (SELECT *, unnest(range(strata)) AS stratum FROM plan) x),
r AS (SELECT *, lo + CAST(floor({u_sql('7/first', 'cluster', 'stratum', 'draw')} * (hi - lo)) AS BIGINT) AS first,
  CAST(floor({u_sql('7/second', 'cluster', 'stratum', 'draw')} * (n - 1)) AS BIGINT) AS other
  FROM (SELECT *, stratum * n // strata AS lo, (stratum + 1) * n // strata AS hi FROM t) x),
d AS (SELECT r.cluster, r.n, r.stratum, (r.hi - r.lo) / r.n AS share, sqrt({_GAPS}) AS d
  FROM (SELECT *, other + CASE WHEN other >= first THEN 1 ELSE 0 END AS second FROM r) r
  JOIN p a ON a.cluster = r.cluster AND r.first >= a.position AND r.first < a.position + a.w
  JOIN p b ON b.cluster = r.cluster AND r.second >= b.position AND r.second < b.position + b.w),
e AS (SELECT cluster, n, share, stratum, count(*) AS per, avg(d) AS m, var_samp(d) AS v FROM d GROUP BY ALL),
sampled AS (SELECT cluster, n, CAST(sum(per) AS BIGINT) AS draws, sum(share * m) AS m, 1.959964 * sqrt(sum(share * share * v / per)) AS half FROM e GROUP BY ALL),
exact AS (SELECT a.cluster, a.n, CAST(0 AS BIGINT) AS draws, sum(a.w * b.w * sqrt({_GAPS})) / any_value(a.n * (a.n - 1)) AS m, CAST(0 AS DOUBLE) AS half
  FROM p a JOIN p b ON a.cluster = b.cluster WHERE a.n > 1 AND a.p * (a.p - 1) / 2 <= {{draws}} GROUP BY ALL)
SELECT cluster, n, draws, round(m, 6) AS mean_distance, round(m - half, 6) AS low, round(m + half, 6) AS high FROM (FROM sampled UNION ALL FROM exact) x"""


def _drawn(points, draws):
    out = distance.sampled_pair_distance(points, "cluster", _TRIP_FEATURES, draws, seed=7)
    return out.filter("n > 1").select("cluster", "n", "draws", r6("mean_distance"), r6("low"), r6("high"))


@query("j8_sampled_pairs", given("reals", _DRAWN_PAIRS.format(draws=300, where="")))
def _(spark, sf):
    return _drawn(trip_clusters(spark, sf), 300)


@query("d2_sampled_or_whole", given("reals", _DRAWN_PAIRS.format(draws=4000, where="")))
def _(spark, sf):
    return _drawn(trip_clusters(spark, sf), 4000)


@query("d1_sampled_evening", given("reals", _DRAWN_PAIRS.format(draws=50, where=_AT_18)))
def _(spark, sf):
    return _drawn(evening(spark, sf), 50)


_TOP = "(SELECT cluster, count(*) AS n FROM rows GROUP BY 1 ORDER BY n DESC, cluster LIMIT 10)"


@query("j5_of_clusters", given("reals", f"""+
rows AS (SELECT *, DOLocationID AS cluster FROM reals WHERE PU_longitude IS NOT NULL)
SELECT trip_id, cluster FROM rows WHERE cluster IN (SELECT cluster FROM {_TOP} t)"""))
def _(spark, sf):
    rows = trip_clusters(spark, sf)
    return distance.of_clusters(rows, distance.busiest_clusters(rows)).select("trip_id", "cluster")


@query("t2_busiest_clusters", given("reals", f"""+
rows AS (SELECT *, DOLocationID AS cluster FROM reals WHERE PU_longitude IS NOT NULL)
SELECT cluster, n FROM {_TOP} t"""))
def _(spark, sf):
    return distance.busiest_clusters(trip_clusters(spark, sf))


@query("t3_tightest_clusters", given("reals", _EVENING.replace("{where}", _AT_18) + """
SELECT cluster, round(m, 6) AS mean_distance FROM dist ORDER BY m NULLS LAST, cluster LIMIT 10"""))
def _(spark, sf):
    d = distance.mean_pair_distance(evening(spark, sf), "cluster", _TRIP_FEATURES, None)
    return distance.tightest_clusters(d).select("cluster", r6("mean_distance"))


@query("d2_compactness_report")
def _(spark, sf):
    return compactness.cluster_distances(fx.enriched(spark, sf), k=6, share=settings.COMPACT_SHARE, zones=list(range(25)), max_passes=10)


@query("d1_wednesday_report")
def _(spark, sf):
    return compactness.wednesday_evening(fx.enriched(spark, sf), k=6, max_passes=10).report


# The reports once more, from a start that SQL can follow: five groups of pickup zones.
def _report_sql(ridge, evening):
    scaled = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in _TRIP_FEATURES)
    gap = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in _TRIP_FEATURES)
    return f"""+
rows AS (SELECT trip_id, PULocationID % 5 AS label, hour AS h, weekday AS wd, {scaled} FROM reals
  WHERE PU_longitude IS NOT NULL AND DO_longitude IS NOT NULL AND PULocationID BETWEEN 0 AND 24),
p AS {_components(_TRIP_FEATURES, 'label', 'rows')}, {_pass_sql('p', 'p1', ridge, _TRIP_FEATURES)},
{_pass_sql('p1', 'p2', ridge, _TRIP_FEATURES)},
placed AS (SELECT trip_id, arg_max(c, lp) AS cluster FROM (SELECT r.trip_id, p.c, {_joint(_TRIP_FEATURES)} AS lp FROM rows r CROSS JOIN p2 p) x GROUP BY 1),
ev AS (SELECT * FROM rows JOIN placed USING (trip_id) {_AT_18 if evening else ''}),
pairs AS (SELECT a.cluster, avg(sqrt({gap})) AS m FROM ev a JOIN ev b ON a.cluster = b.cluster AND a.trip_id < b.trip_id GROUP BY 1)
"""


def _zone_start(spark, sf):
    rows = filters.from_zones(filters.complete(fx.real(spark, sf), _TRIP_FEATURES), range(25))
    scaled = scaling.Scaler.fit(rows, _TRIP_FEATURES).transform(rows)
    return mixture_from_labels(scaled.withColumn("label", F.col("PULocationID") % 5), "label", _TRIP_FEATURES, "diag")


@query("d2_compactness_from_start", given("reals", _report_sql(RIDGE, False) + """
SELECT CAST(r.c AS INT) AS cluster, coalesce(round(m, 6), 0) AS mean_distance FROM (SELECT unnest(range(5)) AS c) r LEFT JOIN pairs ON pairs.cluster = r.c"""))
def _(spark, sf):
    out = compactness.cluster_distances(
        fx.enriched(spark, sf), 5, RIDGE, zones=list(range(25)), max_passes=2, tolerance=-1.0, start=_zone_start(spark, sf))
    return out.select("cluster", r6("mean_distance"))


@query("d1_wednesday_from_start", given("reals", _report_sql(1e-6, True) + """
SELECT CAST(c.cluster AS INT) AS cluster, round(m, 6) AS mean_distance
FROM (SELECT DISTINCT cluster FROM ev) c LEFT JOIN pairs USING (cluster)"""))
def _(spark, sf):
    trips = filters.from_zones(fx.enriched(spark, sf), range(25))
    report = compactness.wednesday_evening(trips, 5, max_passes=2, tolerance=-1.0, start=_zone_start(spark, sf)).report
    return report.select("cluster", r6("mean_distance"))
