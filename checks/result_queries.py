"""Tables over results, histograms and distances between distributions."""

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.fixtures import given, u_sql, z_sql
from checks.forecast_queries import _predicted, _start, adam_sql, sums_sql
from checks.mixture_queries import _components, _pass_sql, mixture_from_labels
from checks.registry import long, query, r6
from tripcast.operators import compare, metrics, results, scaling, splits
from tripcast.plans import hour_model

NAMES = ["R²", "MAE", "MSE", "RMSE", "MAPE", "SMAPE"]


def r3(c, name=None):
    return F.round(F.col(f"`{c}`"), 3).alias(name or c)


@query("a17_wide_results", given("wide_runs", """
SELECT data_type, nc, epochs, seed, round(r2, 3) AS r2, round(mae, 3) AS mae, round(mape, 3) AS mape FROM wide_runs"""))
def _(spark, sf):
    w = results.wide_results(fx.results(spark, sf), ["R²", "MAE", "MAPE"])
    return w.select("data_type", "nc", "epochs", "seed", r3("R²", "r2"), r3("MAE", "mae"), r3("MAPE", "mape"))


@query("a18_mean_over_seeds", given("wide_runs", """
SELECT data_type, nc, epochs, round(avg(r2), 3) AS r2, round(avg(mae), 3) AS mae FROM wide_runs GROUP BY ALL"""))
def _(spark, sf):
    m = results.mean_over_seeds(fx.results(spark, sf))
    return m.select("data_type", "nc", "epochs", r3("R²", "r2"), r3("MAE", "mae"))


@query("a19_box_statistics", given("results", """+
b AS (SELECT metric, nc, epochs, data_type, count(value) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
  FROM results WHERE value IS NOT NULL GROUP BY ALL)
SELECT b.metric, b.nc, b.epochs, b.data_type, b.n, round(q1, 3) AS q1, round(median, 3) AS median, round(q3, 3) AS q3,
  round(min(CASE WHEN value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN value END), 3) AS low,
  round(max(CASE WHEN value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN value END), 3) AS high
FROM results r JOIN b ON r.metric = b.metric AND r.nc = b.nc AND r.epochs = b.epochs AND r.data_type = b.data_type WHERE value IS NOT NULL GROUP BY ALL"""))
def _(spark, sf):
    b = results.box_statistics(fx.results(spark, sf))
    return b.select("metric", "nc", "epochs", "data_type", "n", *[r3(c) for c in ("q1", "median", "q3", "low", "high")])


@query("a19_quantiles_of_prices", """
SELECT l_returnflag AS flag, count(l_extendedprice) AS n, round(quantile_cont(l_extendedprice, 0.05), 3) AS q05,
  round(quantile_cont(l_extendedprice, 0.5), 3) AS q50, round(quantile_cont(l_extendedprice, 0.99), 3) AS q99 FROM lineitem GROUP BY 1""")
def _(spark, sf):
    q = results.grouped_quantiles(fx.table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.05, 0.5, 0.99])
    return q.select(F.col("l_returnflag").alias("flag"), "n", *[
        F.round(F.col("quantiles")[i], 3).alias(name) for i, name in enumerate(("q05", "q50", "q99"))])


@query("a21_model_comparison", given("wide_runs", """
SELECT data_type, round(avg(r2), 3) AS r2, round(avg(smape), 3) AS smape, round(avg(mae), 3) AS mae FROM wide_runs GROUP BY data_type"""))
def _(spark, sf):
    m = results.model_comparison(fx.results(spark, sf))
    return m.select("data_type", r3("R²", "r2"), r3("SMAPE", "smape"), r3("MAE", "mae"))


def _trials(spark, sf):
    lines = fx.table(spark, sf, "lineitem").selectExpr(
        "l_returnflag AS data_type", "l_suppkey AS trial", "l_extendedprice AS y", "l_quantity * 1499.7182818 AS p")
    wide = metrics.accuracy(lines, "y", "p", ["data_type", "trial"])
    return wide.select("data_type", "trial", r6("r2"), r6("smape"))


@query("j11_pareto_front", """
WITH t AS (SELECT data_type, trial, round(1 - sum((y-p)*(y-p)) / (var_pop(y) * count(y)), 6) AS r2, round(100 * avg(2*abs(p-y)/(abs(y)+abs(p)+1e-8)), 6) AS smape
  FROM (SELECT l_returnflag AS data_type, l_suppkey AS trial, l_extendedprice AS y, l_quantity * 1499.7182818 AS p FROM lineitem) x GROUP BY ALL)
SELECT * FROM t WHERE r2 IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t o WHERE o.data_type = t.data_type AND o.r2 >= t.r2 AND o.smape <= t.smape AND (o.r2 > t.r2 OR o.smape < t.smape))""")
def _(spark, sf):
    return results.pareto_front(_trials(spark, sf), ["data_type"]).select("data_type", "trial", "r2", "smape")


@query("t4_best_by_information", given("wide_runs", """
SELECT data_type, nc, epochs, seed, round(mse, 2) AS bic, round(mae, 2) AS aic FROM wide_runs WHERE mse IS NOT NULL ORDER BY 5, 6 LIMIT 1"""))
def _(spark, sf):
    w = results.wide_results(fx.results(spark, sf), ["MSE", "MAE"])
    runs = w.select("data_type", "nc", "epochs", "seed", F.round("MSE", 2).alias("bic"), F.round("MAE", 2).alias("aic"))
    return results.best_by_information(runs)


def _bins_sql(column, bins):
    return f"""+
x AS (SELECT CAST({column} AS DOUBLE) AS x, 1 AS r FROM reals WHERE {column} IS NOT NULL UNION ALL SELECT CAST({column} AS DOUBLE), 0 FROM synth),
e AS (SELECT min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / {bins} AS step FROM x),
edges AS (SELECT i, CASE WHEN i = {bins} THEN hi ELSE lo + i * step END AS edge FROM e, (SELECT CAST(unnest(range({bins} + 1)) AS INT) AS i) g),
b AS (SELECT a.i AS bin, a.edge AS low, z.edge AS high FROM edges a JOIN edges z ON z.i = a.i + 1),
c AS (SELECT b.bin, b.high - b.low AS width, coalesce(sum(x.r), 0) AS n_real, coalesce(sum(1 - x.r), 0) AS n_synth FROM b
  LEFT JOIN x ON x.x >= b.low AND (x.x < b.high OR b.bin = {bins} - 1) GROUP BY b.bin, b.high - b.low),
d AS (SELECT bin, CAST(n_real AS BIGINT) AS n_real, CAST(n_synth AS BIGINT) AS n_synth, n_real / sum(n_real) OVER () / width AS d_real, n_synth / sum(n_synth) OVER () / width AS d_synth FROM c),
f AS (SELECT *, CASE WHEN d_real = 0 THEN 1e-8 ELSE d_real END AS p, CASE WHEN d_synth = 0 THEN 1e-8 ELSE d_synth END AS q FROM d),
k AS (SELECT *, sum(p) OVER (ORDER BY bin) AS cp, sum(q) OVER (ORDER BY bin) AS cq FROM f)
"""


def _density(spark, sf, column):
    return compare.densities(fx.real(spark, sf), fx.synth(spark, sf), column)


@query("a12_histograms", given("reals synth", _bins_sql("hour", 50) + "SELECT bin, n_real, n_synth, round(d_real, 6) AS d_real, round(d_synth, 6) AS d_synth FROM d"))
def _(spark, sf):
    return _density(spark, sf, "hour").select("bin", long("n_real"), long("n_synth"), r6("d_real"), r6("d_synth"))


@query("a12_histograms_of_longitude", given("reals synth", _bins_sql("PU_longitude", 50) + "SELECT bin, n_real, n_synth, round(d_real, 6) AS d_real, round(d_synth, 6) AS d_synth FROM d"))
def _(spark, sf):
    return _density(spark, sf, "PU_longitude").select("bin", long("n_real"), long("n_synth"), r6("d_real"), r6("d_synth"))


@query("w11_running_densities", given("reals synth", _bins_sql("DO_latitude", 50) + "SELECT bin, round(cp, 6) AS cdf_real, round(cq, 6) AS cdf_synth FROM k"))
def _(spark, sf):
    return compare.cumulative(_density(spark, sf, "DO_latitude")).select("bin", r6("cdf_real"), r6("cdf_synth"))


@query("e5_divergence", given("reals synth", _bins_sql("PU_longitude", 50) + "SELECT round(sum(p * ln(p / q)), 6) AS kl FROM k"))
def _(spark, sf):
    return compare.divergence(_density(spark, sf, "PU_longitude")).select(r6("kl"))


@query("e5_divergence_normalised", given("reals synth", _bins_sql("PU_longitude", 50) + """
SELECT round(sum(p / sp * ln(p / sp / (q / sq))), 6) AS kl FROM k, (SELECT sum(p) AS sp, sum(q) AS sq FROM f) s"""))
def _(spark, sf):
    return compare.divergence(_density(spark, sf, "PU_longitude"), normalised=True).select(r6("kl"))


@query("e6_running_distance", given("reals synth", _bins_sql("hour", 50) + "SELECT round(sum(abs(cp - cq)), 6) AS wd FROM k"))
def _(spark, sf):
    return compare.divergence(_density(spark, sf, "hour")).select(r6("wd"))


@query("a22_component_sweep")
def _(spark, sf):
    return hour_model.sweep(fx.enriched(spark, sf), ks=(3, 5), share=1.0, multiplier=2, max_passes=8)


# The sweep once more, from starts that SQL can follow: groups of pickup zones, diagonal, two passes.
_SWEPT, _EPOCHS = (2, 3), 30
_DIMS = hour_model.FEATURES


def _sweep_parts(spark, sf):
    rows = fx.real(spark, sf).dropna(subset=_DIMS).filter(F.col("weekday").between(1, 3))
    return splits.random_parts(rows, "trip_id", fx.SEED).filter(F.col("part") == "train")


def _sweep_cell(k):
    """The mixture of k groups of zones after two passes, trips drawn from it, training and bins."""
    fit = ", ".join([
        f"p{k}_0 AS {_components(_DIMS, f'label % {k}', 'rows', 1e-6)}",
        _pass_sql(f"p{k}_0", f"p{k}_1", 1e-6, _DIMS).strip(), _pass_sql(f"p{k}_1", f"p{k}_2", 1e-6, _DIMS).strip()])
    seed = fx.SEED + k
    values = ", ".join(f"p.m{i} + sqrt(p.v{i}) * {z_sql(f'{seed}/point{i // 4}', 'n.id', which=i % 4)} AS {'y' if i == 0 else f'x{i - 1}'}"
                       for i in range(len(_DIMS)))
    return f"""{fit},
e{k} AS (SELECT *, coalesce(sum(w) OVER (ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo,
  CASE WHEN c = (SELECT max(c) FROM p{k}_2) THEN 2 ELSE sum(w) OVER (ORDER BY c) END AS hi FROM p{k}_2),
n{k} AS (SELECT id, {u_sql(f'{seed}/component', 'id')} AS u FROM (SELECT unnest(range(2 * (SELECT count(*) FROM rows))) AS id) x),
d{k} AS MATERIALIZED (SELECT {values} FROM n{k} n JOIN e{k} p ON n.u >= p.lo AND n.u < p.hi),
ge{k} AS ({sums_sql(f'd{k}', 4)}), gb{k} AS ({sums_sql(f'(SELECT y, x0, x1, x2, x3 FROM tr UNION ALL SELECT y, x0, x1, x2, x3 FROM d{k}) u', 4)}),
{adam_sql(f'tuned{k}', f'ge{k}', 'h', 4, 'real_end', 1e-4, _EPOCHS, 5)},
{adam_sql(f'both{k}', f'gb{k}', 'h', 4, _start(fx.SEED + 1), 1e-3, _EPOCHS, 5)},
hx{k} AS (SELECT hour0 AS x, 1 AS r FROM rows UNION ALL SELECT CAST(round_even(y * s0 + m0, 0) AS INT), 0 FROM d{k}, sc),
he{k} AS (SELECT min(x) AS lo, max(x) AS hi, CAST(max(x) - min(x) AS DOUBLE) / 50 AS step FROM hx{k}),
hg{k} AS (SELECT i, CASE WHEN i = 50 THEN hi ELSE lo + i * step END AS edge FROM he{k}, (SELECT CAST(unnest(range(51)) AS INT) AS i) g),
hb{k} AS (SELECT a.i AS bin, a.edge AS low, z.edge AS high FROM hg{k} a JOIN hg{k} z ON z.i = a.i + 1),
hc{k} AS (SELECT b.bin, b.high - b.low AS width, coalesce(sum(x.r), 0) AS a, coalesce(sum(1 - x.r), 0) AS s FROM hb{k} b
  LEFT JOIN hx{k} x ON x.x >= b.low AND (x.x < b.high OR b.bin = 49) GROUP BY b.bin, b.high - b.low),
hf{k} AS (SELECT bin, CASE WHEN a = 0 THEN 1e-8 ELSE a / sum(a) OVER () / width END AS p, CASE WHEN s = 0 THEN 1e-8 ELSE s / sum(s) OVER () / width END AS q FROM hc{k}),
hk{k} AS (SELECT *, sum(p) OVER (ORDER BY bin) AS cp, sum(q) OVER (ORDER BY bin) AS cq FROM hf{k})"""


def _sweep_sql():
    scored = " UNION ALL ".join(
        f"SELECT {k} AS k, '{name}' AS model, te.y * sc.s0 + sc.m0 AS y, ({_predicted('t', prefix='b')}) * sc.s0 + sc.m0 AS p FROM te, sc, "
        f"(SELECT * FROM {path} ORDER BY e DESC LIMIT 1) t"
        for k in _SWEPT for name, path in (("real", "real_path"), ("finetune", f"tuned{k}"), ("both", f"both{k}")))
    gaps = " UNION ALL ".join(f"SELECT {k} AS k, round(sum(p * ln(p / q)), 5) AS kl, round(sum(abs(cp - cq)), 5) AS wd FROM hk{k}" for k in _SWEPT)
    scales = ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(_DIMS))
    return f"""+
all_ AS (SELECT trip_id, PULocationID AS label, {', '.join(_DIMS)},
  CASE WHEN {u_sql('42/test', 'trip_id')} < 0.15 THEN 'test' WHEN {u_sql('42/val', 'trip_id')} < 0.15 THEN 'val' ELSE 'train' END AS part
  FROM reals WHERE PU_longitude IS NOT NULL AND weekday BETWEEN 1 AND 3),
sc AS (SELECT {scales} FROM all_ WHERE part = 'train'),
rows AS MATERIALIZED (SELECT trip_id, label, hour AS hour0, {', '.join(f'({c} - m{i}) / s{i} AS {c}' for i, c in enumerate(_DIMS))} FROM all_, sc WHERE part = 'train'),
z AS (SELECT part, (hour - m0) / s0 AS y, {', '.join(f'({c} - m{i + 1}) / s{i + 1} AS x{i}' for i, c in enumerate(_DIMS[1:]))} FROM all_, sc),
tr AS (SELECT * FROM z WHERE part = 'train'), va AS (SELECT * FROM z WHERE part = 'val'), te AS (SELECT * FROM z WHERE part = 'test'),
g AS ({sums_sql('tr', 4)}), h AS ({sums_sql('va', 4)}),
{adam_sql('real_path', 'g', 'h', 4, _start(fx.SEED), 1e-3, _EPOCHS, 5)},
real_end AS (SELECT {', '.join(f'b{i} AS w{i}' for i in range(5))} FROM real_path ORDER BY e DESC LIMIT 1),
{", ".join(_sweep_cell(k) for k in _SWEPT)},
sco AS ({scored}), gaps AS ({gaps}),
acc AS (SELECT k, model, round(avg(abs(y - p)), 4) AS mae, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)), 5) AS r2 FROM sco GROUP BY ALL)
SELECT k AS n_clusters, any_value(kl) AS kl, any_value(wd) AS wd, {', '.join(f"max({c}) FILTER (model = '{m}') AS {m}_{c}" for m in ('real', 'finetune', 'both') for c in ('mae', 'r2'))}
FROM gaps JOIN acc USING (k) GROUP BY k"""


@query("a22_sweep_from_start", given("reals", _sweep_sql()).replace("WITH", "WITH RECURSIVE", 1))
def _(spark, sf):
    train = _sweep_parts(spark, sf)
    scaled = scaling.Scaler.fit(train, _DIMS).transform(train)
    starts = [
        mixture_from_labels(scaled.withColumn("label", F.col("PULocationID") % k), "label", _DIMS, "diag", 1e-6) for k in _SWEPT]
    out = hour_model.sweep(fx.enriched(spark, sf), _SWEPT, 1.0, 2, max_passes=2, tolerance=-1.0, starts=starts)
    names = {"real": "real", "finetune": "finetune", "both": "real_synth_init"}
    return out.select(
        "n_clusters", F.round("kl", 5).alias("kl"), F.round("wd", 5).alias("wd"),
        *[F.round(f"{n}_{c}", places).alias(f"{m}_{c}") for m, n in names.items() for c, places in (("mae", 4), ("r2", 5))])
