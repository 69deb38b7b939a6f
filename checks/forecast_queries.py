"""Accuracy, training from sums of products, and scoring.

Training is followed step by step in SQL: a recursive table whose rows are the
epochs of the optimiser.
"""

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.demand_queries import named_trips
from checks.fixtures import SEED, given, u_sql
from checks.registry import query, r6, text
from checks.window_queries import _HOUR_WINDOWS, _PAIRS, _WEEKS, hour_series
from tripcast.durable import checkpointed, new_folder
from tripcast.functions.vectors import moving_average_matrix
from tripcast.operators import demand, linear, metrics, scaling, splits, windows
from tripcast.plans import day_pairs, hour_model, series_models, zone_forecast
from tripcast.sources import sinks
from tripcast.sources.trips import COORDINATES

XS = [f"x{k}" for k in range(4)]


# ---- accuracy ----

def _accuracy_sql(source, y="y", p="p", by=""):
    head = f"{by}, " if by else ""
    tail = f"GROUP BY {by}" if by else ""
    return f"""SELECT {head}count({y}) AS n,
  round(CASE WHEN count({y}) > 1 THEN 1 - sum(({y}-{p})*({y}-{p})) / (var_pop({y}) * count({y})) END, 6) AS r2,
  round(avg(abs({y}-{p})), 4) AS mae, round(avg(({y}-{p})*({y}-{p})), 2) AS mse, round(sqrt(avg(({y}-{p})*({y}-{p}))), 4) AS rmse,
  round(avg(CASE WHEN {y} <> 0 THEN abs(({y}-{p})/{y}) END) * 100, 6) AS mape,
  round(100 * avg(2*abs({p}-{y})/(abs({y})+abs({p})+1e-8)), 6) AS smape FROM {source} {tail}"""


_PLACES = {"r2": 6, "mae": 4, "mse": 2, "rmse": 4, "mape": 6, "smape": 6}


def _accuracy(df, by=()):
    out = metrics.accuracy(df, "y", "p", by)
    return out.select(*by, "n", *[F.round(c, k).alias(c) for c, k in _PLACES.items()])


def _lines(spark, sf):
    return fx.table(spark, sf, "lineitem").selectExpr(
        "l_extendedprice AS y", "l_quantity * 1499.7182818 AS p", "l_returnflag", "l_linestatus")


_LINES = "(SELECT l_extendedprice AS y, l_quantity * 1499.7182818 AS p, l_returnflag, l_linestatus FROM lineitem) x"


@query("e1_r2", f"SELECT round(1 - sum((y-p)*(y-p)) / (var_pop(y) * count(y)), 6) AS r2 FROM {_LINES}")
def _(spark, sf):
    return metrics.accuracy(_lines(spark, sf), "y", "p").select(r6("r2"))


@query("e1_mean_r2_over_outputs", f"""
SELECT round(avg(r2), 6) AS r2 FROM (SELECT l_returnflag, 1 - sum((y-p)*(y-p)) / (var_pop(y) * count(y)) AS r2 FROM {_LINES} GROUP BY 1) z""")
def _(spark, sf):
    return metrics.mean_r2_over_outputs(_lines(spark, sf), "y", "p", "l_returnflag").select(r6("r2"))


@query("e2_errors", _accuracy_sql(_LINES, by="l_returnflag, l_linestatus"))
def _(spark, sf):
    return _accuracy(_lines(spark, sf), ["l_returnflag", "l_linestatus"])


_ROUNDED = "(SELECT floor(value) AS y, floor(value) + event_id % 3 - 1 AS p, event_type FROM events) x"


@query("a13_all_metrics", _accuracy_sql(_LINES))
def _(spark, sf):
    return _accuracy(_lines(spark, sf))


@query("e3_mape_with_zero_actuals", f"SELECT event_type, round(avg(CASE WHEN y <> 0 THEN abs((y-p)/y) END) * 100, 6) AS mape FROM {_ROUNDED} GROUP BY 1")
def _(spark, sf):
    e = fx.table(spark, sf, "events").selectExpr("floor(value) AS y", "floor(value) + event_id % 3 - 1 AS p", "event_type")
    return metrics.accuracy(e, "y", "p", ["event_type"]).select("event_type", r6("mape"))


@query("e4_smape", f"SELECT event_type, round(100 * avg(2*abs(p-y)/(abs(y)+abs(p)+1e-8)), 6) AS smape FROM {_ROUNDED} GROUP BY 1")
def _(spark, sf):
    e = fx.table(spark, sf, "events").selectExpr("floor(value) AS y", "floor(value) + event_id % 3 - 1 AS p", "event_type")
    return metrics.accuracy(e, "y", "p", ["event_type"]).select("event_type", r6("smape"))


# ---- the optimiser in SQL ----

def sums_sql(source, width, by=""):
    head = f"{by}, " if by else ""
    xs = [f"sum(x{i}) AS x{i}, sum(x{i} * y) AS x{i}_y" for i in range(width)]
    xx = [f"sum(x{i} * x{j}) AS x{i}_x{j}" for i in range(width) for j in range(i, width)]
    return (f"SELECT {head}CAST(count(*) AS DOUBLE) AS n, sum(y) AS y, sum(y * y) AS y_y, {', '.join(xs + xx)} FROM {source}"
            + (f" GROUP BY {by}" if by else ""))


def _entry(i, j, width, t):
    i, j = min(i, j), max(i, j)
    if j == width:
        return f"{t}.n" if i == width else f"{t}.x{i}"
    return f"{t}.x{i}_x{j}"


def _zy(i, width, t):
    return f"{t}.y" if i == width else f"{t}.x{i}_y"


def _num(v):
    return f"CAST({float(v)!r} AS DOUBLE)"


def adam_sql(name, train, val, width, start, rate, epochs, patience=None, min_delta=0.0, each=""):
    """Recursive table ``name(e, w0.., b0..)``: weights and best weights after
    each epoch. ``start`` is a list of numbers or a one-row table with w0...
    ``each`` picks the row of ``train``, called g, for the step after p.e."""
    at = range(width + 1)
    if isinstance(start, str):
        first, source = [f"s.w{i}" for i in at], f" FROM {start} s"
    else:
        first, source = [_num(v) for v in start], ""
    grad = ", ".join(
        "2 / g.n * (" + " + ".join(f"{_entry(i, j, width, 'g')} * p.w{j}" for j in at) + f" - {_zy(i, width, 'g')}) AS g{i}" for i in at)
    m = ", ".join(f"m{i} + {_num(1 - 0.9)} * (g{i} - m{i}) AS m{i}" for i in at)
    v = ", ".join(f"v{i} + {_num(1 - 0.999)} * (g{i} * g{i} - v{i}) AS v{i}" for i in at)
    w = ", ".join(
        f"w{i} - {_num(rate)} * (m{i} / (1 - pow({_num(0.9)}, e))) / (sqrt(v{i} / (1 - pow({_num(0.999)}, e))) + {_num(1e-8)}) AS w{i}" for i in at)
    keep = lambda c: ", ".join(f"{c}{i}" for i in at)
    fit = " + ".join(f"q.w{i} * q.w{j} * {_entry(i, j, width, 'h')}" for i in at for j in at)
    cross = " + ".join(f"q.w{i} * {_zy(i, width, 'h')}" for i in at)
    better = f"loss < best - {_num(min_delta)}"
    stop = f" AND p.waited < {patience}" if patience is not None else ""
    return f"""{name} AS (
  SELECT 0 AS e, {', '.join(f'{f} AS w{i}' for i, f in enumerate(first))}, {', '.join(f'{_num(0)} AS m{i}' for i in at)}, {', '.join(f'{_num(0)} AS v{i}' for i in at)},
    CAST('Infinity' AS DOUBLE) AS best, {', '.join(f'{f} AS b{i}' for i, f in enumerate(first))}, 0 AS waited{source}
  UNION ALL
  SELECT e, {keep('w')}, {keep('m')}, {keep('v')}, CASE WHEN {better} THEN loss ELSE best END,
    {', '.join(f'CASE WHEN {better} THEN w{i} ELSE b{i} END' for i in at)}, CASE WHEN {better} THEN 0 ELSE waited + 1 END
  FROM (SELECT q.*, greatest(0, h.y_y - 2 * ({cross}) + {fit}) / h.n AS loss FROM (
    SELECT e, {w}, {keep('m')}, {keep('v')}, best, {keep('b')}, waited FROM (
      SELECT e, {keep('w')}, {m}, {v}, best, {keep('b')}, waited FROM (
        SELECT p.e + 1 AS e, {', '.join(f'p.{c}{i}' for c in 'wmvb' for i in at)}, p.best, p.waited, {grad}
        FROM {name} p, {train} g WHERE p.e < {epochs}{stop}{each}) a) b) q, {val} h) z)"""


def _start(seed, width=4):
    return linear.initial_weights(width, 1, seed).ravel().tolist()


def _predicted(weights, xs=XS, prefix="w"):
    return " + ".join(f"{x} * {weights}.{prefix}{i}" for i, x in enumerate(xs)) + f" + {weights}.{prefix}{len(xs)}"


# ---- windows of the hourly series ----

_SPLIT = _HOUR_WINDOWS + """,
s AS (SELECT *, pos < floor(CAST(0.7 AS DOUBLE) * (SELECT count(*) FROM w WHERE y IS NOT NULL)) AS train FROM w WHERE y IS NOT NULL),
tr AS (SELECT * FROM s WHERE train), va AS (SELECT * FROM s WHERE NOT train),
"""
_SPLIT_SUMS = _SPLIT + f"g AS ({sums_sql('tr', 4)}), h AS ({sums_sql('va', 4)}),\n"


def hour_windows(spark, sf):
    return windows.sliding_windows(windows.with_position(hour_series(spark, sf)))


@query("m8_sums_of_products", given("day_hours", _SPLIT + f"g AS ({sums_sql('tr', 4)}) SELECT * FROM g"))
def _(spark, sf):
    w = windows.chronological_split(hour_windows(spark, sf)).filter(F.col("part") == "train")
    return linear.sums_of_products(w, XS, "y")


def _regression_sql():
    """Least squares by taking the inputs one after another, each freed from
    those before it."""
    out, previous = [], "tr"
    out.append("o0 AS (SELECT *, x0 - avg(x0) OVER () AS e0 FROM tr)")
    for i in range(1, 4):
        inner = ", ".join(f"regr_slope(x{i}, e{j}) OVER () AS k{j}" for j in range(i))
        rest = " - ".join([f"(x{i} - avg(x{i}) OVER ())"] + [f"k{j} * e{j}" for j in range(i)])
        out.append(f"o{i} AS (SELECT * EXCLUDE ({', '.join(f'k{j}' for j in range(i))}), {rest} AS e{i} FROM (SELECT *, {inner} FROM o{i - 1}) z{i})")
    fitted = " + ".join(["avg(y) OVER ()"] + [f"regr_slope(y, e{j}) OVER () * e{j}" for j in range(4)])
    return ", ".join(out) + f" SELECT pos, y, round({fitted}, 4) AS p FROM o3"


@query("m8_least_squares", given("day_hours", _SPLIT + _regression_sql()))
def _(spark, sf):
    w = windows.chronological_split(hour_windows(spark, sf)).filter(F.col("part") == "train")
    best = linear.Products.collect(w, XS, "y").least_squares()
    return linear.predict(w, XS, best).select("pos", "y", F.round("predicted", 4).alias("p"))


@query("m8_train_series", given("day_hours", _SPLIT_SUMS + adam_sql("path", "g", "h", 4, _start(SEED), 0.01, 200) + f""",
p AS (SELECT path.e AS epochs, va.y, {_predicted('path')} AS p FROM va, path WHERE path.e IN (50, 200))
SELECT epochs, r2, smape, mae, rmse FROM ({_accuracy_sql('p', by='epochs')}) z""").replace("WITH", "WITH RECURSIVE", 1))
def _(spark, sf):
    out = series_models.train_series(hour_series(spark, sf).select("date", "slot", "trips"), [0.01], [50, 200], SEED)
    return out.select("epochs", *[F.round(c, _PLACES[c]).alias(c) for c in ("r2", "smape", "mae", "rmse")])


def _dealt_sql(batches, epochs):
    """Steps of mini-batch training: the sums of each batch, numbered in order."""
    u = u_sql(f"{SEED}/batch", "epoch", "pos")
    return f"""
dealt AS (SELECT t.*, epoch, CAST(floor({u} * {batches}) AS INT) AS batch FROM tr t CROSS JOIN (SELECT unnest(range(1, {epochs + 1})) AS epoch) e),
steps AS (SELECT *, row_number() OVER (ORDER BY epoch, batch) AS step FROM ({sums_sql('dealt', 4, 'epoch, batch')}) b),
h AS ({sums_sql('va', 4)}),
"""


@query("m12_minibatch_steps", given("day_hours", _SPLIT + _dealt_sql(5, 2) + adam_sql(
    "path", "steps", "h", 4, _start(SEED), 0.01, 10, each=" AND g.step = p.e + 1") + """
SELECT 0 AS output, unnest(range(5))::INT AS input, unnest([round(w0, 6), round(w1, 6), round(w2, 6), round(w3, 6), round(w4, 6)]) AS weight
FROM path WHERE e = (SELECT max(step) FROM steps)""").replace("WITH", "WITH RECURSIVE", 1))
def _(spark, sf):
    w = windows.chronological_split(hour_windows(spark, sf))
    dealt = linear.deal_batches(w.filter(F.col("part") == "train"), XS, "y", ["pos"], 5, 2, SEED)
    val = linear.Products.collect(w.filter(F.col("part") == "val"), XS, "y")
    path = linear.minibatch_path(dealt, val, linear.initial_weights(4, 1, SEED), 0.01, [2])
    return linear.weights_table(spark, path.at[2]).select("output", "input", r6("weight"))


@query("s9_linear_weights", given("day_hours", _SPLIT_SUMS + adam_sql("path", "g", "h", 4, _start(SEED), 0.01, 150) + """
SELECT 0 AS output, unnest(range(5))::INT AS input, unnest([round(w0, 6), round(w1, 6), round(w2, 6), round(w3, 6), round(w4, 6)]) AS weight
FROM path WHERE e = 150""").replace("WITH", "WITH RECURSIVE", 1))
def _(spark, sf):
    w = windows.chronological_split(hour_windows(spark, sf))
    train, val = (linear.Products.collect(w.filter(F.col("part") == p), XS, "y") for p in ("train", "val"))
    path = new_folder(spark, "linear")
    trained = linear.gradient_path(train, val, linear.initial_weights(4, 1, SEED), 0.01, [150]).at[150]
    sinks.save_model(linear.weights_table(spark, trained), path)
    back = linear.weights_from(sinks.load_model(spark, path))
    return linear.weights_table(spark, back).select("output", "input", r6("weight"))


@query("m15_score_windows", given("day_hours", _HOUR_WINDOWS + """
SELECT pos, round(0.1 * x0 + 0.2 * x1 + 0.3 * x2 + 0.4 * x3 + 1.5, 6) AS predicted FROM w WHERE y IS NOT NULL"""))
def _(spark, sf):
    return linear.predict(hour_windows(spark, sf), XS, [0.1, 0.2, 0.3, 0.4, 1.5]).select("pos", r6("predicted"))


@query("m11_sums_add_up", given("day_hours", _HOUR_WINDOWS + """,
o AS (SELECT DATE '2024-01-01' + CAST(o_orderkey % 40 AS INT) AS date, CAST(o_custkey % 24 AS INT) AS slot, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY ALL),
on_ AS (SELECT v, row_number() OVER (ORDER BY date, slot) - 1 AS pos FROM o),
ow AS (SELECT pos, v AS x0, lead(v, 1) OVER (ORDER BY pos) AS x1, lead(v, 2) OVER (ORDER BY pos) AS x2, lead(v, 3) OVER (ORDER BY pos) AS x3, lead(v, 4) OVER (ORDER BY pos) AS y FROM on_),
u AS (SELECT * FROM w WHERE y IS NOT NULL UNION ALL SELECT * FROM ow WHERE y IS NOT NULL)
SELECT CAST(count(*) AS DOUBLE) AS n, sum(y) AS y, sum(x0 * x3) AS x0_x3, sum(x1 * x1) AS x1_x1, sum(x2 * y) AS x2_y FROM u"""))
def _(spark, sf):
    real = linear.Products.collect(hour_windows(spark, sf), XS, "y")
    extra = linear.Products.collect(
        windows.sliding_windows(windows.with_position(order_series(spark, sf))), XS, "y")
    both = real + extra
    return spark.createDataFrame(
        [(both.n, float(both.ysum[0]), float(both.zz[0, 3]), float(both.zz[1, 1]), float(both.zy[2, 0]))],
        "n double, y double, x0_x3 double, x1_x1 double, x2_y double")


def order_series(spark, sf):
    """The orders as a second hourly series."""
    o = fx.table(spark, sf, "orders").selectExpr(
        "date_add(DATE '2024-01-01', CAST(o_orderkey % 40 AS INT)) AS date", "CAST(o_custkey % 24 AS INT) AS slot", "1 AS trips")
    return demand.trips_per(o, ["date", "slot"])


# ---- day pairs: three kinds of training data, validated on real days ----

def _growth(side):
    d = lambda k: f"CASE WHEN abs(h{k}_{side}) > 1e-3 THEN CAST(h{k}_{side} AS DOUBLE) ELSE 1e-3 END"
    ws = ["1.0", f"(h1_{side} / ({d(0)}))"]
    ws += [f"({ws[1]} * (h2_{side} / ({d(1)})))"]
    ws += [f"({ws[2]} * (h3_{side} / ({d(2)})))"]
    return ", ".join(f"CAST(h{k}_{side} AS DOUBLE) * {ws[k]} AS x{k}" for k in range(4)) + f", CAST(target_{side} AS DOUBLE) AS y"


def _kind_pairs(name, series):
    body = _PAIRS.strip().lstrip("+").replace("{series}", series)
    body = "\n" + body.strip()
    for t in ("x", "d", "f", "p"):
        body = body.replace(f"\n{t} AS (", f"\n{name}_{t} AS (")
        body = body.replace(f"JOIN {t} ", f"JOIN {name}_{t} ").replace(f"FROM {t} ", f"FROM {name}_{t} ")
    return body.strip()


_KINDS = {"real": "k_real", "synthetic": "k_synth", "real+synthetic": "k_both"}
_EPOCHS = (50, 100, 250)


def _grid_sql():
    out = ["""+
k_real AS (SELECT date, slot, trips FROM day_hours),
k_synth AS (SELECT DATE '2024-01-01' + CAST(o_orderkey % 40 AS INT) AS date, CAST(o_custkey % 24 AS INT) AS slot, count(*) AS trips FROM orders GROUP BY ALL),
k_both AS (SELECT date, slot, CAST(sum(trips) AS BIGINT) AS trips FROM (SELECT * FROM k_real UNION ALL SELECT * FROM k_synth) z GROUP BY ALL)"""]
    scored = []
    for kind, t in _KINDS.items():
        out.append(_kind_pairs(t, t))
        out.append(f"{t}_tr AS (SELECT {_growth('train')} FROM {t}_p), {t}_g AS ({sums_sql(f'{t}_tr', 4)})")
        if kind == "real":
            out.append(f"va AS (SELECT {_growth('val')} FROM {t}_p), h AS ({sums_sql('va', 4)})")
        out.append(adam_sql(f"{t}_path", f"{t}_g", "h", 4, _start(SEED), 0.01, max(_EPOCHS), 10, 1e-4))
        for e in _EPOCHS:
            scored.append(
                f"SELECT '{kind}' AS data_type, {e} AS epochs, va.y, {_predicted('b', prefix='b')} AS p FROM va, "
                f"(SELECT * FROM {t}_path WHERE e <= {e} ORDER BY e DESC LIMIT 1) b")
    out.append("scored AS (" + " UNION ALL ".join(scored) + ")")
    return ",\n".join(out) + f" SELECT data_type, epochs, r2, mae, rmse, mape FROM ({_accuracy_sql('scored', by='data_type, epochs')}) z"


@query("m14_train_kinds", given("day_hours", _grid_sql()).replace("WITH", "WITH RECURSIVE", 1))
def _(spark, sf):
    real, extra = hour_series(spark, sf).select("date", "slot", "trips"), order_series(spark, sf)
    pairs = {
        "real": windows.day_pairs(real), "synthetic": windows.day_pairs(extra),
        "real+synthetic": windows.day_pairs(demand.add_series(real, extra))}
    long = day_pairs.train_kinds(pairs, _EPOCHS, SEED)
    wide = long.groupBy("data_type", "epochs").pivot("metric", ["R²", "MAE", "RMSE", "MAPE"]).agg(F.first("value"))
    return wide.select(
        "data_type", "epochs", F.round("`R²`", 6).alias("r2"), F.round("MAE", 4).alias("mae"),
        F.round("RMSE", 4).alias("rmse"), F.round("MAPE", 6).alias("mape"))


@query("m14_day_pair_experiment")
def _(spark, sf):
    return day_pairs.run(
        fx.enriched(spark, sf), ks=(4,), runs=1, epochs=(50, 100), ridge=0.001, max_passes=8)


# ---- the hour regressed on coordinates ----

_HOUR_PARTS = f"""+
rows AS (SELECT trip_id, CAST(hour AS DOUBLE) AS hour, {', '.join(COORDINATES)},
  CASE WHEN {u_sql('42/test', 'trip_id')} < 0.15 THEN 'test' WHEN {u_sql('42/val', 'trip_id')} < 0.15 THEN 'val' ELSE 'train' END AS part
  FROM reals WHERE PU_longitude IS NOT NULL AND weekday BETWEEN 1 AND 3),
sc AS (SELECT {', '.join(f'avg({c}) AS m{i}, stddev_pop({c}) AS s{i}' for i, c in enumerate(['hour', *COORDINATES]))} FROM rows WHERE part = 'train'),
z AS (SELECT part, (hour - m0) / s0 AS y, {', '.join(f'({c} - m{i + 1}) / s{i + 1} AS x{i}' for i, c in enumerate(COORDINATES))} FROM rows, sc),
extra AS (SELECT (hour - m0) / s0 AS y, {', '.join(f'({c} - m{i + 1}) / s{i + 1} AS x{i}' for i, c in enumerate(COORDINATES))} FROM synth, sc),
tr AS (SELECT * FROM z WHERE part = 'train'), va AS (SELECT * FROM z WHERE part = 'val'), te AS (SELECT * FROM z WHERE part = 'test'),
both_ AS (SELECT y, x0, x1, x2, x3 FROM tr UNION ALL SELECT y, x0, x1, x2, x3 FROM extra),
g AS ({sums_sql('tr', 4)}), h AS ({sums_sql('va', 4)}), ge AS ({sums_sql('extra', 4)}), gb AS ({sums_sql('both_', 4)}),
{adam_sql('real_path', 'g', 'h', 4, _start(SEED), 1e-3, 30, 5)},
real_end AS (SELECT {', '.join(f'b{i} AS w{i}' for i in range(5))} FROM real_path ORDER BY e DESC LIMIT 1),
{adam_sql('tuned_path', 'ge', 'h', 4, 'real_end', 1e-4, 30, 5)},
tuned_end AS (SELECT {', '.join(f'b{i} AS w{i}' for i in range(5))} FROM tuned_path ORDER BY e DESC LIMIT 1),
{adam_sql('both_path', 'gb', 'h', 4, _start(SEED + 1), 1e-3, 30, 5)},
both_end AS (SELECT {', '.join(f'b{i} AS w{i}' for i in range(5))} FROM both_path ORDER BY e DESC LIMIT 1),
"""


def _hour_sql(end):
    return given("reals synth", _HOUR_PARTS + f"""
sco AS (SELECT te.y * s0 + m0 AS y, ({_predicted('t')}) * s0 + m0 AS p FROM te, {end} t, sc)
SELECT round(r2, 5) AS r2, mae, mse FROM ({_accuracy_sql('sco')}) q""").replace("WITH", "WITH RECURSIVE", 1)


def _hour_setup(spark, sf):
    rows = fx.real(spark, sf).dropna(subset=COORDINATES).filter(F.col("weekday").between(1, 3))
    parted = splits.random_parts(rows, "trip_id", SEED)
    part = lambda n: parted.filter(F.col("part") == n)
    scaler = scaling.Scaler.fit(part("train"), hour_model.FEATURES)
    scaled = {n: scaler.transform(part(n)) for n in ("train", "val", "test")}
    sums = {n: linear.Products.collect(scaled[n], COORDINATES, "hour") for n in ("train", "val")}
    extra = linear.Products.collect(scaler.transform(fx.synth(spark, sf)), COORDINATES, "hour")
    real = linear.gradient_path(
        sums["train"], sums["val"], linear.initial_weights(4, 1, SEED), 1e-3, [30], 5).at[30]
    return scaler, scaled["test"], sums, extra, real


def _hour_result(test, weights, scaler):
    a = hour_model.hour_accuracy(test, {("m",): weights}, scaler)
    return a.select(F.round("r2", 5).alias("r2"), F.round("mae", 4).alias("mae"), F.round("mse", 2).alias("mse"))


@query("m9_hour_from_coordinates", _hour_sql("real_end"))
def _(spark, sf):
    scaler, test, _, _, real = _hour_setup(spark, sf)
    return _hour_result(test, real, scaler)


@query("m10_fine_tune", _hour_sql("tuned_end"))
def _(spark, sf):
    scaler, test, sums, extra, real = _hour_setup(spark, sf)
    return _hour_result(test, linear.gradient_path(extra, sums["val"], real, 1e-4, [30], 5).at[30], scaler)


@query("m11_train_on_both", _hour_sql("both_end"))
def _(spark, sf):
    scaler, test, sums, extra, _ = _hour_setup(spark, sf)
    start = linear.initial_weights(4, 1, SEED + 1)
    path = linear.gradient_path(sums["train"] + extra, sums["val"], start, 1e-3, [30], 5)
    return _hour_result(test, path.at[30], scaler)


# ---- zone demand with the decomposed model ----

L = 8


def _part_windows(part):
    t = part
    return f"""
{t}_d AS (SELECT time_bucket(INTERVAL 15 MINUTE, k.tpep_pickup_datetime) AS slot_ts, z.zone, count(*) AS trips
  FROM k JOIN parts USING (week) JOIN zones z ON k.PULocationID = z.zone_id WHERE parts.part = '{t}' GROUP BY ALL),
{t}_g AS (SELECT s.slot_ts, hour(s.slot_ts) * 4 + minute(s.slot_ts) // 15 AS slot, z.zone, coalesce(d.trips, 0) AS trips
  FROM (SELECT unnest(generate_series((SELECT min(slot_ts) FROM {t}_d), (SELECT max(slot_ts) FROM {t}_d), INTERVAL 15 MINUTE)) AS slot_ts) s
  CROSS JOIN zones z LEFT JOIN {t}_d d ON d.slot_ts = s.slot_ts AND d.zone = z.zone),
{t}_m AS (SELECT slot_ts, (sum(trips) + any_value(slot)) / (count(*) + 1) AS v FROM {t}_g GROUP BY slot_ts),
{t}_x AS (SELECT slot_ts, {', '.join(f'lag(v, {L - k}) OVER (ORDER BY slot_ts) AS x{k}' for k in range(L))} FROM {t}_m),
{t}_w AS (SELECT x.*, g.zone, CAST(g.trips AS DOUBLE) AS y FROM {t}_x x JOIN {t}_g g USING (slot_ts) WHERE x0 IS NOT NULL)"""


_ZONE_SUMS = "+" + _WEEKS.strip() + "," + _part_windows("train")


@query("m12_channel_mean_windows", given("trips zones", _ZONE_SUMS + """
SELECT CAST(slot_ts AS VARCHAR) AS slot_ts, zone, round(x0, 6) AS x0, round(x7, 6) AS x7, y FROM train_w"""))
def _(spark, sf):
    w = linear.channel_mean_windows(part_grids(spark, sf)["train"], L)
    return w.select(text("slot_ts"), "zone", r6("x0"), r6("x7"), "y")


@query("m12_zone_sums", given("trips zones", _ZONE_SUMS + f"""
, sums AS ({sums_sql('train_w', L, 'zone')}) SELECT zone, n, y, round(x0, 4) AS x0, round(x0_x7, 4) AS x0_x7, round(x3_y, 4) AS x3_y, y_y FROM sums"""))
def _(spark, sf):
    w = linear.channel_mean_windows(part_grids(spark, sf)["train"], L)
    s = linear.sums_of_products(w, [f"x{k}" for k in range(L)], "y", ["zone"])
    return s.select("zone", "n", "y", *[F.round(c, 4).alias(c) for c in ("x0", "x0_x7", "x3_y")], "y_y")


def part_grids(spark, sf):
    z = fx.zones(spark, sf)
    parted = splits.split_by_weeks(named_trips(spark, sf))
    return {
        p: demand.demand_grid(checkpointed(demand.zone_demand(parted.filter(F.col("part") == p))), z) for p in ("train", "val")}


def _heads_sql(rate, epochs, zones=25, tag=""):
    """The two-headed model's epochs, one row per zone: heads s and t. ``tag``
    marks the tables of one trial."""
    smooth = moving_average_matrix(L)
    at = range(L + 1)
    draw = [linear.initial_weights(L, zones, SEED), linear.initial_weights(L, zones, SEED + 1)]
    order = sorted(f"NATION_{i}" for i in range(zones))
    values = ", ".join(
        "('" + z + "', " + ", ".join(_num(draw[0][i, c]) for i in at) + ", " + ", ".join(_num(draw[1][i, c]) for i in at) + ")"
        for c, z in enumerate(order))
    names = ["zone"] + [f"s{i}" for i in at] + [f"t{i}" for i in at]
    rest = [[(1.0 if i == j else 0.0) - smooth[j, i] for i in range(L)] for j in range(L)]
    merged = [" + ".join(f"{_num(rest[j][i])} * s{j} + {_num(smooth[j, i])} * t{j}" for j in range(L)) + f" AS w{i}" for i in range(L)]
    merged.append(f"s{L} + t{L} AS w{L}")
    grad = [f"2 / (g.n * {zones}) * (" + " + ".join(f"{_entry(i, j, L, 'g')} * q.w{j}" for j in at) + f" - {_zy(i, L, 'g')}) AS d{i}" for i in at]
    ds = [" + ".join(f"{_num(rest[j][i])} * d{i}" for i in range(L)) + f" AS ds{j}" for j in range(L)] + [f"d{L} AS ds{L}"]
    dt = [" + ".join(f"{_num(smooth[j, i])} * d{i}" for i in range(L)) + f" AS dt{j}" for j in range(L)] + [f"d{L} AS dt{L}"]
    heads = [f"{h}{i}" for h in "st" for i in at]
    state = heads + [f"m{h}" for h in heads] + [f"v{h}" for h in heads]
    keep = ", ".join(state)
    moved = ", ".join(
        f"m{h} + {_num(1 - 0.9)} * (d{h} - m{h}) AS m{h}, v{h} + {_num(1 - 0.999)} * (d{h} * d{h} - v{h}) AS v{h}" for h in heads)
    stepped = ", ".join(
        f"{h} - {_num(rate)} * (m{h} / (1 - pow({_num(0.9)}, e))) / (sqrt(v{h} / (1 - pow({_num(0.999)}, e))) + {_num(1e-8)}) AS {h}" for h in heads)
    mv = ", ".join([f"m{h}" for h in heads] + [f"v{h}" for h in heads])
    zero = ", ".join(f"{_num(0)} AS {c}{h}" for c in "mv" for h in heads)
    return f"""
st{tag}(e, zone, {keep}) AS (
  SELECT 0 AS e, zone, {', '.join(heads)}, {zero} FROM (VALUES {values}) i({', '.join(names)})
  UNION ALL
  SELECT e, zone, {stepped}, {mv} FROM (
    SELECT e, zone, {', '.join(heads)}, {moved} FROM (
      SELECT *, {', '.join(ds + dt)} FROM (
        SELECT q.*, {', '.join(grad)} FROM (SELECT e + 1 AS e, zone, {keep}, {', '.join(merged)} FROM st{tag} WHERE e < {epochs}) q JOIN sums g ON g.zone = q.zone) r) u) x),
fin{tag} AS (SELECT zone, {', '.join(merged)} FROM st{tag} WHERE e = {epochs})"""


@query("m12_train_zone_model", given("trips zones", _ZONE_SUMS + "," + _part_windows("val") + f""",
sums AS ({sums_sql('train_w', L, 'zone')}),""" + _heads_sql(0.01, 50) + f""",
sco AS (SELECT v.y, {_predicted('fin', [f'x{k}' for k in range(L)])} AS p FROM val_w v JOIN fin ON fin.zone = v.zone)
SELECT r2, smape, mae FROM ({_accuracy_sql('sco')}) q""").replace("WITH", "WITH RECURSIVE", 1))
def _(spark, sf):
    w = {p: checkpointed(linear.channel_mean_windows(g, L)) for p, g in part_grids(spark, sf).items()}
    out = zone_forecast.trial_metrics(spark, w["train"], w["val"], "real", [(0.01, 50)], SEED)
    return out.select(r6("r2"), r6("smape"), F.round("mae", 4).alias("mae"))


_TRIALS = linear.random_trials(6, SEED)


def _trials_sql():
    """Every trial trained on its own; R² over all zones and averaged over them."""
    each = [
        f"SELECT {i} AS trial, {_num(rate)} AS rate, {epochs} AS epochs, v.zone, v.y, "
        f"{_predicted(f'fin{i}', [f'x{k}' for k in range(L)])} AS p FROM val_w v JOIN fin{i} ON fin{i}.zone = v.zone"
        for i, (rate, epochs) in enumerate(_TRIALS)]
    return ",".join(_heads_sql(rate, epochs, tag=str(i)) for i, (rate, epochs) in enumerate(_TRIALS)) + f""",
sco AS ({' UNION ALL '.join(each)}),
per AS (SELECT trial, zone, var_pop(y) * count(y) AS sst, sum((y-p)*(y-p)) AS sse FROM sco GROUP BY 1, 2),
means AS (SELECT trial, round(avg(CASE WHEN sst <> 0 THEN 1 - sse / sst WHEN sse = 0 THEN 1 ELSE 0 END), 6) AS r2_mean FROM per GROUP BY 1)
SELECT 'real' AS kind, trial, rate, epochs, r2_mean, r2, smape, mae
FROM ({_accuracy_sql('sco', by='trial, rate, epochs')}) q JOIN means USING (trial)"""


@query("m13_zone_trials", given("trips zones", _ZONE_SUMS + "," + _part_windows("val") + f""",
sums AS ({sums_sql('train_w', L, 'zone')}),""" + _trials_sql()).replace("WITH", "WITH RECURSIVE", 1))
def _(spark, sf):
    w = {p: checkpointed(linear.channel_mean_windows(g, L)) for p, g in part_grids(spark, sf).items()}
    out = zone_forecast.trial_metrics(spark, w["train"], w["val"], "real", _TRIALS, SEED)
    return out.select("kind", "trial", "rate", "epochs", r6("r2_mean"), r6("r2"), r6("smape"), F.round("mae", 4).alias("mae"))


@query("m14_zone_forecast_experiment")
def _(spark, sf):
    return zone_forecast.run(
        fx.enriched(spark, sf), fx.zones(spark, sf), k=4, multiplier=1, trials=3, max_passes=8)


@query("m14_series_experiment")
def _(spark, sf):
    return series_models.run(fx.enriched(spark, sf), ks=(4,), multiplier=1, epochs=(50, 100), max_passes=8)
