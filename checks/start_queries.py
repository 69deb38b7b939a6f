"""Mixtures from drawn starts, followed in SQL from the first centre to the choice.

The points are whole numbers, so that their text, which the draws hash, is the
same in every engine.
"""

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.fixtures import SEED, u_sql
from checks.registry import query, r6
from tripcast.operators import mixture, results

XY = ["x", "y"]
RIDGE = 0.5

POINTS_SQL = """points AS MATERIALIZED (
  SELECT x, y, count(*) AS n FROM (
    SELECT CAST(l_quantity AS DOUBLE) AS x, floor(CAST(l_extendedprice AS DOUBLE) / 1000) AS y FROM lineitem) v GROUP BY ALL)"""


def points(spark, sf):
    rows = fx.table(spark, sf, "lineitem").selectExpr(
        "CAST(l_quantity AS DOUBLE) AS x", "CAST(floor(CAST(l_extendedprice AS DOUBLE) / 1000) AS DOUBLE) AS y")
    return mixture.fold_points(rows, XY)


def _gap(a, b):
    return f"(({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y))"


def drawn_sql(name, k, seed):
    """Tables ``name_0`` to ``name_k-1`` of one centre each and ``name`` of all."""
    steps = []
    for step in range(k):
        known = " UNION ALL ".join(f"SELECT x, y FROM {name}_{i}" for i in range(step))
        gap = f"(SELECT min({_gap('p', 'q')}) FROM ({known}) q)" if step else "1.0"
        steps.append(f"""{name}_{step} AS MATERIALIZED (
  SELECT {step} AS c, x, y FROM (SELECT p.*, {gap} AS gap, {u_sql(f'{SEED}/{seed}/{step}', 'p.x', 'p.y')} AS u FROM points p) v
  ORDER BY CASE WHEN gap > 0 THEN ln(gap * n) ELSE ln(n) - 1e6 END - ln(-ln(greatest(u, 1.1102230246251565e-16))) DESC, x, y LIMIT 1)""")
    return ",\n".join([*steps, f"{name} AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM {name}_{i}" for i in range(k)) + ")"])


def _parameters_sql(name, shares, kind, ridge):
    """Table ``name`` of parameters from a table of points with their share ``g`` of component ``c``."""
    product = "sxy / m - sx / m * (sy / m)" if kind == "full" else "0.0"
    return f"""{name}_s AS MATERIALIZED (
  SELECT c, sum(g) + 1e-10 AS m, sum(g * x) AS sx, sum(g * y) AS sy, sum(g * x * x) AS sxx, sum(g * x * y) AS sxy, sum(g * y * y) AS syy
  FROM {shares} GROUP BY c),
{name} AS MATERIALIZED (
  SELECT c, m / (SELECT sum(m) FROM {name}_s) AS w, sx / m AS mx, sy / m AS my, sxx / m - sx / m * (sx / m) + {ridge} AS a,
    {product} AS b, syy / m - sy / m * (sy / m) + {ridge} AS d FROM {name}_s)"""


def _joint_sql(before):
    return f"""SELECT p.x, p.y, p.n, q.c, ln(w) - ln(2 * pi()) - 0.5 * ln(a * d - b * b)
    - 0.5 * (d * (x - mx) * (x - mx) - 2 * b * (x - mx) * (y - my) + a * (y - my) * (y - my)) / (a * d - b * b) AS lp
  FROM points p CROSS JOIN {before} q"""


def fit_sql(name, k, kind, seed, passes, ridge=RIDGE):
    """Table ``name_p{passes}``: drawn centres, nearest-centre rounds, then expectation passes."""
    out = [drawn_sql(f"{name}_l0", k, seed)]
    for r in range(mixture.START_ROUNDS + 1):
        out.append(f"""{name}_n{r} AS MATERIALIZED (
  SELECT c, x, y, n AS g FROM (
    SELECT l.c, p.*, row_number() OVER (PARTITION BY p.x, p.y ORDER BY {_gap('p', 'l')}, l.c) AS nth FROM points p CROSS JOIN {name}_l{r} l) v
  WHERE nth = 1)""")
        if r < mixture.START_ROUNDS:
            out.append(f"""{name}_l{r + 1} AS MATERIALIZED (
  SELECT c, sum(g * x) / sum(g) AS x, sum(g * y) / sum(g) AS y FROM {name}_n{r} GROUP BY c)""")
    out.append(_parameters_sql(f"{name}_q", f"{name}_n{mixture.START_ROUNDS}", kind, ridge))
    out.append(f"""{name}_p0 AS MATERIALIZED (
  SELECT c, (w + 1e-6) / (SELECT sum(w + 1e-6) FROM {name}_q) AS w, mx, my, a, b, d FROM {name}_q)""")
    for i in range(passes):
        out.append(f"""{name}_g{i} AS MATERIALIZED (
  SELECT c, x, y, n * exp(lp - top) / sum(exp(lp - top)) OVER (PARTITION BY x, y) AS g
  FROM (SELECT *, max(lp) OVER (PARTITION BY x, y) AS top FROM ({_joint_sql(f'{name}_p{i}')}) j) v)""")
        out.append(_parameters_sql(f"{name}_p{i + 1}", f"{name}_g{i}", kind, ridge))
    return ",\n".join(out)


def run_sql(name, trial, k, kind, seed, passes):
    """The trial's row of the table of runs, rounded."""
    free = k - 1 + 2 * k + (3 * k if kind == "full" else 2 * k)
    return f"""SELECT {trial} AS trial, CAST({seed} AS BIGINT) AS seed, {k} AS k, '{kind}' AS kind, {passes} AS passes, false AS converged,
  round(ll, 3) AS log_likelihood, round({free} * ln(rows) - 2 * ll, 3) AS bic, round(2 * {free} - 2 * ll, 3) AS aic
FROM (SELECT sum(n * ll) AS ll, sum(n) AS rows FROM (
  SELECT x, y, n, max(lp) + ln(sum(exp(lp - top))) AS ll
  FROM (SELECT *, max(lp) OVER (PARTITION BY x, y) AS top FROM ({_joint_sql(f'{name}_p{passes}')}) j) v GROUP BY x, y, n) t) u"""


def _rounded(runs):
    return runs.select(
        "trial", "seed", "k", "kind", "passes", "converged",
        *[F.round(c, 3).alias(c) for c in ("log_likelihood", "bic", "aic")])


@query("m2_drawn_centres", f"WITH {POINTS_SQL},\n{drawn_sql('s', 6, 42)}\nSELECT c AS component, x, y FROM s")
def _(spark, sf):
    centres = mixture.spread_centres(points(spark, sf), XY, 6, f"{SEED}/42")
    return spark.createDataFrame(
        [(c, float(x), float(y)) for c, (x, y) in enumerate(centres)], "component int, x double, y double")


def rounds_sql(name, seed, many, rounds):
    """Tables ``name_0`` to ``name_{rounds}`` of the candidates of each round."""
    steps = []
    for step in range(rounds + 1):
        known = " UNION ALL ".join(f"SELECT x, y FROM {name}_{i}" for i in range(step))
        gap = f"(SELECT min({_gap('p', 'q')}) FROM ({known}) q)" if step else "1.0"
        steps.append(f"""{name}_{step} AS MATERIALIZED (
  SELECT {step} AS round, row_number() OVER (ORDER BY score DESC, x, y) AS place, x, y FROM (
    SELECT x, y, ln(gap * n) - ln(-ln(greatest(u, 1.1102230246251565e-16))) AS score
    FROM (SELECT p.*, {gap} AS gap, {u_sql(f'{seed}/{step}', 'p.x', 'p.y')} AS u FROM points p) v WHERE gap > 0) w
  ORDER BY score DESC, x, y LIMIT {many if step else 1})""")
    return ",\n".join(steps)


ROUNDS = [("42/1", 3), ("42/9", 8)]


@query("m2_candidate_rounds", f"WITH {POINTS_SQL},\n" + ",\n".join(
    rounds_sql(f"r{i}", seed, many, mixture.DRAW_ROUNDS) for i, (seed, many) in enumerate(ROUNDS)) + "\n" + "\nUNION ALL ".join(
    f"SELECT '{seed}' AS seed, CAST({many} * greatest({step} - 1, 0) + least({step}, 1) + place - 1 AS INT) AS place, x, y FROM r{i}_{step}"
    for i, (seed, many) in enumerate(ROUNDS) for step in range(mixture.DRAW_ROUNDS + 1)))
def _(spark, sf):
    found = mixture.draw_candidates(points(spark, sf), XY, dict(ROUNDS))
    return spark.createDataFrame(
        [(s, i, float(x), float(y)) for s, rows in found.items() for i, (x, y) in enumerate(rows)],
        "seed string, place int, x double, y double")


FITS = [(3, "full", 42), (4, "diag", 7)]


@query("m2_fit_drawn_start", f"WITH {POINTS_SQL},\n" + ",\n".join(
    fit_sql(f"f{i}", k, kind, seed, 3) for i, (k, kind, seed) in enumerate(FITS)) + "\n" + "\nUNION ALL ".join(f"""
SELECT {i} AS model, c AS component, '{kind}' AS kind, round(w, 6) AS weight, round(mx, 6) AS mx, round(my, 6) AS my,
  round(a, 5) AS vxx, round(b, 5) + 0.0 AS vxy, round(d, 5) AS vyy FROM f{i}_p3""" for i, (k, kind, seed) in enumerate(FITS)))
def _(spark, sf):
    fitted = mixture.fit_mixtures(
        points(spark, sf), XY, [mixture.Candidate(k, RIDGE, kind, seed) for k, kind, seed in FITS], 3, -1.0, start="drawn")
    tables = [m.to_table(spark, i) for i, (m, _) in enumerate(fitted)]
    spread = F.col("covariance")
    return tables[0].unionByName(tables[1]).select(
        "model", "component", "kind", r6("weight"), r6(F.col("mean")[0], "mx"), r6(F.col("mean")[1], "my"),
        F.round(spread[0], 5).alias("vxx"), (F.round(spread[1], 5) + F.lit(0.0)).alias("vxy"),
        F.round(spread[3], 5).alias("vyy"))


def trials_sql(trials, passes):
    fits = ",\n".join(fit_sql(f"f{i}", *trial, passes) for i, trial in enumerate(trials))
    runs = "\nUNION ALL ".join(run_sql(f"f{i}", i, *trial, passes) for i, trial in enumerate(trials))
    return f"WITH {POINTS_SQL},\n{fits},\nruns AS ({runs})\n"


def select(spark, sf, trials, passes):
    candidates = [mixture.Candidate(k, RIDGE, kind, seed) for k, kind, seed in trials]
    return mixture.select_mixture(points(spark, sf), XY, candidates, passes, -1.0, start="drawn").runs


SIZES = [(2, "full", 42), (4, "full", 42), (3, "diag", 42)]


@query("m6_select_drawn_start", trials_sql(SIZES, 2) + "SELECT * FROM runs")
def _(spark, sf):
    return _rounded(select(spark, sf, SIZES, 2))


SEEDS = [(3, "full", 1), (3, "full", 2), (2, "diag", 2), (3, "full", 3)]


@query("m7_best_of_drawn_seeds", trials_sql(SEEDS, 2) + "SELECT * FROM runs ORDER BY bic, aic LIMIT 1")
def _(spark, sf):
    return _rounded(results.best_by_information(select(spark, sf, SEEDS, 2)))
