"""Seeded samples, dates, jitter and quantile mapping."""

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.fixtures import SEED, given, md5_sql, u_sql, z_sql
from checks.registry import query, r6, text
from tripcast.operators import dating, demand, ranking, sampling, splits
from tripcast.sources.trips import COORDINATES

KEYS = ["PULocationID", "DOLocationID", "hour"]


@query("g1_sample_share", given("trips", f"SELECT trip_id FROM trips WHERE {u_sql('42', 'trip_id')} < 0.5"))
def _(spark, sf):
    return sampling.sample_share(fx.trips(spark, sf), 0.5, "trip_id", SEED).select("trip_id")


@query("g1_sample_exact_share", given("trips", f"""
SELECT trip_id FROM (SELECT trip_id, row_number() OVER (ORDER BY {md5_sql('42', 'trip_id')}, trip_id) AS k, count(*) OVER () AS n FROM trips) x
WHERE k <= round_even(n * CAST(0.35 AS DOUBLE), 0)"""))
def _(spark, sf):
    return sampling.sample_exact_share(fx.trips(spark, sf), 0.35, "trip_id", SEED).select("trip_id")


@query("g2_random_parts", given("trips", f"""
SELECT trip_id, CASE WHEN {u_sql('42/test', 'trip_id')} < 0.15 THEN 'test' WHEN {u_sql('42/val', 'trip_id')} < 0.15 THEN 'val' ELSE 'train' END AS part FROM trips"""))
def _(spark, sf):
    return splits.random_parts(fx.trips(spark, sf), "trip_id", SEED).select("trip_id", "part")


_RANKED = f"""
ranked AS (SELECT trip_id, hour, row_number() OVER (PARTITION BY hour ORDER BY {md5_sql('42', 'trip_id')}, trip_id) AS k,
  count(*) OVER (PARTITION BY hour) AS n FROM {{source}})"""


def _draws(goal):
    """Rows of ``goal`` (hour, draws, n), each drawn by hash."""
    return f"""
j AS (SELECT hour, n, CAST(unnest(generate_series(1, draws)) AS BIGINT) AS j FROM {goal} WHERE draws > 0),
drawn AS (SELECT CAST(r.trip_id AS VARCHAR) || '#' || j.j AS trip_id, r.hour FROM j JOIN ranked r ON r.hour = j.hour
  AND r.k = CAST(floor({u_sql('42/draw', 'j.hour', 'j.j')} * j.n) AS BIGINT) + 1)"""


@query("g3_equal_frequency", given("reals synth", "+" + _RANKED.replace("{source}", "synth") + """,
goal AS (SELECT r.hour, count(*) AS goal FROM reals r GROUP BY 1),
plan AS (SELECT s.hour, g.goal, s.n, CASE WHEN g.goal > s.n THEN g.goal ELSE 0 END AS draws FROM (SELECT hour, count(*) AS n FROM synth GROUP BY 1) s JOIN goal g USING (hour)),""" + _draws("plan") + """
SELECT CAST(r.trip_id AS VARCHAR) AS trip_id, r.hour FROM ranked r JOIN plan p USING (hour) WHERE p.goal <= p.n AND r.k <= p.goal
UNION ALL SELECT trip_id, hour FROM drawn"""))
def _(spark, sf):
    s = fx.synth(spark, sf).select("trip_id", "hour")
    return sampling.equal_frequency(s, demand.trips_per_hour(fx.real(spark, sf)), "trip_id", SEED)


@query("g3_equal_frequency_with_replacement", given("reals synth", "+" + _RANKED.replace("{source}", "reals") + """,
plan AS (SELECT s.hour, g.goal, s.n, CASE WHEN g.goal > s.n THEN g.goal ELSE 0 END AS draws FROM (SELECT hour, count(*) AS n FROM reals GROUP BY 1) s
  JOIN (SELECT hour, count(*) AS goal FROM synth GROUP BY 1) g USING (hour)),""" + _draws("plan") + """
SELECT CAST(r.trip_id AS VARCHAR) AS trip_id, r.hour FROM ranked r JOIN plan p USING (hour) WHERE p.goal <= p.n AND r.k <= p.goal
UNION ALL SELECT trip_id, hour FROM drawn"""))
def _(spark, sf):
    r = fx.real(spark, sf).select("trip_id", "hour")
    return sampling.equal_frequency(r, demand.trips_per_hour(fx.synth(spark, sf)), "trip_id", SEED)


@query("g4_perturb_counts", given("synth", "+" + _RANKED.replace("{source}", "synth") + f""",
plan AS (SELECT hour, n, greatest(1, n + CAST(trunc({z_sql('42/noise', 'hour')} * (n * CAST(0.05 AS DOUBLE))) AS BIGINT)) AS goal,
  greatest(0, greatest(1, n + CAST(trunc({z_sql('42/noise', 'hour')} * (n * CAST(0.05 AS DOUBLE))) AS BIGINT)) - n) AS draws
  FROM (SELECT hour, count(*) AS n FROM synth GROUP BY 1) s),""" + _draws("plan") + """
SELECT CAST(r.trip_id AS VARCHAR) AS trip_id, r.hour FROM ranked r JOIN plan p USING (hour) WHERE r.k <= p.goal
UNION ALL SELECT trip_id, hour FROM drawn"""))
def _(spark, sf):
    return sampling.perturb_counts(fx.synth(spark, sf).select("trip_id", "hour"), "trip_id", SEED)


_CAP = f"""+
s AS (SELECT trip_id, PULocationID, DOLocationID, hour, trips, row_number() OVER (PARTITION BY PULocationID, DOLocationID, hour
   ORDER BY {md5_sql('42', 'trip_id')}, trip_id) AS k, count(*) OVER (PARTITION BY PULocationID, DOLocationID, hour) AS n FROM {{synth}}),
r AS (SELECT PULocationID, DOLocationID, hour, count(*) AS m FROM {{real}} GROUP BY ALL)
SELECT s.trip_id, s.PULocationID, s.DOLocationID, s.hour, s.trips FROM s JOIN r ON s.PULocationID IS NOT DISTINCT FROM r.PULocationID
  AND s.DOLocationID IS NOT DISTINCT FROM r.DOLocationID AND s.hour = r.hour
WHERE s.n <= ceil(m * CAST(1.1 AS DOUBLE)) OR s.k <= round_even(ceil(m * CAST(1.1 AS DOUBLE)) / n * n, 0)"""


@query("g5_cap_groups", given("reals synth", _CAP.replace("{synth}", "synth").replace("{real}", "reals")))
def _(spark, sf):
    return sampling.cap_groups(fx.synth(spark, sf), fx.real(spark, sf), "trip_id", SEED)


@query("j6_cap_groups_per_hour", given("reals synth", f"""+
s AS (SELECT trip_id, hour, row_number() OVER (PARTITION BY hour ORDER BY {md5_sql('42', 'trip_id')}, trip_id) AS k, count(*) OVER (PARTITION BY hour) AS n FROM synth),
r AS (SELECT hour, count(*) AS m FROM reals GROUP BY ALL)
SELECT s.trip_id, s.hour FROM s JOIN r USING (hour) WHERE s.n <= ceil(m * CAST(1.1 AS DOUBLE)) OR s.k <= round_even(ceil(m * CAST(1.1 AS DOUBLE)) / n * n, 0)"""))
def _(spark, sf):
    capped = sampling.cap_groups(fx.synth(spark, sf), fx.real(spark, sf), "trip_id", SEED, groups=["hour"])
    return capped.select("trip_id", "hour")


@query("g6_even_days", given("trips", f"""+
r AS (SELECT trip_id, CAST(tpep_pickup_datetime AS DATE) AS date, row_number() OVER (PARTITION BY CAST(tpep_pickup_datetime AS DATE)
  ORDER BY {md5_sql('42', 'trip_id')}, trip_id) AS k FROM trips)
SELECT trip_id, CAST(date AS VARCHAR) AS date FROM r WHERE k <= (SELECT min(n) FROM (SELECT count(*) AS n FROM r GROUP BY date) x)"""))
def _(spark, sf):
    t = fx.trips(spark, sf)
    fewest = demand.fewest_daily_trips(t).select("min_trips").scalar()
    kept = sampling.even_days(t, fewest, "trip_id", SEED)
    return kept.select("trip_id", text(F.to_date("tpep_pickup_datetime"), "date"))


_PROBABILITIES = """
c AS (SELECT hour, CAST(tpep_pickup_datetime AS DATE) AS date, count(*) AS n FROM {real} GROUP BY ALL),
p AS (SELECT hour, date, n, n / sum(n) OVER (PARTITION BY hour) AS p,
  (sum(n) OVER (PARTITION BY hour ORDER BY date) - n) / sum(n) OVER (PARTITION BY hour) AS lo,
  sum(n) OVER (PARTITION BY hour ORDER BY date) / sum(n) OVER (PARTITION BY hour) AS hi FROM c)"""


@query("a8_date_probabilities", given("reals", "+" + _PROBABILITIES.replace("{real}", "reals") + """
SELECT hour, CAST(date AS VARCHAR) AS date, n, round(p, 6) AS p, round(lo, 6) AS lo, round(hi, 6) AS hi FROM p"""))
def _(spark, sf):
    p = dating.date_probabilities(fx.trips(spark, sf))
    return p.select("hour", text("date"), "n", r6("p"), r6("lo"), r6("hi"))


_DATED = """
SELECT a.trip_id, a.hour, CAST(p.date AS VARCHAR) AS date FROM aimed a LEFT JOIN p ON p.hour = a.used AND a.u >= p.lo AND a.u < p.hi"""


def _aimed(source="synth"):
    return f""",
seen AS (SELECT list(DISTINCT hour ORDER BY hour) AS h FROM p),
aimed AS (SELECT trip_id, hour, {u_sql('42/date', 'trip_id')} AS u, CASE WHEN list_contains(h, hour) THEN hour
  ELSE h[CAST(floor({u_sql('42/hour', 'trip_id')} * len(h)) AS INT) + 1] END AS used FROM {source}, seen)"""


@query("j7_assign_dates", given("reals synth", "+" + _PROBABILITIES.replace("{real}", "reals") + _aimed() + _DATED))
def _(spark, sf):
    p = dating.date_probabilities(fx.trips(spark, sf))
    return dating.assign_dates(fx.synth(spark, sf), p, "trip_id", SEED).select("trip_id", "hour", text("date"))


@query("g7_assign_dates_unseen_hours", given("reals synth", """+
day AS (SELECT * FROM reals WHERE hour BETWEEN 6 AND 20),""" + _PROBABILITIES.replace("{real}", "day") + _aimed() + _DATED))
def _(spark, sf):
    daytime = fx.real(spark, sf).filter(F.col("hour").between(6, 20))
    p = dating.date_probabilities(daytime)
    return dating.assign_dates(fx.synth(spark, sf), p, "trip_id", SEED).select("trip_id", "hour", text("date"))


@query("g7_stamp_trips", given("reals synth", "+" + _PROBABILITIES.replace("{real}", "reals") + _aimed() + f"""
SELECT a.trip_id, CAST(CAST(p.date AS TIMESTAMP) + to_hours(a.hour) + to_minutes(CAST(floor({u_sql('42/quarter', 'a.trip_id')} * 4) * 15 AS INT)) AS VARCHAR) AS at
FROM aimed a JOIN p ON p.hour = a.used AND a.u >= p.lo AND a.u < p.hi"""))
def _(spark, sf):
    lookup = dating.DateLookup(dating.date_probabilities(fx.trips(spark, sf)))
    return dating.stamp(fx.synth(spark, sf), lookup, "trip_id", SEED).select("trip_id", text("tpep_pickup_datetime", "at"))


@query("g8_jitter", given("synth", "SELECT trip_id, " + ", ".join(
    f"round({c} + {z_sql('42/jitter', 'trip_id', which=i)} * CAST(0.0005 AS DOUBLE), 6) AS {c.lower()}" for i, c in enumerate(COORDINATES)) + " FROM synth"))
def _(spark, sf):
    moved = dating.jitter(fx.synth(spark, sf), "trip_id", SEED)
    return moved.select("trip_id", *[r6(c, c.lower()) for c in COORDINATES])


@query("g9_quarter_offset", given("synth", f"SELECT trip_id, CAST(floor({u_sql('42/quarter', 'trip_id')} * 4) * 15 AS INT) AS minutes FROM synth"))
def _(spark, sf):
    return dating.quarter_offset(fx.synth(spark, sf), "trip_id", SEED).select("trip_id", "minutes")


@query("g10_sample_pairs", given("synth", f"""
SELECT * FROM (SELECT DISTINCT PULocationID, DOLocationID FROM synth) x ORDER BY {md5_sql('42', 'PULocationID', 'DOLocationID')}, 1, 2 LIMIT 20"""))
def _(spark, sf):
    return sampling.sample_pairs(fx.synth(spark, sf), 20, ["PULocationID", "DOLocationID"], SEED)


def _mapped_sql(column, real="reals"):
    return f"""
s_{column} AS (SELECT trip_id, row_number() OVER (ORDER BY {column}, trip_id) - 1 AS i, count(*) OVER () AS ns FROM synth WHERE {column} IS NOT NULL),
r_{column} AS (SELECT {column} AS v, row_number() OVER (ORDER BY {column}, trip_id) - 1 AS j, count(*) OVER () AS nr FROM {real} WHERE {column} IS NOT NULL),
m_{column} AS (SELECT s.trip_id, round(r.v, 6) AS {column.lower()} FROM s_{column} s JOIN r_{column} r ON r.j = (s.i * r.nr) // s.ns)"""


@query("q1_quantile_map", given("reals synth", "+" + _mapped_sql("PU_longitude") + " SELECT * FROM m_PU_longitude"))
def _(spark, sf):
    m = ranking.quantile_map(fx.synth(spark, sf), fx.real(spark, sf), "PU_longitude", "trip_id", "trip_id")
    return m.select("trip_id", r6("PU_longitude", "pu_longitude"))


@query("j10_quantile_map_coordinates", given("reals synth", "+" + ",".join(_mapped_sql(c) for c in COORDINATES) + """
SELECT * FROM m_PU_longitude JOIN m_PU_latitude USING (trip_id) JOIN m_DO_longitude USING (trip_id) JOIN m_DO_latitude USING (trip_id)"""))
def _(spark, sf):
    m = ranking.quantile_map_coordinates(fx.synth(spark, sf), fx.real(spark, sf), "trip_id", "trip_id")
    return m.select("trip_id", *[r6(c, c.lower()) for c in COORDINATES])
