"""Windows, splits and pairs of days."""

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.fixtures import given
from checks.registry import query, r6, text
from tripcast.functions.vectors import moving_average, trend_and_rest
from tripcast.operators import demand, splits, windows
from checks.demand_queries import named_trips

LENGTH = 8


def hour_series(spark, sf):
    return demand.day_hours(fx.trips(spark, sf).withColumn("trips", F.lit(1)))


def slot_series(spark, sf):
    return demand.day_slots(fx.trips(spark, sf).withColumn("trips", F.lit(1)))


_HOUR_WINDOWS = """+
n AS (SELECT date, slot, CAST(trips AS DOUBLE) AS v, row_number() OVER (ORDER BY date, slot) - 1 AS pos FROM day_hours),
w AS (SELECT pos, v AS x0, lead(v, 1) OVER (ORDER BY pos) AS x1, lead(v, 2) OVER (ORDER BY pos) AS x2, lead(v, 3) OVER (ORDER BY pos) AS x3,
      lead(v, 4) OVER (ORDER BY pos) AS y FROM n)
"""


@query("w1_sliding_windows", given("day_hours", _HOUR_WINDOWS + "SELECT * FROM w WHERE y IS NOT NULL"))
def _(spark, sf):
    return windows.sliding_windows(windows.with_position(hour_series(spark, sf)))


@query("w1_sliding_windows_long_series", """
WITH n AS (SELECT CAST(o_orderdate AS DATE) AS date, CAST(count(*) AS DOUBLE) AS v, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE)) - 1 AS pos FROM orders GROUP BY 1),
w AS (SELECT pos, v AS x0, lead(v, 1) OVER (ORDER BY pos) AS x1, lead(v, 2) OVER (ORDER BY pos) AS x2, lead(v, 3) OVER (ORDER BY pos) AS x3,
      lead(v, 4) OVER (ORDER BY pos) AS y FROM n)
SELECT * FROM w WHERE y IS NOT NULL""")
def _(spark, sf):
    daily = fx.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"), F.lit(1).alias("trips"))
    series = demand.trips_per(daily, ["date"]).withColumn("slot", F.lit(0))
    return windows.sliding_windows(windows.with_position(series), block=500)


def _lead(k, v="v", w="w"):
    return f"lead({v}, {k}) OVER {w}"


@query("w2_zone_windows", given("grid", f"""+
r AS (SELECT slot_ts, zone AS channel, CAST(trips AS DOUBLE) AS v, true AS zonal FROM grid
  UNION ALL SELECT DISTINCT slot_ts, 'slot', CAST(slot AS DOUBLE), false FROM grid),
x AS (SELECT slot_ts, channel, zonal, v AS x0, {', '.join(f'{_lead(k)} AS x{k}' for k in range(1, LENGTH))}, {_lead(LENGTH)} AS nxt
  FROM r WINDOW w AS (PARTITION BY channel ORDER BY slot_ts))
SELECT CAST(slot_ts AS VARCHAR) AS slot_ts, channel, {', '.join(f'x{k}' for k in range(LENGTH))},
  CASE WHEN zonal THEN nxt END AS y0 FROM x WHERE nxt IS NOT NULL"""))
def _(spark, sf):
    grid = demand.demand_grid(demand.zone_demand(named_trips(spark, sf)), fx.zones(spark, sf))
    return windows.zone_windows(grid, LENGTH, 1).drop("zonal").withColumn("slot_ts", F.col("slot_ts").cast("string"))


_PAIRS = """+
x AS (SELECT date, slot AS start, trips AS x0, lead(trips, 1) OVER w AS x1, lead(trips, 2) OVER w AS x2, lead(trips, 3) OVER w AS x3,
      lead(trips, 4) OVER w AS y, lead(slot, 4) OVER w AS last FROM {series} WINDOW w AS (PARTITION BY date ORDER BY slot)),
d AS (SELECT date, dense_rank() OVER (ORDER BY date) AS r FROM (SELECT DISTINCT date FROM {series}) z),
f AS (SELECT c.*, e.r FROM x c JOIN d e USING (date) WHERE last = start + 4),
p AS (SELECT CAST(a.date AS VARCHAR) AS date_train, CAST(b.date AS VARCHAR) AS date_val, a.start AS window_start_hour,
  a.start || ',' || (a.start+1) || ',' || (a.start+2) || ',' || (a.start+3) AS hours_used,
  a.x0 AS h0_train, b.x0 AS h0_val, a.x1 AS h1_train, b.x1 AS h1_val, a.x2 AS h2_train, b.x2 AS h2_val, a.x3 AS h3_train, b.x3 AS h3_val,
  a.y AS target_train, b.y AS target_val FROM f a JOIN f b ON b.r = a.r + 1 AND a.start = b.start)
"""


def _shown(pairs):
    return pairs.withColumns({c: F.col(c).cast("string") for c in ("date_train", "date_val")})


@query("w3_day_pairs", given("day_slots", _PAIRS.replace("{series}", "day_slots") + "SELECT * FROM p"))
def _(spark, sf):
    return _shown(windows.day_pairs(slot_series(spark, sf)))


@query("w3_day_pairs_hourly", given("day_hours", _PAIRS.replace("{series}", "day_hours") + "SELECT * FROM p"))
def _(spark, sf):
    return _shown(windows.day_pairs(hour_series(spark, sf)))


@query("j9_next_present_day", """
WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), r AS (SELECT date, dense_rank() OVER (ORDER BY date) AS k FROM d)
SELECT CAST(a.date AS VARCHAR) AS date, CAST(b.date AS VARCHAR) AS next_date FROM r a JOIN r b ON b.k = a.k + 1""")
def _(spark, sf):
    days = windows.day_order(fx.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"), F.lit(1).alias("trips")))
    nexts = days.select(F.col("date").alias("next_date"), (F.col("day_rank") - 1).alias("day_rank"))
    return days.join(nexts, "day_rank").select(text("date"), text("next_date"))


_WEEKS = """
k AS (SELECT *, CAST(isoyear(tpep_pickup_datetime) AS VARCHAR) || '-' || lpad(CAST(week(tpep_pickup_datetime) AS VARCHAR), 2, '0') AS week FROM trips),
s AS (SELECT week, count(*) AS n FROM k GROUP BY week),
c AS (SELECT week, n, CAST(sum(n) OVER (ORDER BY week) AS BIGINT) AS upto, CAST(sum(n) OVER () AS BIGINT) AS total FROM s),
parts AS (SELECT *, CASE WHEN upto / total <= 0.6 THEN 'train' WHEN upto / total <= CAST(0.6 AS DOUBLE) + CAST(0.2 AS DOUBLE) THEN 'val' ELSE 'hold' END AS part FROM c)
"""


@query("w4_running_weeks", given("trips", "+" + _WEEKS + "SELECT week, n, upto, total FROM c"))
def _(spark, sf):
    return splits.running_weeks(splits.week_sizes(fx.trips(spark, sf)))


@query("w5_weekly_split", given("trips", "+" + _WEEKS + "SELECT week, part FROM parts"))
def _(spark, sf):
    return splits.week_parts(splits.week_sizes(fx.trips(spark, sf))).select("week", "part")


@query("j12_rows_by_part", given("trips", "+" + _WEEKS + "SELECT k.trip_id, parts.part FROM k JOIN parts USING (week)"))
def _(spark, sf):
    return splits.split_by_weeks(fx.trips(spark, sf)).select("trip_id", "part")


def _average_sql(j, kernel=25, length=4):
    reach = (kernel - 1) // 2
    taps = [min(max(t, 0), length - 1) for t in range(j - reach, j + reach + 1)]
    return "(" + " + ".join(f"{taps.count(i)}.0 * x{i}" for i in range(length)) + f") / {kernel}.0"


@query("w6_moving_average", given("day_hours", _HOUR_WINDOWS + "SELECT pos, " + ", ".join(
    f"round({_average_sql(j)}, 6) AS trend{j}" for j in range(4)) + " FROM w WHERE y IS NOT NULL"))
def _(spark, sf):
    w = windows.sliding_windows(windows.with_position(hour_series(spark, sf)))
    trend = moving_average([F.col(f"x{k}") for k in range(4)])
    return w.select("pos", *[r6(t, f"trend{k}") for k, t in enumerate(trend)])


@query("w7_trend_and_rest", given("day_hours", _HOUR_WINDOWS + "SELECT pos, " + ", ".join(
    f"round({_average_sql(j, 3)}, 6) AS trend{j}, round(x{j} - {_average_sql(j, 3)}, 6) + 0.0 AS rest{j}" for j in range(4)) + " FROM w WHERE y IS NOT NULL"))
def _(spark, sf):
    w = windows.sliding_windows(windows.with_position(hour_series(spark, sf)))
    trend, rest = trend_and_rest([F.col(f"x{k}") for k in range(4)], 3)
    return w.select(
        "pos", *[r6(t, f"trend{k}") for k, t in enumerate(trend)],
        *[(F.round(t, 6) + F.lit(0.0)).alias(f"rest{k}") for k, t in enumerate(rest)])


@query("w8_global_rank", """
SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS rank FROM orders""")
def _(spark, sf):
    from tripcast.operators.ranking import global_rank
    o = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    return global_rank(o, ["o_totalprice", "id"]).select("id", "rank")


@query("w8_global_rank_ties", """
SELECT event_id AS id, row_number() OVER (ORDER BY event_type, event_id) - 1 AS rank FROM events""")
def _(spark, sf):
    from tripcast.operators.ranking import global_rank
    e = fx.table(spark, sf, "events").select(F.col("event_id").alias("id"), "event_type")
    return global_rank(e, ["event_type", "id"]).select("id", "rank")


@query("w9_chronological_split", given("day_hours", _HOUR_WINDOWS + """
SELECT pos, CASE WHEN pos < floor(CAST(0.7 AS DOUBLE) * (SELECT count(*) FROM w WHERE y IS NOT NULL)) THEN 'train' ELSE 'val' END AS part FROM w WHERE y IS NOT NULL"""))
def _(spark, sf):
    w = windows.sliding_windows(windows.with_position(hour_series(spark, sf)))
    return windows.chronological_split(w).select("pos", "part")
