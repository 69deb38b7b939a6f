"""Zones, counts, unions and sorts."""

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.fixtures import given
from checks.registry import long, query, r6, text
from tripcast.operators import compare, demand, filters, sampling, zoning



def named_trips(spark, sf):
    return zoning.name_zones(fx.trips(spark, sf).withColumn("trips", F.lit(1)), fx.zones(spark, sf))


@query("j1_attach_centroids", given("enriched", """
SELECT trip_id, round(PU_longitude, 6) AS pu_lon, round(PU_latitude, 6) AS pu_lat, round(DO_longitude, 6) AS do_lon, round(DO_latitude, 6) AS do_lat FROM enriched"""))
def _(spark, sf):
    return fx.enriched(spark, sf).select(
        "trip_id", r6("PU_longitude", "pu_lon"), r6("PU_latitude", "pu_lat"),
        r6("DO_longitude", "do_lon"), r6("DO_latitude", "do_lat"))


def _box_sql(source, extra=""):
    return f"""+
pu AS (SELECT t.trip_id, arg_max(z.zone_id, z.ord) AS zone_id, arg_max(z.zone, z.ord) AS zone FROM {source} t
  JOIN zones z ON t.PU_longitude BETWEEN z.minx AND z.maxx AND t.PU_latitude BETWEEN z.miny AND z.maxy GROUP BY 1),
d AS (SELECT t.trip_id, arg_max(z.zone_id, z.ord) AS zone_id, arg_max(z.zone, z.ord) AS zone FROM {source} t
  JOIN zones z ON t.DO_longitude BETWEEN z.minx AND z.maxx AND t.DO_latitude BETWEEN z.miny AND z.maxy GROUP BY 1)
SELECT t.trip_id, coalesce(pu.zone_id, -1) AS pu_id, coalesce(d.zone_id, -1) AS do_id, pu.zone AS pu_zone, d.zone AS do_zone
FROM {source} t LEFT JOIN pu ON t.trip_id = pu.trip_id LEFT JOIN d ON t.trip_id = d.trip_id {extra}"""


def _located(df):
    known = lambda c: F.coalesce(c, F.lit(-1))
    return df.select(
        "trip_id", known("PULocationID").alias("pu_id"), known("DOLocationID").alias("do_id"), "pu_zone", "do_zone")


@query("j2_box_zone", given("enriched zones", _box_sql("enriched")))
def _(spark, sf):
    return _located(zoning.locate_trips(fx.enriched(spark, sf), fx.zones(spark, sf)))


@query("j2_box_zone_scattered", given("synth zones", _box_sql("synth")))
def _(spark, sf):
    return _located(zoning.locate_trips(fx.synth(spark, sf), fx.zones(spark, sf)))


@query("j2_box_zone_of_dropoff", given("synth zones", _box_sql("synth", "WHERE d.zone_id = 12")))
def _(spark, sf):
    return _located(zoning.locate_trips(fx.synth(spark, sf), fx.zones(spark, sf), None, 12))


@query("a1_trips_per_hour", given("reals", "SELECT hour, count(*) AS trips FROM reals GROUP BY hour"))
def _(spark, sf):
    return demand.trips_per_hour(fx.real(spark, sf))


@query("a2_trips_per_date_hour", given("day_hours", "SELECT CAST(date AS VARCHAR) AS date, slot AS hour, trips FROM day_hours"))
def _(spark, sf):
    t = fx.trips(spark, sf).withColumn("trips", F.lit(1))
    return demand.day_hours(t).select(text("date"), F.col("slot").alias("hour"), "trips")


@query("a3_day_slots", given("day_slots", """
SELECT CAST(CAST(date AS TIMESTAMP) + to_minutes(slot * 15) AS VARCHAR) AS slot_ts, slot, trips FROM day_slots"""))
def _(spark, sf):
    t = fx.trips(spark, sf).withColumn("trips", F.lit(1))
    return demand.day_slots(t).select(text("slot_ts"), "slot", "trips")


@query("a3_day_hours", given("day_hours", """
SELECT CAST(CAST(date AS TIMESTAMP) + to_hours(slot) AS VARCHAR) AS slot_ts, slot, trips FROM day_hours"""))
def _(spark, sf):
    t = fx.trips(spark, sf).withColumn("trips", F.lit(1))
    return demand.day_hours(t).select(text("slot_ts"), "slot", "trips")


@query("a4_od_hour_trips", given("reals zones", """
SELECT p.zone AS pu_zone, d.zone AS do_zone, t.hour, count(*) AS trips FROM reals t
JOIN zones p ON t.PULocationID = p.zone_id JOIN zones d ON t.DOLocationID = d.zone_id GROUP BY ALL"""))
def _(spark, sf):
    named = zoning.name_zones(fx.real(spark, sf), fx.zones(spark, sf))
    return demand.od_hour_trips(named, "pu_zone", "do_zone")


@query("a5_demand_grid", given("grid", "SELECT CAST(slot_ts AS VARCHAR) AS slot_ts, slot, ord, zone, trips FROM grid"))
def demand_grid(spark, sf):
    counted = demand.zone_demand(named_trips(spark, sf))
    return demand.demand_grid(counted, fx.zones(spark, sf)).select(text("slot_ts"), "slot", "ord", "zone", "trips")


def _wide_sql(sf_zones=25):
    cols = ", ".join(f"max(CASE WHEN zone = 'NATION_{i}' THEN trips END) AS \"NATION_{i}\"" for i in range(sf_zones))
    return f"SELECT CAST(slot_ts AS VARCHAR) AS slot_ts, {cols} FROM grid GROUP BY slot_ts"


@query("a5_demand_wide", given("grid", _wide_sql()))
def _(spark, sf):
    z = fx.zones(spark, sf)
    grid = demand.demand_grid(demand.zone_demand(named_trips(spark, sf)), z)
    names = [r["zone"] for r in z.orderBy("ord").select("zone").collect()]   # the zone dimension's column list
    return demand.zone_columns(grid, names).withColumn("slot_ts", F.col("slot_ts").cast("string"))


@query("w10_gap_fill_study_days", given("trips zones", """+
kept AS (SELECT * FROM trips WHERE isodow(tpep_pickup_datetime) BETWEEN 1 AND 3),
dem AS (SELECT time_bucket(INTERVAL 15 MINUTE, t.tpep_pickup_datetime) AS slot_ts, z.zone, count(*) AS trips
  FROM kept t JOIN zones z ON t.PULocationID = z.zone_id GROUP BY ALL)
SELECT CAST(s.slot_ts AS VARCHAR) AS slot_ts, z.zone, CAST(coalesce(d.trips, 0) AS INT) AS trips
FROM (SELECT unnest(generate_series((SELECT min(slot_ts) FROM dem), (SELECT max(slot_ts) FROM dem), INTERVAL 15 MINUTE)) AS slot_ts) s
CROSS JOIN zones z LEFT JOIN dem d ON d.slot_ts = s.slot_ts AND d.zone = z.zone"""))
def _(spark, sf):
    counted = demand.zone_demand(filters.study_period(named_trips(spark, sf)))
    return demand.demand_grid(counted, fx.zones(spark, sf)).select(text("slot_ts"), "zone", "trips")


@query("w10_gap_fill_observed_days", given("trips zones", """+
kept AS (SELECT * FROM trips WHERE isodow(tpep_pickup_datetime) BETWEEN 1 AND 3),
dem AS (SELECT time_bucket(INTERVAL 15 MINUTE, t.tpep_pickup_datetime) AS slot_ts, z.zone, count(*) AS trips
  FROM kept t JOIN zones z ON t.PULocationID = z.zone_id GROUP BY ALL)
SELECT CAST(s.slot_ts AS VARCHAR) AS slot_ts, z.zone, CAST(coalesce(d.trips, 0) AS INT) AS trips
FROM (SELECT unnest(generate_series((SELECT min(slot_ts) FROM dem), (SELECT max(slot_ts) FROM dem), INTERVAL 15 MINUTE)) AS slot_ts) s
CROSS JOIN zones z LEFT JOIN dem d ON d.slot_ts = s.slot_ts AND d.zone = z.zone
WHERE CAST(s.slot_ts AS DATE) IN (SELECT CAST(slot_ts AS DATE) FROM dem)"""))
def _(spark, sf):
    counted = demand.zone_demand(filters.study_period(named_trips(spark, sf)))
    grid = demand.demand_grid(counted, fx.zones(spark, sf), only_observed_days=True)
    return grid.select(text("slot_ts"), "zone", "trips")


def _nation_od(spark, sf):
    t = lambda n: fx.table(spark, sf, n)
    lines = t("lineitem").select("l_orderkey", "l_suppkey")
    orders = t("orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(
        t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(
        t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(F.col("c_nationkey").alias("pu"), F.col("s_nationkey").alias("do"), F.lit(1).alias("trips"))


_OD_LINES = """SELECT c_nationkey AS pu, s_nationkey AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey"""


@query("a6_od_matrix", "SELECT pu, " + ", ".join(
    f"CAST(sum(CASE WHEN d = {i} THEN 1 ELSE 0 END) AS BIGINT) AS \"{i}\"" for i in range(25)) + f" FROM ({_OD_LINES}) x GROUP BY pu")
def _(spark, sf):
    od = demand.od_trips(_nation_od(spark, sf), "pu", "do")
    return demand.od_matrix(od, list(range(25)), "pu", "do")


@query("a6_od_submatrix", f"""
WITH od AS (SELECT pu, d, count(*) AS trips FROM ({_OD_LINES}) x GROUP BY ALL),
pairs AS (SELECT pu, d FROM od ORDER BY md5('42:' || pu || ':' || d), pu, d LIMIT 20)
SELECT p.pu, q.d AS "do", coalesce(od.trips, 0) AS trips FROM (SELECT DISTINCT pu FROM pairs) p CROSS JOIN (SELECT DISTINCT d FROM pairs) q
LEFT JOIN od ON od.pu = p.pu AND od.d = q.d""")
def _(spark, sf):
    od = demand.od_trips(_nation_od(spark, sf), "pu", "do")
    pairs = sampling.sample_pairs(od, 20, ["pu", "do"], 42)
    return demand.od_submatrix(od, pairs, "pu", "do")


@query("a7_day_slot_matrix", given("day_slots", "SELECT CAST(date AS VARCHAR) AS date, " + ", ".join(
    f"CAST(max(CASE WHEN slot = {i} THEN trips END) AS DOUBLE) AS s{i}" for i in range(96)) + " FROM day_slots GROUP BY date"))
def _(spark, sf):
    s = demand.day_slots(fx.trips(spark, sf).withColumn("trips", F.lit(1)))
    wide = demand.day_slot_matrix(s)
    return wide.select(text("date"), *[F.col(f"s{i}").cast("double").alias(f"s{i}") for i in range(96)])


@query("a7_day_hour_matrix", given("day_hours", "SELECT CAST(date AS VARCHAR) AS date, " + ", ".join(
    f"CAST(max(CASE WHEN slot = {i} THEN trips END) AS DOUBLE) AS h{i}" for i in range(24)) + " FROM day_hours GROUP BY date"))
def _(spark, sf):
    s = demand.day_hours(fx.trips(spark, sf).withColumn("trips", F.lit(1)))
    wide = demand.day_slot_matrix(s, 24, "h")
    return wide.select(text("date"), *[F.col(f"h{i}").cast("double").alias(f"h{i}") for i in range(24)])


@query("a9_fewest_daily_trips", given("trips", "SELECT min(n) AS min_trips FROM (SELECT count(*) AS n FROM trips GROUP BY CAST(tpep_pickup_datetime AS DATE)) x"))
def _(spark, sf):
    return demand.fewest_daily_trips(fx.trips(spark, sf))


@query("a10_rows_per_week", given("trips", """
SELECT CAST(isoyear(tpep_pickup_datetime) AS VARCHAR) || '-' || lpad(CAST(week(tpep_pickup_datetime) AS VARCHAR), 2, '0') AS week, count(*) AS n FROM trips GROUP BY 1"""))
def _(spark, sf):
    from tripcast.operators.splits import week_sizes
    return week_sizes(fx.trips(spark, sf))


@query("a14_total_gap", given("trips synth", """
SELECT (SELECT count(*) FROM synth) AS synth_total, (SELECT count(*) FROM trips) AS real_total,
       round((SELECT count(*) FROM synth) / (SELECT count(*) FROM trips) - 1.0, 6) AS gap"""))
def _(spark, sf):
    gap = compare.total_gap(fx.synth(spark, sf), fx.trips(spark, sf).withColumn("trips", F.lit(1)))
    return gap.select(long("synth_total"), long("real_total"), r6("gap"))


@query("a15_compare_hours", given("reals synth", """
SELECT h.hour, coalesce(r.n, 0) AS real_trips, coalesce(s.n, 0) AS synth_trips,
       CASE WHEN coalesce(r.n, 0) <> 0 THEN round((coalesce(s.n, 0) - r.n) / r.n * 100, 6) END AS diff_pct
FROM (SELECT CAST(unnest(range(24)) AS INT) AS hour) h LEFT JOIN (SELECT hour, count(*) AS n FROM reals GROUP BY 1) r ON r.hour = h.hour
LEFT JOIN (SELECT hour, count(*) AS n FROM synth GROUP BY 1) s ON s.hour = h.hour"""))
def _(spark, sf):
    c = compare.compare_hours(fx.real(spark, sf), fx.synth(spark, sf))
    return c.select("hour", "real_trips", "synth_trips", r6("diff_pct"))


@query("a16_add_series", given("day_hours", """
SELECT CAST(date AS VARCHAR) AS date, slot, CAST(sum(trips) AS BIGINT) AS trips FROM (
  SELECT date, slot, trips FROM day_hours UNION ALL
  SELECT DATE '2024-01-01' + CAST(o_orderkey % 40 AS INT), CAST(o_custkey % 24 AS INT), count(*) FROM orders GROUP BY ALL) x GROUP BY ALL"""))
def _(spark, sf):
    a = demand.day_hours(fx.trips(spark, sf).withColumn("trips", F.lit(1))).select("date", "slot", "trips")
    o = fx.table(spark, sf, "orders").selectExpr(
        "date_add(DATE '2024-01-01', CAST(o_orderkey % 40 AS INT)) AS date", "CAST(o_custkey % 24 AS INT) AS slot", "1 AS trips")
    return demand.add_series(a, demand.trips_per(o, ["date", "slot"])).select(text("date"), "slot", "trips")


@query("a20_distinct_groups", given("reals", """
SELECT (SELECT count(*) FROM (SELECT DISTINCT PULocationID, DOLocationID FROM reals) x) AS od_pairs,
       (SELECT count(*) FROM (SELECT DISTINCT PULocationID, DOLocationID, hour FROM reals) x) AS groups"""))
def _(spark, sf):
    r = fx.real(spark, sf)
    groups = demand.rows_per(r, ["PULocationID", "DOLocationID", "hour"])
    pairs = groups.groupBy("PULocationID", "DOLocationID").agg(F.count(F.lit(1)).alias("hours"))
    return pairs.agg(F.count(F.lit(1)).alias("od_pairs"), F.sum("hours").alias("groups"))


@query("j4_compare_groups", given("reals synth", """
SELECT coalesce(r.PULocationID, s.PULocationID) AS PULocationID, coalesce(r.DOLocationID, s.DOLocationID) AS DOLocationID,
       coalesce(r.hour, s.hour) AS hour, coalesce(r.n, 0) AS real_trips, coalesce(s.n, 0) AS synth_trips
FROM (SELECT PULocationID, DOLocationID, hour, count(*) AS n FROM reals GROUP BY ALL) r
FULL JOIN (SELECT PULocationID, DOLocationID, hour, count(*) AS n FROM synth GROUP BY ALL) s
  ON r.PULocationID = s.PULocationID AND r.DOLocationID = s.DOLocationID AND r.hour = s.hour"""))
def _(spark, sf):
    return compare.compare_groups(fx.real(spark, sf), fx.synth(spark, sf))


@query("t1_sort_by_time", given("trips", "SELECT trip_id, PULocationID FROM trips ORDER BY tpep_pickup_datetime, trip_id"))
def _(spark, sf):
    return fx.trips(spark, sf).orderBy("tpep_pickup_datetime", "trip_id").select("trip_id", "PULocationID")


@query("u1_union_all", given("trips synth", """
SELECT 'real' AS source, trip_id, PULocationID, DOLocationID FROM trips UNION ALL SELECT 'synthetic', trip_id, PULocationID, DOLocationID FROM synth"""))
def _(spark, sf):
    cut = lambda df, s: df.select(F.lit(s).alias("source"), "trip_id", "PULocationID", "DOLocationID")
    return cut(fx.trips(spark, sf), "real").unionByName(cut(fx.synth(spark, sf), "synthetic"))


@query("u2_distinct_pairs", given("trips", "SELECT DISTINCT PULocationID, DOLocationID FROM trips"))
def _(spark, sf):
    return demand.od_pairs(fx.trips(spark, sf))


@query("u3_zone_difference", given("trips zones", """
SELECT PULocationID AS zone_id FROM trips EXCEPT SELECT zone_id FROM zones"""))
def _(spark, sf):
    used = fx.trips(spark, sf).select(F.col("PULocationID").alias("zone_id"))
    return used.subtract(fx.zones(spark, sf).select("zone_id"))
