"""Scalar expressions and filters."""

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.fixtures import given
from checks.registry import long, query, r6, text
from tripcast.functions import timecols as tc
from tripcast.functions.vectors import growth_weighting, unscale_to_int
from tripcast.joins import join_same
from tripcast.operators import demand, filters, scaling, windows, zoning
from tripcast.sources.trips import PICKUP_TIME, require_columns

def ts():
    return F.col(PICKUP_TIME)


@query("p1_parse_timestamp", "SELECT o_orderkey AS id, CAST(CAST(CAST(o_orderdate AS VARCHAR) AS TIMESTAMP) + INTERVAL 1 HOUR AS VARCHAR) AS parsed FROM orders")
def _(spark, sf):
    written = fx.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("string").alias("t"))
    parsed = tc.parse_timestamp(F.col("t"))
    return written.select(F.col("o_orderkey").alias("id"), text(parsed + F.expr("INTERVAL 1 HOUR"), "parsed"))


@query("p2_hour_weekday_date", given("trips", """
SELECT trip_id, CAST(hour(tpep_pickup_datetime) AS INT) AS hour, CAST(isodow(tpep_pickup_datetime) - 1 AS INT) AS weekday,
       CAST(CAST(tpep_pickup_datetime AS DATE) AS VARCHAR) AS date FROM trips"""))
def _(spark, sf):
    return fx.trips(spark, sf).select(
        "trip_id", tc.hour_of(ts()).alias("hour"), tc.weekday_of(ts()).alias("weekday"), text(tc.date_of(ts()), "date"))


@query("p3_cyclic_hour", given("reals", "SELECT trip_id, round(sin_hr, 6) + 0.0 AS sin_hr, round(cos_hr, 6) + 0.0 AS cos_hr FROM reals"))
def _(spark, sf):
    s, c = tc.cyclic_hour(tc.hour_of(ts()))
    return fx.trips(spark, sf).select("trip_id", (F.round(s, 6) + 0.0).alias("sin_hr"), (F.round(c, 6) + 0.0).alias("cos_hr"))


@query("p4_decode_hour", given("reals", "SELECT trip_id, hour AS decoded FROM reals"))
def _(spark, sf):
    s, c = tc.cyclic_hour(tc.hour_of(ts()))
    return fx.trips(spark, sf).select("trip_id", tc.decode_hour(s, c).alias("decoded"))


@query("p5_quarter_hour_slot", given("trips", """
SELECT trip_id, CAST(hour(tpep_pickup_datetime) * 4 + minute(tpep_pickup_datetime) // 15 AS INT) AS slot FROM trips"""))
def _(spark, sf):
    return fx.trips(spark, sf).select("trip_id", tc.slot_of(ts()).alias("slot"))


@query("p6_floor_to_slot", given("trips", """
SELECT trip_id, CAST(time_bucket(INTERVAL 15 MINUTE, tpep_pickup_datetime) AS VARCHAR) AS slot_ts FROM trips"""))
def _(spark, sf):
    return fx.trips(spark, sf).select("trip_id", text(tc.floor_to_slot(ts()), "slot_ts"))


@query("p7_rebuild_timestamp", given("trips", """
SELECT trip_id, CAST(CAST(CAST(tpep_pickup_datetime AS DATE) AS TIMESTAMP)
       + to_hours(CAST(hour(tpep_pickup_datetime) AS INT)) + to_minutes(CAST(minute(tpep_pickup_datetime) AS INT)) AS VARCHAR) AS at FROM trips"""))
def _(spark, sf):
    return fx.trips(spark, sf).select(
        "trip_id", text(tc.at_time(tc.date_of(ts()), tc.hour_of(ts()), F.minute(ts())), "at"))


@query("p8_day_number", """
SELECT o_orderkey AS id, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 719163 AS INT) AS day_number,
       CAST(DATE '1970-01-01' + CAST(round_even(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 719163
            + o_totalprice / 500000.0, 0) - 719163 AS INT) AS VARCHAR) AS back FROM orders""")
def _(spark, sf):
    number = tc.day_number(tc.date_of(F.col("o_orderdate")))
    return fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), number.alias("day_number"),
        text(tc.date_from_day_number(number + F.col("o_totalprice") / F.lit(500000.0)), "back"))


@query("p9_unit_measure", given("reals", "SELECT weekday, CAST(sum(trips) AS BIGINT) AS trips FROM reals GROUP BY weekday"))
def _(spark, sf):
    return demand.trips_per(filters.with_trip_columns(fx.trips(spark, sf)), ["weekday"])


@query("p10_narrow_types", given("enriched", """
SELECT trip_id, CAST(PU_longitude AS FLOAT) AS pu_lon, CAST(trip_id AS INT) AS id32 FROM enriched WHERE PU_longitude IS NOT NULL"""))
def _(spark, sf):
    e = filters.complete(fx.enriched(spark, sf), ["PU_longitude"])
    return e.select("trip_id", F.col("PU_longitude").cast("float").alias("pu_lon"), F.col("trip_id").cast("int").alias("id32"))


@query("p11_iso_week_key", """
SELECT o_orderkey AS id, CAST(isoyear(o_orderdate) AS VARCHAR) || '-' || lpad(CAST(week(o_orderdate) AS VARCHAR), 2, '0') AS week FROM orders""")
def _(spark, sf):
    return fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), tc.iso_week_key(F.col("o_orderdate")).alias("week"))


def _growth_sql(source):
    d = lambda k: f"CASE WHEN abs(x{k}) > 1e-3 THEN x{k} ELSE 1e-3 END"
    w1 = f"(x1 / {d(0)})"
    w2, w3 = f"({w1} * (x2 / {d(1)}))", f"({w1} * (x2 / {d(1)}) * (x3 / {d(2)}))"
    return f"round(x0, 6) AS g0, round(x1 * {w1}, 6) AS g1, round(x2 * {w2}, 6) AS g2, round(x3 * {w3}, 6) AS g3 FROM {source}"


@query("p12_growth_weighting", given("day_slots", f"""+
x AS (SELECT date, slot AS start, CAST(trips AS DOUBLE) AS x0, CAST(lead(trips, 1) OVER w AS DOUBLE) AS x1, CAST(lead(trips, 2) OVER w AS DOUBLE) AS x2,
      CAST(lead(trips, 3) OVER w AS DOUBLE) AS x3, lead(slot, 4) OVER w AS last FROM day_slots WINDOW w AS (PARTITION BY date ORDER BY slot))
SELECT CAST(date AS VARCHAR) AS date, start, {_growth_sql('x')} WHERE last = start + 4"""))
def _(spark, sf):
    w = windows.day_windows(_day_slots(spark, sf))
    xs = growth_weighting([F.col(f"x{k}").cast("double") for k in range(4)])
    return w.select(text("date"), "start", *[r6(x, f"g{k}") for k, x in enumerate(xs)])


def _day_slots(spark, sf):
    return demand.day_slots(fx.trips(spark, sf).withColumn("trips", F.lit(1)))


@query("p13_window_label", given("trips", """
SELECT trip_id, h || ',' || (h+1) || ',' || (h+2) || ',' || (h+3) AS label FROM (SELECT trip_id, hour(tpep_pickup_datetime) AS h FROM trips) x"""))
def _(spark, sf):
    return fx.trips(spark, sf).select("trip_id", tc.window_label(tc.hour_of(ts()), 4).alias("label"))


@query("p14_zone_names", given("trips zones", """
SELECT trip_id, p.zone AS pu_zone, d.zone AS do_zone FROM trips t
LEFT JOIN zones p ON t.PULocationID = p.zone_id LEFT JOIN zones d ON t.DOLocationID = d.zone_id"""))
def _(spark, sf):
    return zoning.name_zones(fx.trips(spark, sf), fx.zones(spark, sf)).select("trip_id", "pu_zone", "do_zone")


@query("p15_rename_drop_select", """
SELECT event_id AS trip, user_id AS rider, event_type FROM events""")
def _(spark, sf):
    e = fx.table(spark, sf, "events").withColumnsRenamed({"event_id": "trip", "user_id": "rider"})
    return e.drop("props", "value", "ts")


@query("p16_fill_nulls", given("enriched", """
SELECT trip_id, round(coalesce(PU_longitude, 0), 6) AS pu_lon, round(coalesce(PU_latitude, 0), 6) AS pu_lat FROM enriched"""))
def _(spark, sf):
    e = fx.enriched(spark, sf).fillna(0.0, ["PU_longitude", "PU_latitude"])
    return e.select("trip_id", r6("PU_longitude", "pu_lon"), r6("PU_latitude", "pu_lat"))


@query("p17_null_safe_keys", given("trips zones", """+
named AS (SELECT p.zone AS pu_zone, d.zone AS do_zone FROM trips t LEFT JOIN zones p ON t.PULocationID = p.zone_id
  LEFT JOIN zones d ON t.DOLocationID = d.zone_id),
orders_named AS (SELECT p.zone AS pu_zone FROM (SELECT CAST(o_custkey % 27 AS INT) AS z FROM orders) o LEFT JOIN zones p ON o.z = p.zone_id)
SELECT coalesce(a.pu_zone, 'none') AS pu_zone, a.n AS n_real, b.n AS n_synth
FROM (SELECT pu_zone, count(*) AS n FROM named GROUP BY 1) a JOIN (SELECT pu_zone, count(*) AS n FROM orders_named GROUP BY 1) b
  ON a.pu_zone IS NOT DISTINCT FROM b.pu_zone"""))
def _(spark, sf):
    z = fx.zones(spark, sf)
    count = lambda df, n: demand.rows_per(zoning.name_zones(df, z), ["pu_zone"], n)
    both = join_same(count(fx.trips(spark, sf), "n_real"), count(fx.synth(spark, sf), "n_synth"), ["pu_zone"])
    return both.withColumn("pu_zone", F.coalesce("pu_zone", F.lit("none")))


@query("p18_unscale_to_int", given("reals", """+
m AS (SELECT avg(hour) AS mean, stddev_pop(hour) AS dev FROM reals)
SELECT trip_id, CAST(round_even((hour - mean) / dev * dev + mean, 0) AS INT) AS back FROM reals, m"""))
def _(spark, sf):
    r = fx.real(spark, sf)
    s = scaling.Scaler.fit(r, ["hour"])
    return s.transform(r).select("trip_id", unscale_to_int(F.col("hour"), s.means[0], s.scales[0]).alias("back"))


@query("f1_study_period", given("trips", """
SELECT trip_id FROM trips WHERE tpep_pickup_datetime >= '2024-01-01' AND tpep_pickup_datetime < '2024-03-01'
AND isodow(tpep_pickup_datetime) BETWEEN 1 AND 3"""))
def _(spark, sf):
    return filters.study_period(fx.trips(spark, sf)).select("trip_id")


@query("f2_weekday_range", given("trips", "SELECT trip_id FROM trips WHERE isodow(tpep_pickup_datetime) - 1 BETWEEN 1 AND 3"))
def _(spark, sf):
    return filters.on_weekdays(fx.trips(spark, sf), 1, 3).select("trip_id")


@query("f3_drop_incomplete", given("enriched", """
SELECT trip_id, PULocationID, DOLocationID FROM enriched WHERE PU_longitude IS NOT NULL AND PU_latitude IS NOT NULL
AND DO_longitude IS NOT NULL AND DO_latitude IS NOT NULL"""))
def _(spark, sf):
    e = filters.complete(fx.enriched(spark, sf), ["PU_longitude", "PU_latitude", "DO_longitude", "DO_latitude"])
    return e.select("trip_id", "PULocationID", "DOLocationID")


@query("f4_zone_whitelist", given("trips", "SELECT trip_id, PULocationID FROM trips WHERE PULocationID IN (4, 12, 13, 24)"))
def _(spark, sf):
    return filters.from_zones(fx.trips(spark, sf), [4, 12, 13, 24]).select("trip_id", "PULocationID")


@query("f5_hour_and_weekday", given("reals", "SELECT trip_id FROM reals WHERE hour = 18 AND weekday = 2"))
def _(spark, sf):
    return filters.at_hour_on(fx.real(spark, sf), 18, 2).select("trip_id")


@query("f6_trips_without_zone", given("trips zones", """
SELECT CAST(sum(CASE WHEN p.zone IS NULL OR d.zone IS NULL OR p.zone = '' OR d.zone = '' THEN 1 ELSE 0 END) AS BIGINT) AS trips_without_zone,
       count(*) AS trips
FROM trips t LEFT JOIN zones p ON t.PULocationID = p.zone_id LEFT JOIN zones d ON t.DOLocationID = d.zone_id"""))
def _(spark, sf):
    named = zoning.name_zones(fx.trips(spark, sf).withColumn("trips", F.lit(1)), fx.zones(spark, sf))
    return filters.trips_without_zone(named, "pu_zone", "do_zone")


@query("f7_pickup_else_dropoff", given("trips", """
SELECT 'pickup' AS kind, trip_id FROM trips WHERE PULocationID = 7 UNION ALL
SELECT 'dropoff', trip_id FROM trips WHERE DOLocationID = 9 UNION ALL SELECT 'any', trip_id FROM trips"""))
def _(spark, sf):
    t = fx.trips(spark, sf)
    named = lambda df, kind: df.select(F.lit(kind).alias("kind"), "trip_id")
    return (
        named(filters.of_zone(t, 7, 9), "pickup")
        .unionByName(named(filters.of_zone(t, None, 9), "dropoff")).unionByName(named(filters.of_zone(t), "any")))


@query("f8_required_columns", given("trips", "SELECT PULocationID, count(*) AS n FROM trips GROUP BY PULocationID"))
def _(spark, sf):
    t = require_columns(fx.trips(spark, sf), [PICKUP_TIME, "PULocationID"])
    return demand.rows_per(t, ["PULocationID"])


@query("f9_unknown_zones", """
SELECT DISTINCT c_mktsegment AS zone FROM customer WHERE c_mktsegment NOT IN (SELECT n_name FROM nation)""")
def _(spark, sf):
    return zoning.unknown_zones(fx.table(spark, sf, "customer"), fx.zones(spark, sf), "c_mktsegment")


@query("f9_known_zones_only", given("trips zones", """
SELECT z.zone AS pu_zone, count(*) AS n FROM trips t LEFT JOIN zones z ON t.PULocationID = z.zone_id GROUP BY 1"""))
def _(spark, sf):
    z = fx.zones(spark, sf)
    checked = zoning.require_known_zones(zoning.name_zones(fx.trips(spark, sf), z), z)
    return checked.groupBy("pu_zone").agg(long(F.count(F.lit(1)), "n"))
