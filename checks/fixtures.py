"""The given tables seen as zones, real trips and synthetic trips.

``events`` are the real trips and ``orders`` the synthetic ones; both are used
whole. Two pickup ids have no zone. Zone boxes overlap on purpose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tripcast.operators.filters import with_trip_columns
from tripcast.operators.zoning import attach_centroids

SEED = 42


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def zones(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").selectExpr(
        "n_nationkey AS ord", "n_nationkey AS zone_id", "n_name AS zone",
        "-74.25D + 0.1D * (n_nationkey % 5) AS cx",
        "40.5D + 0.08D * CAST(floor(n_nationkey / 5) AS INT) AS cy",
    ).selectExpr("*", "cx - 0.11D AS minx", "cx + 0.11D AS maxx", "cy - 0.09D AS miny", "cy + 0.09D AS maxy")


def trips(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "event_id AS trip_id", "ts AS tpep_pickup_datetime",
        "CAST(user_id % 27 AS INT) AS PULocationID", "CAST(event_id % 25 AS INT) AS DOLocationID")


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    return attach_centroids(trips(spark, sf), zones(spark, sf))


def real(spark: SparkSession, sf: str) -> DataFrame:
    return with_trip_columns(enriched(spark, sf))


def synth(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey AS trip_id", "CAST(o_custkey % 24 AS INT) AS hour",
        "CAST(o_custkey % 27 AS INT) AS PULocationID", "CAST(o_orderkey % 25 AS INT) AS DOLocationID",
        "-74.4D + o_totalprice / 600000D AS PU_longitude",
        "40.4D + (o_totalprice - 1000D * floor(o_totalprice / 1000D)) / 1500D AS PU_latitude",
        "-74.4D + (o_totalprice - 1000D * floor(o_totalprice / 1000D)) / 1200D AS DO_longitude",
        "40.4D + o_totalprice / 900000D AS DO_latitude", "1 AS trips")


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Long metric table: forecasts of a line's price from its quantity, per
    return flag, line number, ship year and discount."""
    from tripcast.operators.metrics import accuracy, as_long

    lines = table(spark, sf, "lineitem").selectExpr(
        "l_returnflag AS data_type", "l_linenumber AS nc", "year(l_shipdate) AS epochs",
        "CAST(round(l_discount * 100) AS INT) AS seed", "l_extendedprice AS y", "l_quantity * 1499.7182818 AS p")
    keys = ["data_type", "nc", "epochs", "seed"]
    return as_long(accuracy(lines, "y", "p", keys), keys)


# ---- the same, as SQL ----

_CTES = {
    "zones": """SELECT *, cx - CAST(0.11 AS DOUBLE) AS minx, cx + CAST(0.11 AS DOUBLE) AS maxx,
       cy - CAST(0.09 AS DOUBLE) AS miny, cy + CAST(0.09 AS DOUBLE) AS maxy
  FROM (SELECT n_nationkey AS ord, n_nationkey AS zone_id, n_name AS zone,
       CAST(-74.25 AS DOUBLE) + CAST(0.1 AS DOUBLE) * (n_nationkey % 5) AS cx,
       CAST(40.5 AS DOUBLE) + CAST(0.08 AS DOUBLE) * CAST(floor(n_nationkey / 5) AS INT) AS cy FROM nation) z""",
    "trips": """SELECT event_id AS trip_id, ts AS tpep_pickup_datetime,
       CAST(user_id % 27 AS INT) AS PULocationID, CAST(event_id % 25 AS INT) AS DOLocationID FROM events""",
    "enriched": """SELECT t.*, p.cx AS PU_longitude, p.cy AS PU_latitude, d.cx AS DO_longitude, d.cy AS DO_latitude
  FROM trips t LEFT JOIN zones p ON t.PULocationID = p.zone_id LEFT JOIN zones d ON t.DOLocationID = d.zone_id""",
    "reals": """SELECT *, CAST(hour(tpep_pickup_datetime) AS INT) AS hour,
       CAST(isodow(tpep_pickup_datetime) - 1 AS INT) AS weekday,
       sin(2 * pi() * hour(tpep_pickup_datetime) / 24) AS sin_hr,
       cos(2 * pi() * hour(tpep_pickup_datetime) / 24) AS cos_hr, 1 AS trips FROM enriched""",
    "synth": """SELECT o_orderkey AS trip_id, CAST(o_custkey % 24 AS INT) AS hour,
       CAST(o_custkey % 27 AS INT) AS PULocationID, CAST(o_orderkey % 25 AS INT) AS DOLocationID,
       CAST(-74.4 AS DOUBLE) + o_totalprice / CAST(600000 AS DOUBLE) AS PU_longitude,
       CAST(40.4 AS DOUBLE) + (o_totalprice - 1000 * floor(o_totalprice / 1000)) / CAST(1500 AS DOUBLE) AS PU_latitude,
       CAST(-74.4 AS DOUBLE) + (o_totalprice - 1000 * floor(o_totalprice / 1000)) / CAST(1200 AS DOUBLE) AS DO_longitude,
       CAST(40.4 AS DOUBLE) + o_totalprice / CAST(900000 AS DOUBLE) AS DO_latitude, 1 AS trips FROM orders""",
    "zone_demand": """SELECT time_bucket(INTERVAL 15 MINUTE, t.tpep_pickup_datetime) AS slot_ts, z.ord, z.zone, count(*) AS trips
  FROM trips t JOIN zones z ON t.PULocationID = z.zone_id GROUP BY ALL""",
    "grid": """SELECT s.slot_ts, CAST(hour(s.slot_ts) * 4 + minute(s.slot_ts) // 15 AS INT) AS slot,
       z.ord, z.zone, CAST(coalesce(d.trips, 0) AS INT) AS trips
  FROM (SELECT unnest(generate_series((SELECT min(slot_ts) FROM zone_demand), (SELECT max(slot_ts) FROM zone_demand), INTERVAL 15 MINUTE)) AS slot_ts) s
  CROSS JOIN zones z LEFT JOIN zone_demand d ON d.slot_ts = s.slot_ts AND d.zone = z.zone""",
    "day_slots": """SELECT CAST(tpep_pickup_datetime AS DATE) AS date,
       CAST(hour(tpep_pickup_datetime) * 4 + minute(tpep_pickup_datetime) // 15 AS INT) AS slot, count(*) AS trips
  FROM trips GROUP BY ALL""",
    "day_hours": """SELECT CAST(tpep_pickup_datetime AS DATE) AS date, CAST(hour(tpep_pickup_datetime) AS INT) AS slot,
       count(*) AS trips FROM trips GROUP BY ALL""",
    "lines": """SELECT l_returnflag AS data_type, l_linenumber AS nc, CAST(year(l_shipdate) AS INT) AS epochs,
       CAST(round(l_discount * 100) AS INT) AS seed, l_extendedprice AS y, l_quantity * 1499.7182818 AS p FROM lineitem""",
    "wide_runs": """SELECT data_type, nc, epochs, seed, count(y) AS n,
       CASE WHEN count(y) > 1 THEN CASE WHEN var_pop(y) * count(y) = 0 THEN CASE WHEN sum((y-p)*(y-p)) = 0 THEN 1.0 ELSE 0.0 END
            ELSE 1 - sum((y-p)*(y-p)) / (var_pop(y) * count(y)) END END AS r2,
       avg(abs(y-p)) AS mae, avg((y-p)*(y-p)) AS mse, sqrt(avg((y-p)*(y-p))) AS rmse,
       CASE WHEN avg(CASE WHEN y <> 0 THEN abs((y-p)/y) END) * 100 <= 1e9
            THEN avg(CASE WHEN y <> 0 THEN abs((y-p)/y) END) * 100 END AS mape,
       100 * avg(2*abs(p-y)/(abs(y)+abs(p)+1e-8)) AS smape
  FROM lines GROUP BY data_type, nc, epochs, seed""",
    "results": """SELECT data_type, nc, epochs, seed, 'R²' AS metric, r2 AS value FROM wide_runs
  UNION ALL SELECT data_type, nc, epochs, seed, 'MAE', mae FROM wide_runs
  UNION ALL SELECT data_type, nc, epochs, seed, 'MSE', mse FROM wide_runs
  UNION ALL SELECT data_type, nc, epochs, seed, 'RMSE', rmse FROM wide_runs
  UNION ALL SELECT data_type, nc, epochs, seed, 'MAPE', mape FROM wide_runs
  UNION ALL SELECT data_type, nc, epochs, seed, 'SMAPE', smape FROM wide_runs""",
}
_NEEDS = {
    "enriched": ["trips", "zones"], "reals": ["enriched"], "zone_demand": ["trips", "zones"],
    "grid": ["zone_demand", "zones"], "day_slots": ["trips"], "day_hours": ["trips"],
    "wide_runs": ["lines"], "results": ["wide_runs"],
}


def _chain(name: str, into: list[str]) -> None:
    for need in _NEEDS.get(name, []):
        _chain(need, into)
    if name not in into:
        into.append(name)


def given(names: str, body: str) -> str:
    """``body`` after the named common tables (and those they need). A body may
    start with further tables: ``x AS (...), ... SELECT``, marked by ``+``."""
    order: list[str] = []
    for name in names.split():
        _chain(name, order)
    tables = ",\n".join(f"{n} AS (\n  {_CTES[n]}\n)" for n in order)
    body = body.strip()
    if body.startswith("+"):
        return f"WITH {tables},\n{body[1:].strip()}"
    return f"WITH {tables}\n{body}"


def u_sql(seed: str, *ids: str, word: int | None = None) -> str:
    """The hash uniform of ``tripcast.functions.hashing`` in SQL."""
    key = " || ':' || ".join([f"'{seed}'", *[f"CAST({i} AS VARCHAR)" for i in ids]])
    if word is None:
        return f"(('0x' || substr(md5({key}), 1, 13))::UBIGINT / 4503599627370496.0)"
    return f"(('0x' || substr(md5({key}), {1 + 8 * word}, 8))::UBIGINT / 4294967296.0)"


def md5_sql(seed: str, *ids: str) -> str:
    return "md5(" + " || ':' || ".join([f"'{seed}'", *[f"CAST({i} AS VARCHAR)" for i in ids]]) + ")"


def z_sql(seed: str, *ids: str, which: int = 0) -> str:
    """The hash normal number ``which`` (0 to 3) in SQL."""
    first = 2 * (which // 2)
    turn = "cos" if which % 2 == 0 else "sin"
    return (f"(sqrt(-2.0 * ln(1.0 - {u_sql(seed, *ids, word=first)}))"
            f" * {turn}(2.0 * pi() * {u_sql(seed, *ids, word=first + 1)}))")
