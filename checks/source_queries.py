"""Readers and writers, each written to the shared folder and read back."""

from pyspark.sql import functions as F

from checks import fixtures as fx, shape_files
from checks.fixtures import given
from checks.registry import long, query, r6, text
from tripcast.durable import new_folder
from tripcast.operators import compare, distance, mixture
from tripcast.functions.projection import Conic
from tripcast.sources import shapes, sinks, trips as trip_source, zones as zone_source


@query("s1_scan_trips", given("enriched", """
SELECT PULocationID AS pu, count(*) AS n, round(sum(PU_longitude), 6) AS lon FROM enriched GROUP BY 1"""))
def _(spark, sf):
    path = new_folder(spark, "enriched")
    sinks.write_parquet(fx.enriched(spark, sf).drop("trip_id"), path)
    back = trip_source.read_trips(spark, path, schema=trip_source.ENRICHED_SCHEMA)
    return back.groupBy(F.col("PULocationID").alias("pu")).agg(long(F.count(F.lit(1)), "n"), r6(F.sum("PU_longitude"), "lon"))


@query("s2_scan_months", given("trips", """
SELECT CAST(CAST(tpep_pickup_datetime AS DATE) AS VARCHAR) AS date, count(*) AS n, count(DISTINCT PULocationID) AS zones FROM trips GROUP BY 1"""))
def _(spark, sf):
    t = fx.trips(spark, sf)
    half = F.lit("2024-01-16").cast("timestamp_ntz")
    paths = []
    for part in (t.filter(F.col("tpep_pickup_datetime") < half), t.filter(F.col("tpep_pickup_datetime") >= half)):
        paths.append(new_folder(spark, "month"))
        wide = len(paths) == 2      # one month has zone ids of 64 bits
        sinks.write_parquet(part.withColumn("PULocationID", F.col("PULocationID").cast("long" if wide else "int")), paths[-1])
    both = trip_source.read_trips(spark, *paths)
    return both.groupBy(text(F.to_date("tpep_pickup_datetime"), "date")).agg(
        long(F.count(F.lit(1)), "n"), F.count_distinct("PULocationID").alias("zones"))


@query("s3_zone_csv", "SELECT n_nationkey AS ord, n_nationkey AS zone_id, n_name AS zone FROM nation")
def _(spark, sf):
    path = new_folder(spark, "zone-names")
    z = fx.zones(spark, sf).orderBy("ord").coalesce(1).select(F.col("zone_id").alias("LocationID"), "zone")
    sinks.write_csv(z, path)
    return zone_source.read_zone_names(spark, path)


@query("s4_zone_geometry", given("zones", """
SELECT zone_id, round(cx, 6) AS cx, round(cy, 6) AS cy, round(minx, 6) AS minx, round(maxx, 6) AS maxx, round(miny, 6) AS miny, round(maxy, 6) AS maxy FROM zones"""))
def _(spark, sf):
    corners = F.expr("""array(named_struct('seq', 0, 'lon', minx, 'lat', miny), named_struct('seq', 1, 'lon', maxx, 'lat', miny),
        named_struct('seq', 2, 'lon', maxx, 'lat', maxy), named_struct('seq', 3, 'lon', minx, 'lat', maxy),
        named_struct('seq', 4, 'lon', minx, 'lat', miny))""")
    vertices = fx.zones(spark, sf).select("zone_id", F.lit(0).alias("ring"), F.inline(corners))
    g = zone_source.zone_geometry(vertices)
    return g.select("zone_id", *[r6(c) for c in ("cx", "cy", "minx", "maxx", "miny", "maxy")])


# Around a zone's centre, in hundredths of a degree: an angle with a hole, and an island. Rings run clockwise, holes the other way.
_RINGS = [
    [(-9, -8), (-9, 8), (-2, 8), (-2, 0), (6, 0), (6, -8), (-9, -8)], [(-7, -6), (-4, -6), (-4, -3), (-7, -3), (-7, -6)],
    [(4, 3), (4, 7), (9, 7), (9, 3), (4, 3)]]
_RING_ROWS = ", ".join(f"({r}, {k}, {x}, {y})" for r, ring in enumerate(_RINGS) for k, (x, y) in enumerate(ring))


def _zone_files(spark, sf, projection):
    """The zones as polygon files, every fifth with a record without shape before it."""
    folder = new_folder(spark, "polygons")
    records, rows = [], []
    for z in fx.zones(spark, sf).orderBy("ord").collect():      # the 25 nations
        if z.ord % 5 == 0:
            records.append(None)
            rows.append((f"{1000 + z.ord}", "no shape", "0"))
        place = projection.from_degrees if projection else lambda lon, lat: (lon, lat)
        records.append([[place(z.cx + x / 100, z.cy + y / 100) for x, y in ring] for ring in _RINGS])
        rows.append((str(z.zone_id), z.zone, "0.5"))
    fields = [("LocationID", "N", 9, 0), ("zone", "C", 30, 0), ("share", "N", 9, 3)]
    shape_files.put(spark, f"{folder}/zones.shp", shape_files.shape_bytes(records))
    shape_files.put(spark, f"{folder}/zones.dbf", shape_files.attribute_bytes(fields, rows))
    shape_files.put(spark, f"{folder}/zones.prj", (shape_files.LONG_ISLAND if projection else 'GEOGCS["GCS_WGS_1984"]').encode())
    return f"{folder}/zones"


_POLYGON_SQL = given("zones", f"""+
v AS (SELECT z.zone_id, r.ring, r.seq, z.cx + r.x / 100.0 AS lon, z.cy + r.y / 100.0 AS lat, r.x / 100.0 AS x, r.y / 100.0 AS y, cx, cy
  FROM zones z CROSS JOIN (VALUES {_RING_ROWS}) r(ring, seq, x, y)),
e AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM v WINDOW w AS (PARTITION BY zone_id, ring ORDER BY seq)),
s AS (SELECT zone_id, any_value(cx) AS ox, any_value(cy) AS oy, min(lon) AS minx, max(lon) AS maxx, min(lat) AS miny, max(lat) AS maxy,
  sum(x * y1 - x1 * y) AS a, sum((x + x1) * (x * y1 - x1 * y)) AS mx, sum((y + y1) * (x * y1 - x1 * y)) AS my FROM e GROUP BY zone_id)
SELECT CAST(zone_id AS BIGINT) AS zone_id, round(ox + mx / (3 * a), 6) AS cx, round(oy + my / (3 * a), 6) AS cy,
  round(minx, 6) AS minx, round(maxx, 6) AS maxx, round(miny, 6) AS miny, round(maxy, 6) AS maxy FROM s""")


def _from_files(spark, sf, projection):
    stem = _zone_files(spark, sf, projection)
    found = shapes.read_projection(spark, f"{stem}.prj")
    g = zone_source.zone_geometry(shapes.read_zone_vertices(spark, stem, "LocationID", found))
    return g.select(long("zone_id"), *[r6(c) for c in ("cx", "cy", "minx", "maxx", "miny", "maxy")])


@query("s4_polygon_files", _POLYGON_SQL)
def _(spark, sf):
    return _from_files(spark, sf, None)


@query("s4_projected_polygon_files", _POLYGON_SQL)
def _(spark, sf):
    return _from_files(spark, sf, Conic.from_wkt(shape_files.LONG_ISLAND))


@query("s5_enriched_trips", given("enriched", """
SELECT trip_id, PULocationID, DOLocationID, round(PU_longitude, 6) AS pu_lon, round(PU_latitude, 6) AS pu_lat, round(DO_longitude, 6) AS do_lon, round(DO_latitude, 6) AS do_lat FROM enriched"""))
def _(spark, sf):
    path = new_folder(spark, "enriched")
    sinks.write_parquet(fx.enriched(spark, sf), path)
    back = spark.read.parquet(path)
    return back.select("trip_id", "PULocationID", "DOLocationID", r6("PU_longitude", "pu_lon"), r6("PU_latitude", "pu_lat"),
                       r6("DO_longitude", "do_lon"), r6("DO_latitude", "do_lat"))


@query("s6_comparison_csv", given("reals synth", """
SELECT coalesce(r.hour, s.hour) AS hour, coalesce(r.n, 0) AS real_trips, coalesce(s.n, 0) AS synth_trips
FROM (SELECT hour, count(*) AS n FROM reals GROUP BY 1) r FULL JOIN (SELECT hour, count(*) AS n FROM synth GROUP BY 1) s ON r.hour = s.hour"""))
def _(spark, sf):
    path = new_folder(spark, "comparison")
    table = compare.compare_groups(fx.real(spark, sf), fx.synth(spark, sf), ["hour"])
    sinks.write_csv(table, path)
    return sinks.read_csv(spark, path, table.schema)


def labelled(spark, sf, dims=64):
    """The embeddings with one column per dimension."""
    e = fx.table(spark, sf, "embeddings")
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(dims)])


PAIR_SQL = """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.label AS cluster, avg(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) AS m
  FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1)
"""


@query("s7_distances_tsv", PAIR_SQL + "SELECT cluster, round(m, 6) AS mean_distance FROM p")
def _(spark, sf):
    path = new_folder(spark, "distances")
    points = labelled(spark, sf).withColumnRenamed("label", "cluster")
    table = distance.mean_pair_distance(points, "cluster", [f"x{i}" for i in range(64)], clusters=range(10))
    sinks.write_csv(table, path, sep="\t")
    return sinks.read_csv(spark, path, table.schema, sep="\t").select("cluster", r6("mean_distance"))


@query("s8_runs_json", given("results", """
SELECT data_type, nc, epochs, seed, metric, round(value, 2) AS value FROM results"""))
def _(spark, sf):
    path = new_folder(spark, "runs")
    table = fx.results(spark, sf)
    sinks.write_json(table, path)
    return sinks.read_json(spark, path, table.schema).select("data_type", "nc", "epochs", "seed", "metric", F.round("value", 2).alias("value"))


@query("s9_model_table", """
WITH x AS (SELECT label, unnest(range(64)) AS i, unnest(embedding[1:64]) AS v FROM embeddings)
SELECT label AS component, i AS axis, round(avg(CAST(v AS DOUBLE)), 6) AS mean FROM x GROUP BY ALL""")
def _(spark, sf):
    from checks.mixture_queries import mixture_from_labels
    path = new_folder(spark, "model")
    model = mixture_from_labels(labelled(spark, sf), "label", [f"x{i}" for i in range(64)], "diag")
    sinks.save_model(model.to_table(spark), path)
    back = sinks.load_model(spark, path)
    restored = mixture.Mixture.from_rows(back.collect())
    table = restored.to_table(spark).select("component", F.posexplode("mean").alias("axis", "mean"))
    return table.select("component", long("axis"), r6("mean"))
