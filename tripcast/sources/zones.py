"""Zone dimensions: the names list and the polygons' boxes and centroids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

ZONE_SCHEMA = T.StructType([
    T.StructField("LocationID", T.IntegerType()),
    T.StructField("zone", T.StringType()),
])


def read_zone_names(spark: SparkSession, path: str) -> DataFrame:
    """``ord, zone_id, zone`` in file order.

    The file position of a row is (file, block start, row in block); the rows
    are a dimension, one per zone, so one window over them is fine.
    """
    rows = (
        spark.read.schema(ZONE_SCHEMA).option("header", True).csv(path)
        .select(
            F.col("LocationID").alias("zone_id"), "zone",
            F.col("_metadata.file_name").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    place = F.row_number().over(W.orderBy("file", "block", "row")) - 1
    return rows.select(place.alias("ord"), "zone_id", "zone")


def zone_geometry(vertices: DataFrame) -> DataFrame:
    """Box and centroid per zone from ``zone_id, ring, seq, lon, lat``.

    Each ring is closed (the last vertex repeats the first). Centroids are
    planar, in degrees; rings are signed, so holes drawn the other way round
    subtract. Coordinates are taken relative to the zone's corner first, which
    keeps the products small.
    """
    by_zone = W.partitionBy("zone_id")
    along = W.partitionBy("zone_id", "ring").orderBy("seq")
    local = vertices.select(
        "zone_id", "ring", "seq", "lon", "lat",
        F.min("lon").over(by_zone).alias("west"),
        F.min("lat").over(by_zone).alias("south"),
    ).withColumns({"x": F.col("lon") - F.col("west"), "y": F.col("lat") - F.col("south")})
    edges = local.withColumns({
        "x1": F.lead("x").over(along), "y1": F.lead("y").over(along),
    }).withColumn("cross", F.expr("x * y1 - x1 * y"))
    return (
        edges.groupBy("zone_id")
        .agg(
            F.min("lon").alias("minx"), F.max("lon").alias("maxx"),
            F.min("lat").alias("miny"), F.max("lat").alias("maxy"),
            F.sum("cross").alias("twice_area"),
            F.sum(F.expr("(x + x1) * cross")).alias("mx"),
            F.sum(F.expr("(y + y1) * cross")).alias("my"),
        )
        .select(
            "zone_id", "minx", "miny", "maxx", "maxy",
            F.expr("minx + mx / (3 * twice_area)").alias("cx"),
            F.expr("miny + my / (3 * twice_area)").alias("cy"),
        )
    )
