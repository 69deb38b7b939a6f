"""Joining trips with zones, by id and by position.

Joins with the zone dimension carry no broadcast hint: Catalyst broadcasts the
dimension when its size is under ``spark.sql.autoBroadcastJoinThreshold`` and
otherwise shuffles, with the adaptive skew join splitting a hot zone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripcast.joins import small
from tripcast.sources.trips import DROPOFF_ZONE, PICKUP_ZONE

GRID = 64                      # cells per axis of the location index


def unique_zones(zones: DataFrame) -> DataFrame:
    """One row per zone id, the last by ``ord``."""
    rest = [c for c in zones.columns if c != "zone_id"]
    last = zones.groupBy("zone_id").agg(F.max_by(F.struct(*rest), "ord").alias("z"))
    return last.select("zone_id", *[F.col(f"z.{c}").alias(c) for c in rest])


def _lookup(trips: DataFrame, zones: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    side = zones.select(
        F.col("zone_id").alias("_zone_id"), *[F.col(c).alias(n) for c, n in columns.items()]
    )
    return trips.join(side, F.col(key) == F.col("_zone_id"), "left").drop("_zone_id")


def attach_centroids(trips: DataFrame, zones: DataFrame) -> DataFrame:
    """Add pickup and drop-off coordinates; an unknown zone gives nulls."""
    known = unique_zones(zones.select("ord", "zone_id", "cx", "cy"))
    trips = _lookup(trips, known, PICKUP_ZONE, {"cx": "PU_longitude", "cy": "PU_latitude"})
    return _lookup(trips, known, DROPOFF_ZONE, {"cx": "DO_longitude", "cy": "DO_latitude"})


def name_zones(
    trips: DataFrame, zones: DataFrame, pickup: str = PICKUP_ZONE, dropoff: str = DROPOFF_ZONE
) -> DataFrame:
    """Add ``pu_zone`` and ``do_zone``; an unknown id gives null."""
    known = unique_zones(zones.select("ord", "zone_id", "zone"))
    trips = _lookup(trips, known, pickup, {"zone": "pu_zone"})
    return _lookup(trips, known, dropoff, {"zone": "do_zone"})


def unknown_zones(df: DataFrame, zones: DataFrame, column: str = "pu_zone") -> DataFrame:
    """Zones used by the rows but absent from the dimension."""
    used = df.select(F.col(column).alias("zone")).where(F.col("zone").isNotNull()).distinct()
    return used.join(zones.select("zone"), "zone", "left_anti")


def require_known_zones(df: DataFrame, zones: DataFrame, column: str = "pu_zone") -> DataFrame:
    """Fail the job when a row names a zone the dimension lacks.

    The guard is a filter, which no later projection, count or aggregate prunes.
    """
    known = zones.select(F.col("zone").alias("_known")).distinct()
    checked = df.join(known, F.col(column) == F.col("_known"), "left")
    stray = F.col(column).isNotNull() & F.col("_known").isNull()
    message = F.concat(F.lit("zone not in the dimension: "), F.col(column).cast("string"))
    return checked.filter(F.when(stray, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))).drop("_known")


class BoxIndex:
    """Which zone box holds a point, as one equality join per point.

    The boxes' extent is cut into ``grid`` x ``grid`` cells. Each cell lists
    the boxes touching it, last zone first, so a point takes the first listed
    box that holds it: overlapping boxes resolve to the last zone, and the trip
    table is neither multiplied nor grouped. Cell numbers never fall as a
    coordinate rises, so no holding box is missed. Only the zone dimension is
    read when the index is made.
    """

    def __init__(self, zones: DataFrame, grid: int = GRID):
        extent = zones.agg(
            F.min("minx").alias("x0"), F.max("maxx").alias("x1"),
            F.min("miny").alias("y0"), F.max("maxy").alias("y1"),
        ).first()
        self.x0, self.y0 = extent["x0"] or 0.0, extent["y0"] or 0.0
        self.dx = ((extent["x1"] or 0.0) - self.x0) / grid or 1.0
        self.dy = ((extent["y1"] or 0.0) - self.y0) / grid or 1.0
        touched = (
            zones
            .withColumn("cell_x", F.explode(F.sequence(self._cx("minx"), self._cx("maxx"))))
            .withColumn("cell_y", F.explode(F.sequence(self._cy("miny"), self._cy("maxy"))))
        )
        boxes = touched.groupBy("cell_x", "cell_y").agg(
            F.sort_array(
                F.collect_list(F.struct("ord", "zone_id", "zone", "minx", "maxx", "miny", "maxy")),
                asc=False,
            ).alias("boxes")
        )
        self.cells = small(boxes, touched.count())     # more rows than cells: one for each listed box

    def _cx(self, x: str):
        return F.floor((F.col(x) - F.lit(self.x0)) / F.lit(self.dx))

    def _cy(self, y: str):
        return F.floor((F.col(y) - F.lit(self.y0)) / F.lit(self.dy))

    def locate(self, df: DataFrame, lon: str, lat: str, zone_id: str, zone: str) -> DataFrame:
        """Add the zone id and name of each point; null outside every box."""
        holds = lambda b: (
            (F.col(lon) >= b["minx"]) & (F.col(lon) <= b["maxx"])
            & (F.col(lat) >= b["miny"]) & (F.col(lat) <= b["maxy"])
        )
        hit = F.get(F.filter("boxes", holds), F.lit(0))
        placed = df.withColumns({"cell_x": self._cx(lon), "cell_y": self._cy(lat)})
        joined = placed.join(self.cells, ["cell_x", "cell_y"], "left").withColumn("_hit", hit)
        return joined.withColumns({
            zone_id: F.col("_hit.zone_id"), zone: F.col("_hit.zone"),
        }).drop("cell_x", "cell_y", "boxes", "_hit")


def locate_trips(
    trips: DataFrame, zones: DataFrame,
    pickup_id: int | None = None, dropoff_id: int | None = None,
) -> DataFrame:
    """Replace the zone ids by those of the boxes the coordinates fall in and
    add the names. An id filter, if given, is applied as in ``of_zone``."""
    from tripcast.operators.filters import of_zone

    index = BoxIndex(zones)
    out = trips.drop(PICKUP_ZONE, DROPOFF_ZONE)
    out = index.locate(out, "PU_longitude", "PU_latitude", PICKUP_ZONE, "pu_zone")
    out = index.locate(out, "DO_longitude", "DO_latitude", DROPOFF_ZONE, "do_zone")
    return of_zone(out, pickup_id, dropoff_id)
