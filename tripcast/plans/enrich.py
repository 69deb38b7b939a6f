"""Raw trips and zones to trips with coordinates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tripcast.operators.zoning import attach_centroids
from tripcast.sources.sinks import write_parquet
from tripcast.sources.trips import read_trips


def enrich_files(spark: SparkSession, paths: Sequence[str], zones: DataFrame, out: str) -> None:
    """Read monthly files, add zone centroids, write one enriched table."""
    write_parquet(attach_centroids(read_trips(spark, *paths), zones), out)
