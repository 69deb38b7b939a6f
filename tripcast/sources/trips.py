"""Trip tables: raw pickups and pickups enriched with zone coordinates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The public trip-record column names
PICKUP_TIME = "tpep_pickup_datetime"
PICKUP_ZONE = "PULocationID"
DROPOFF_ZONE = "DOLocationID"
COORDINATES = ["PU_longitude", "PU_latitude", "DO_longitude", "DO_latitude"]

RAW_SCHEMA = T.StructType([
    T.StructField(PICKUP_TIME, T.TimestampNTZType()),
    T.StructField(PICKUP_ZONE, T.IntegerType()),
    T.StructField(DROPOFF_ZONE, T.IntegerType()),
])
ENRICHED_SCHEMA = T.StructType(
    RAW_SCHEMA.fields + [T.StructField(c, T.DoubleType()) for c in COORDINATES]
)


def read_trips(
    spark: SparkSession, *paths: str, schema: T.StructType = RAW_SCHEMA, row_id: str | None = None
) -> DataFrame:
    """Several trip files as one table; only the schema's columns are scanned.

    Months may hold the same column in different types, such as zone ids of 32
    or 64 bits or as doubles: each path is read in its own types, and what
    differs is cast. Paths of like types are one scan. A path that lacks a
    column fails here. ``row_id`` adds a text id of that name per row, made from
    its file and its place there, the same in every read.
    """
    alike: dict[tuple, list[str]] = {}
    for path in paths:
        own = require_columns(spark.read.parquet(path), schema.names).schema     # one footer
        alike.setdefault(tuple(own[name].dataType for name in schema.names), []).append(path)
    tables = []
    for types, group in alike.items():
        own = T.StructType([T.StructField(n, t) for n, t in zip(schema.names, types)])
        table = spark.read.schema(own).parquet(*group)
        columns = [F.col(f.name) if t == f.dataType else F.col(f.name).cast(f.dataType).alias(f.name)
                   for f, t in zip(schema, types)]
        if row_id:
            file = F.lower(F.hex(F.xxhash64("_metadata.file_path")))
            columns.append(F.concat_ws("-", file, F.col("_metadata.row_index")).alias(row_id))
        tables.append(table.select(*columns))
    return reduce(DataFrame.unionByName, tables)


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fail while the plan is built when a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df
