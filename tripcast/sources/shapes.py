"""Polygon files: shapes (``.shp``), attributes (``.dbf``) and projection (``.prj``).

The files are read by Spark's own binary reader, so they may lie in any store that Spark
reaches, and one pattern may name many files; the format itself bounds a file at 2 GB.
Shapes become one row per vertex, attributes one row per record; they belong together by
file and record number.
"""

from __future__ import annotations

import datetime
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripcast.functions.projection import Conic

# Fixed values of the published formats
FILE_CODE = 9994
NO_SHAPE, POLYGONS = 0, (5, 15, 25)       # plain, with heights, with measures
HEADER = 100
VERTICES = "file string, record int, ring int, seq int, x double, y double"
BATCH = 1 << 16      # vertices or records handed on at a time


def _files(spark: SparkSession, path: str) -> DataFrame:
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    return spark.read.format("binaryFile").load(path).select(stem.alias("file"), "content")


def _polygons(content: bytes, file: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Record number, ring of each vertex and vertices."""
    if len(content) < HEADER or struct.unpack_from(">i", content)[0] != FILE_CODE:
        raise ValueError(f"{file} is not a shape file")
    at = HEADER
    while at + 8 <= len(content):
        record, words = struct.unpack_from(">ii", content, at)
        at += 8
        if at + 2 * words > len(content):
            raise ValueError(f"{file} ends within record {record}")
        kind, = struct.unpack_from("<i", content, at)
        if kind in POLYGONS:
            parts, points = struct.unpack_from("<ii", content, at + 36)
            first = np.frombuffer(content, "<i4", parts, at + 44)
            xy = np.frombuffer(content, "<f8", 2 * points, at + 44 + 4 * parts).reshape(-1, 2)
            yield record, np.repeat(np.arange(parts), np.diff(np.r_[first, points])), xy
        elif kind != NO_SHAPE:
            raise ValueError(f"{file}, record {record}: shape type {kind} is not a polygon")
        at += 2 * words


def _vertices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            for record, ring, xy in _polygons(content.as_py(), file):
                starts = np.flatnonzero(np.r_[True, ring[1:] != ring[:-1]])[:len(ring)]
                seq = np.arange(len(ring)) - np.repeat(starts, np.diff(np.r_[starts, len(ring)]))
                for low in range(0, len(ring), BATCH):
                    some = slice(low, low + BATCH)
                    n = len(ring[some])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file] * n), pa.array(np.full(n, record, np.int32)), pa.array(ring[some].astype(np.int32)),
                         pa.array(seq[some].astype(np.int32)), pa.array(xy[some, 0]), pa.array(xy[some, 1])],
                        names=["file", "record", "ring", "seq", "x", "y"])


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """``file, record, ring, seq, x, y``: the vertices of every polygon of the ``.shp`` files
    at ``path``, holes and separate parts as rings of their own. Records count from 1; a
    record without a shape has no rows. ``file`` is the path without its ending."""
    return _files(spark, path).mapInArrow(_vertices, VERTICES)


def _fields(head: bytes) -> tuple[int, int, list[tuple[str, str, int, int, int]]]:
    """Header size, record size, and (name, kind, start, size, decimals) of each field."""
    header, size = struct.unpack_from("<HH", head, 8)
    fields, at = [], 1       # the first byte of a record marks deleted ones
    for place in range(32, header - 1, 32):
        if head[place] == 0x0D:
            break
        name, kind, length, decimals = struct.unpack_from("<11sc4xBB", head, place)
        fields.append((name.split(b"\0")[0].decode("ascii"), kind.decode("ascii"), at, length, decimals))
        at += length
    return header, size, fields


def _kind(field: tuple) -> tuple[str, pa.DataType, Callable[[str], object]]:
    """SQL type, Arrow type and reader of a field's trimmed text."""
    _, kind, _, size, decimals = field
    if kind == "D":
        return "date", pa.date32(), lambda t: datetime.datetime.strptime(t, "%Y%m%d").date()
    if kind == "L":
        return "boolean", pa.bool_(), lambda t: None if t == "?" else t in "YyTt"
    if kind in "NF" and decimals == 0 and size <= 18 and kind == "N":
        return "bigint", pa.int64(), int
    if kind in "NF":
        return "double", pa.float64(), float
    return "string", pa.string(), str


def read_attributes(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """``file, record`` and the fields of the ``.dbf`` files at ``path``, which share their
    fields. Empty fields are null; deleted records are left out and keep their number."""
    files = _files(spark, path)
    heads = files.select(F.substring("content", 1, 32 + 32 * 256).alias("head")).distinct().limit(1).collect()
    if not heads:
        raise ValueError(f"no file at {path}")
    fields = _fields(bytes(heads[0].head))[2]
    kinds = [_kind(f) for f in fields]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                content = content.as_py()
                header, size, own = _fields(content)
                if own != fields:
                    raise ValueError(f"{file} has other fields than the first file")
                count, = struct.unpack_from("<I", content, 4)
                for low in range(0, count, BATCH):
                    numbers = [k for k in range(low, min(count, low + BATCH)) if content[header + k * size:header + k * size + 1] != b"*"]
                    columns = []
                    for (_, _, at, length, _), (_, kind, read) in zip(fields, kinds):
                        texts = [content[header + k * size + at:header + k * size + at + length].decode(encoding).strip(" \0") for k in numbers]
                        columns.append(pa.array([read(t) if t.strip("*") else None for t in texts], kind))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file] * len(numbers), pa.string()), pa.array([k + 1 for k in numbers], pa.int32()), *columns],
                        names=["file", "record", *[f[0] for f in fields]])

    schema = ", ".join(["file string", "record int", *[f"`{f[0]}` {k[0]}" for f, k in zip(fields, kinds)]])
    return files.mapInArrow(rows, schema)


def read_projection(spark: SparkSession, path: str) -> Conic | None:
    """Projection of the ``.prj`` file at ``path``; None for degrees."""
    return Conic.from_wkt(bytes(spark.read.format("binaryFile").load(path).first().content).decode())


def read_zone_vertices(
    spark: SparkSession, stem: str, zone_id: Column | str, projection: Conic | None = None, encoding: str = "utf-8",
) -> DataFrame:
    """``zone_id, ring, seq, lon, lat`` of the zones in ``stem.shp``, numbered by a column of
    ``stem.dbf``: what ``zone_geometry`` takes. A zone of several records keeps all
    its rings apart. Datums are taken as one (NAD83 and WGS84 differ by a metre or two)."""
    named = read_attributes(spark, f"{stem}.dbf", encoding).select(
        "file", "record", (F.col(zone_id) if isinstance(zone_id, str) else zone_id).alias("zone_id"))
    vertices = read_polygons(spark, f"{stem}.shp")
    lon, lat = projection.to_degrees(F.col("x"), F.col("y")) if projection else (F.col("x"), F.col("y"))
    ring = F.struct("file", "record", "ring").alias("ring")
    return vertices.join(named, ["file", "record"]).select("zone_id", ring, "seq", lon.alias("lon"), lat.alias("lat"))
