"""Writes small polygon files for the checks and tests: formats as published, plain rings."""

import struct

from tripcast.sources import shapes


def shape_bytes(records):
    """``.shp`` content; a record is a list of rings (lists of points), or None."""
    body = b""
    for number, rings in enumerate(records, 1):
        if rings is None:
            content = struct.pack("<i", shapes.NO_SHAPE)
        else:
            points = [p for ring in rings for p in ring]
            starts = [sum(map(len, rings[:k])) for k in range(len(rings))]
            xs, ys = [p[0] for p in points], [p[1] for p in points]
            content = struct.pack("<i4dii", 5, min(xs), min(ys), max(xs), max(ys), len(rings), len(points))
            content += struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        body += struct.pack(">ii", number, len(content) // 2) + content
    head = struct.pack(">i20xi", shapes.FILE_CODE, (shapes.HEADER + len(body)) // 2) + struct.pack("<ii8d", 1000, 5, *[0.0] * 8)
    return head + body


def attribute_bytes(fields, rows, deleted=(), encoding="utf-8"):
    """``.dbf`` content; ``fields`` are (name, kind, size, decimals), values are texts."""
    size = 1 + sum(f[2] for f in fields)
    head = struct.pack("<B3BIHH20x", 3, 124, 1, 1, len(rows), 32 + 32 * len(fields) + 1, size)
    for name, kind, length, decimals in fields:
        head += struct.pack("<11sc4xBB14x", name.encode(), kind.encode(), length, decimals)
    body = b"".join(
        (b"*" if k in deleted else b" ") + b"".join(
            v.encode(encoding).rjust(f[2]) if f[1] in "NF" else v.encode(encoding).ljust(f[2]) for v, f in zip(row, fields))
        for k, row in enumerate(rows))
    return head + b"\r" + body + b"\x1a"


def put(spark, path, content):
    """Write bytes through Spark's file systems."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    out.write(content)
    out.close()


# The state plane of Long Island in US survey feet, as its public definition has it
LONG_ISLAND = (
    'PROJCS["NAD_1983_StatePlane_New_York_Long_Island_FIPS_3104_Feet",GEOGCS["GCS_North_American_1983",'
    'DATUM["D_North_American_1983",SPHEROID["GRS_1980",6378137.0,298.257222101]],PRIMEM["Greenwich",0.0],'
    'UNIT["Degree",0.0174532925199433]],PROJECTION["Lambert_Conformal_Conic"],PARAMETER["False_Easting",984250.0],'
    'PARAMETER["False_Northing",0.0],PARAMETER["Central_Meridian",-74.0],PARAMETER["Standard_Parallel_1",40.66666666666666],'
    'PARAMETER["Standard_Parallel_2",41.03333333333333],PARAMETER["Latitude_Of_Origin",40.16666666666666],'
    'UNIT["Foot_US",0.3048006096012192]]')
