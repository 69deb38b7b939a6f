"""Sending the package to executors that don't have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED = "tripcast.shipped"


def ship(spark: SparkSession) -> None:
    """Give every executor this package, once a session. Spark's own file server
    carries it, so driver and executors need no folder in common."""
    if spark.conf.get(_SHIPPED, None):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="tripcast-ship-"), "tripcast.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as packed:
        for folder, _, files in os.walk(here):
            for name in sorted(files):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    packed.write(path, os.path.relpath(path, os.path.dirname(here)))
    spark.sparkContext.addPyFile(archive)
    spark.conf.set(_SHIPPED, "yes")
