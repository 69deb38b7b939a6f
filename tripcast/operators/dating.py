"""Dates, minutes and jitter for synthetic trips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripcast.durable import checkpointed
from tripcast.functions import hashing, timecols as tc
from tripcast.joins import small
from tripcast.sources.trips import COORDINATES, PICKUP_TIME

CELLS = 1024             # steps of the inverse-distribution lookup
SIGMA_DEGREES = 0.0005   # fixed value: jitter of a coordinate


def date_probabilities(real: DataFrame, ts: str = PICKUP_TIME) -> DataFrame:
    """``hour, date, n, p, lo, hi``: each hour's dates as consecutive pieces of
    [0, 1). Hours times calendar days, whatever the number of trips."""
    keyed = real.select(tc.hour_of(F.col(ts)).alias("hour"), tc.date_of(F.col(ts)).alias("date"))
    counts = keyed.groupBy("hour", "date").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.partitionBy("hour").orderBy("date"))
    total = F.sum("n").over(W.partitionBy("hour"))
    return counts.select(
        "hour", "date", "n", (F.col("n") / total).alias("p"),
        ((upto - F.col("n")) / total).alias("lo"), (upto / total).alias("hi"),
    )


class DateLookup:
    """Inverse distributions of the dates of each hour.

    [0, 1) is cut into cells and each date's piece listed under the cells it
    touches, so a row meets the one or two pieces of its cell by an equality
    join instead of all dates of its hour. The probabilities are stored, so real
    trips are read once for any number of draws, and counted to bound the
    lookup: each hour has at most its dates plus CELLS rows.
    """

    def __init__(self, probabilities: DataFrame):
        stored = checkpointed(probabilities.select("hour", "date", "lo", "hi"))
        counted = stored.agg(
            F.count(F.lit(1)).alias("rows"), F.array_sort(F.collect_set("hour")).alias("hours")).first()
        self.hours = counted["hours"]   # at most 24
        cells = F.sequence(
            F.floor(F.col("lo") * CELLS), F.least(F.lit(CELLS - 1), F.floor(F.col("hi") * CELLS)))
        lookup = stored.select(
            F.col("hour").alias("_hour"), F.col("date").alias("_date"), "lo", "hi", F.explode(cells).alias("_cell"))
        self.lookup = small(lookup, counted["rows"] + CELLS * len(self.hours))

    def assign(self, synth: DataFrame, id_col: str, seed: hashing.Seed, name: str = "date") -> DataFrame:
        """Draw a date for each row given its hour. An hour without dates borrows
        a random hour that has some; without any the date is null."""
        seen = F.array(*[F.lit(h) for h in self.hours]).cast("array<int>")
        spare = F.floor(hashing.uniform(hashing.part_of(seed, "hour"), F.col(id_col)) * len(self.hours)).cast("int")
        aimed = synth.withColumns({
            "_u": hashing.uniform(hashing.part_of(seed, "date"), F.col(id_col)),
            "_hour": F.when(F.col("hour").isin(self.hours), F.col("hour")).otherwise(F.get(seen, spare)),
        }).withColumn("_cell", F.floor(F.col("_u") * CELLS))
        found = aimed.alias("a").join(
            self.lookup.alias("b"),
            (F.col("a._hour") == F.col("b._hour")) & (F.col("a._cell") == F.col("b._cell"))
            & (F.col("a._u") >= F.col("b.lo")) & (F.col("a._u") < F.col("b.hi")),
            "left",
        )
        return found.select(*[F.col(f"a.{c}") for c in synth.columns], F.col("b._date").alias(name))


def assign_dates(
    synth: DataFrame, probabilities: DataFrame, id_col: str, seed: int, name: str = "date"
) -> DataFrame:
    return DateLookup(probabilities).assign(synth, id_col, seed, name)


def quarter_offset(df: DataFrame, id_col: str, seed: hashing.Seed, name: str = "minutes") -> DataFrame:
    """A random 0, 15, 30 or 45 minutes per row."""
    u = hashing.uniform(hashing.part_of(seed, "quarter"), F.col(id_col))
    return df.withColumn(name, (F.floor(u * 4) * 15).cast("int"))


def jitter(df: DataFrame, id_col: str, seed: int, sigma: float = SIGMA_DEGREES) -> DataFrame:
    """Normal noise on each coordinate present."""
    normals = hashing.gaussians(hashing.digest(f"{seed}/jitter", F.col(id_col)))
    moved = {
        c: F.col(c) + z * F.lit(sigma) for c, z in zip(COORDINATES, normals) if c in df.columns
    }
    return df.withColumns(moved)


def stamp(
    synth: DataFrame, lookup: DateLookup, id_col: str, seed: hashing.Seed,
    quarters: bool = True, ts: str = PICKUP_TIME,
) -> DataFrame:
    """Give synthetic trips a pickup time: drawn date, own hour and, if asked,
    a random quarter. Rows without a date are dropped."""
    dated = lookup.assign(synth, id_col, seed, "_date").filter(F.col("_date").isNotNull())
    if not quarters:
        return dated.withColumn(ts, tc.at_time(F.col("_date"), F.col("hour"))).drop("_date")
    timed = quarter_offset(dated, id_col, seed, "_minutes")
    return timed.withColumn(
        ts, tc.at_time(F.col("_date"), F.col("hour"), F.col("_minutes"))
    ).drop("_date", "_minutes")
