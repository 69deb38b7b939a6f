"""Real against synthetic: counts, histograms and distances between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripcast.durable import stored
from tripcast.functions import timecols as tc
from tripcast.joins import join_same, small
from tripcast.operators.demand import trips_per
from tripcast.sources.trips import DROPOFF_ZONE, PICKUP_ZONE

EMPTY_BIN = 1e-8   # fixed value: density given to an empty bin
BINS = 50


def compare_groups(
    real: DataFrame, synth: DataFrame, groups: Sequence[str] = (PICKUP_ZONE, DROPOFF_ZONE, "hour")
) -> DataFrame:
    """Trips per group on both sides, zero where a side has none. Trips with a
    null key are left out."""
    groups = list(groups)
    count = lambda df, name: trips_per(
        df.dropna(subset=groups), groups).withColumnRenamed("trips", name)
    both = count(real, "real_trips").join(count(synth, "synth_trips"), groups, "full")
    return both.fillna(0, ["real_trips", "synth_trips"])


def total_gap(synth: DataFrame, real: DataFrame) -> DataFrame:
    """One row: both totals and ``synth / real - 1``, 0 without real trips."""
    rows = synth.select("trips", F.lit(0).alias("real")).unionByName(
        real.select("trips", F.lit(1).alias("real")))
    side = lambda r: F.coalesce(F.sum(F.when(F.col("real") == r, F.col("trips"))), F.lit(0))
    totals = rows.agg(side(0).alias("synth_total"), side(1).alias("real_total"))
    gap = F.when(F.col("real_total") == 0, F.lit(0.0)).otherwise(
        F.col("synth_total") / F.col("real_total") - 1)
    return totals.withColumn("gap", gap)


def compare_hours(real: DataFrame, synth: DataFrame) -> DataFrame:
    """All 24 hours with both counts and the difference in percent; null where
    there is no real trip to compare with."""
    hours = real.sparkSession.range(tc.HOURS_PER_DAY).select(F.col("id").cast("int").alias("hour"))
    counted = compare_groups(real, synth, ["hour"])
    full = hours.join(counted, "hour", "left").fillna(0, ["real_trips", "synth_trips"])
    r, s = F.col("real_trips"), F.col("synth_trips")
    return full.withColumn("diff_pct", F.when(r != 0, (s - r) / r * 100))


def _bin_of(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin 0 .. bins-1 among equal edges ``lo + i * step``; the last bin holds
    ``hi``. The first guess is put right against the edges themselves, as
    division may land one off."""
    step = (hi - lo) / bins
    guess = F.least(F.floor((x - lo) / step), F.lit(bins - 1))
    low = F.when(x < lo + guess * step, guess - 1).otherwise(guess)
    up = F.when((low < bins - 1) & (x >= lo + (low + 1) * step), low + 1).otherwise(low)
    return F.when(hi == lo, F.lit(bins - 1)).otherwise(up)


def densities(
    real: DataFrame, synth: DataFrame, column: str, bins: int = BINS, by: Sequence[str] = (), weight: str | None = None,
) -> DataFrame:
    """``bin, n_real, n_synth, d_real, d_synth`` over common equal-width bins.

    Densities integrate to 1; they are null when all values are equal. With ``by``, columns
    of both sides, each group has bins of its own; ``weight`` says how often a row counts."""
    by = list(by)
    count = F.lit(1) if weight is None else F.col(weight)
    side = lambda df, flag: df.select(
        *by, F.col(column).cast("double").alias("x"), F.lit(flag).alias("is_real"), count.alias("_w"))
    rows = side(real, 1).unionByName(side(synth, 0)).filter(F.col("x").isNotNull())
    ends = rows.groupBy(*by).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    if by:
        ends = stored(ends, "ends")        # a row a group
        rows = join_same(rows, small(ends, ends.count()), by)
        lo, hi = F.col("lo"), F.col("hi")
    else:
        first = ends.first()   # two numbers
        lo, hi = F.lit(first["lo"]).cast("double"), F.lit(first["hi"]).cast("double")
    counts = rows.groupBy(*by, _bin_of(F.col("x"), lo, hi, bins).cast("int").alias("bin")).agg(
        F.sum(F.col("is_real") * F.col("_w")).alias("n_real"), F.sum((1 - F.col("is_real")) * F.col("_w")).alias("n_synth"))
    every = ends if by else real.sparkSession.range(1).drop("id")
    full = join_same(
        every.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))), counts, [*by, "bin"], "left"
    ).fillna(0, ["n_real", "n_synth"])
    edge = lambda i: F.when(i == bins, hi).otherwise(lo + i * ((hi - lo) / bins))
    width = edge(F.col("bin") + 1) - edge(F.col("bin"))
    everything = W.partitionBy(*by)   # at most `bins` rows a group
    share = lambda n: F.when(width > 0, F.col(n) / F.sum(n).over(everything) / width)
    return full.withColumns({"d_real": share("n_real"), "d_synth": share("n_synth")}).select(
        *by, "bin", "n_real", "n_synth", "d_real", "d_synth")


def _filled(density: DataFrame) -> DataFrame:
    fill = lambda c: F.when(F.col(c) == 0, F.lit(EMPTY_BIN)).otherwise(F.col(c))
    return density.withColumns({"p": fill("d_real"), "q": fill("d_synth")})


def cumulative(density: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Running sums of both densities over the bins."""
    upto = W.partitionBy(*by).orderBy("bin")   # at most `bins` rows a group
    return _filled(density).withColumns({
        "cdf_real": F.sum("p").over(upto), "cdf_synth": F.sum("q").over(upto)})


def divergence(density: DataFrame, normalised: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """One row, or one a group: ``kl``, the sum of p ln(p/q) over the densities, and ``wd``, the
    sum of the distances between their running sums. ``normalised`` makes both
    sum to 1 first, the textbook form."""
    runs = cumulative(density, by)
    if normalised:
        whole = W.partitionBy(*by)
        runs = runs.withColumns({c: F.col(c) / F.sum(c).over(whole) for c in ("p", "q")})
        upto = W.partitionBy(*by).orderBy("bin")
        runs = runs.withColumns({
            "cdf_real": F.sum("p").over(upto), "cdf_synth": F.sum("q").over(upto)})
    return runs.groupBy(*by).agg(
        F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).alias("kl"),
        F.sum(F.abs(F.col("cdf_real") - F.col("cdf_synth"))).alias("wd"),
    )
