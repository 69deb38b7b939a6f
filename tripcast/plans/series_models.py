"""Univariate experiments: a linear model on sliding windows of the hourly
series, on real trips and on real plus synthetic ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripcast.durable import checkpointed
from tripcast.functions import timecols as tc
from tripcast.operators import demand, filters, linear, metrics, mixture, windows
from tripcast.operators.scaling import Scaler
from tripcast.plans import settings as st
from tripcast.sources.trips import COORDINATES, PICKUP_TIME

FEATURES = ["day", "hour", *COORDINATES]


def train_series(
    series: DataFrame, rates: Sequence[float], epochs: Sequence[int], seed: int, width: int = st.WINDOW
) -> DataFrame:
    """``rate, epochs, r2, smape, mae, mse, rmse``: trained on the first 70 % of
    the windows, tested on the rest."""
    numbered = windows.with_position(checkpointed(series))   # 24 rows a day
    split = checkpointed(windows.chronological_split(windows.sliding_windows(numbered, width=width)))
    xs = [f"x{k}" for k in range(width)]
    part = lambda name: split.filter(F.col("part") == name)
    train, val = (linear.Products.collect(part(p), xs, "y") for p in ("train", "val"))
    models = {}
    for rate in rates:
        path = linear.gradient_path(train, val, linear.initial_weights(width, 1, seed), rate, epochs)
        models.update({(rate, e): w for e, w in path.at.items()})
    scored = linear.score_models(series.sparkSession, part("val"), xs, models, ["rate", "epochs"])
    return metrics.accuracy(scored, "y", "predicted", ["rate", "epochs"]).select(
        "rate", "epochs", "r2", "smape", "mae", "mse", "rmse")


def drawn_series(spark: SparkSession, model: mixture.Mixture, scaler: Scaler, rows: int, seed: int) -> DataFrame:
    """Hourly counts of trips drawn from a mixture of day, hour and coordinates.
    Days and hours are rounded, not wrapped: hours -1 and 24 may appear."""
    drawn = scaler.inverse(mixture.draw(spark, model, rows, FEATURES, seed))
    keyed = drawn.select(
        tc.date_from_day_number(F.col("day")).alias("date"), F.rint("hour").cast("int").alias("slot"),
        F.lit(1).alias("trips"))
    return demand.trips_per(keyed, ["date", "slot"])


def run(
    trips: DataFrame, ks: Sequence[int] = (25, 30, 35), multiplier: float = 5,
    rates: Sequence[float] = (0.001, 0.01), epochs: Sequence[int] = (50, 100, 150, 200),
    seed: int = 42, max_passes: int = 100, tolerance: float = 1e-3,
    weekdays: tuple[int, int] = (0, 2),
) -> DataFrame:
    """``nc, data_type, rate, epochs`` and the accuracy of each model. The trips
    are counted once and folded once; all mixtures share the passes of the fit."""
    kept = filters.with_trip_columns(filters.on_weekdays(trips, *weekdays))
    real = checkpointed(demand.day_hours(kept).select("date", "slot", "trips"))   # 24 rows a day
    dated = kept.withColumn("day", tc.day_number(tc.date_of(F.col(PICKUP_TIME))))
    folded = checkpointed(mixture.fold_points(dated, FEATURES))
    scaler = Scaler.fit(folded, FEATURES, weight="n")
    total = int(folded.agg(F.sum("n")).first()[0])
    fitted = mixture.fit_mixtures(
        scaler.transform(folded), FEATURES, [mixture.Candidate(k, 1e-6, "full", seed) for k in ks],
        max_passes, tolerance, seed)
    alone = checkpointed(train_series(real, rates, epochs, seed))   # the same beside every mixture
    parts = []
    for k, (model, _) in zip(ks, fitted):
        drawn = drawn_series(trips.sparkSession, model, scaler, int(total * multiplier), seed)
        both = train_series(demand.add_series(real, drawn), rates, epochs, seed)
        for kind, table in (("real", alone), ("real_synthetic", both)):
            parts.append(table.select(F.lit(k).alias("nc"), F.lit(kind).alias("data_type"), "*"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
