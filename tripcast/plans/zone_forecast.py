"""Zone forecast: demand per zone and quarter hour from real, synthetic and
combined trips, with a decomposed linear model chosen by two-goal trials."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripcast.durable import checkpointed, stored
from tripcast.operators import dating, demand, filters, linear, metrics, mixture, results, splits, trials as search, zoning
from tripcast.operators.scaling import Scaler
from tripcast.plans import settings as st
from tripcast.sources.trips import PICKUP_TIME


def zone_grids(
    parted: DataFrame, synth: DataFrame, zones: DataFrame, only_observed_days: bool = False
) -> dict[str, DataFrame]:
    """Dense demand of the three training kinds and of validation; ``parted`` are the real
    trips with their ``part``.

    Real trips are read, located and counted once for both parts. Counts are written
    down, being slots times zones however many trips there are; the combined kind is the
    sum of the counted series.
    """
    counted = stored(demand.part_demand(parted.filter(F.col("part").isin("train", "val"))), "parts")
    part = lambda name: counted.filter(F.col("part") == name).drop("part")
    real, drawn = part("train"), stored(demand.zone_demand(synth), "drawn")
    series = {
        "real": real, "synthetic": drawn,
        "real+synthetic": demand.add_series(real, drawn, keys=["slot_ts", "zone"]), "validation": part("val")}
    return {k: demand.demand_grid(s, zones, only_observed_days) for k, s in series.items()}


def synthetic_trips(
    spark: SparkSession, model: mixture.Mixture, scaler: Scaler, rows: int, zones: DataFrame,
    lookup: dating.DateLookup, seed: int,
) -> DataFrame:
    """Drawn trips with the zone of the box they fall in and a quarter-hour time."""
    raw = mixture.draw_trips(spark, model, rows, scaler, seed)
    placed = zoning.BoxIndex(zones).locate(raw, "PU_longitude", "PU_latitude", "PULocationID", "pu_zone")
    return dating.stamp(placed, lookup, "sample_id", st.DATE_SEED).select(PICKUP_TIME, "pu_zone", "trips")


def trial_metrics(
    spark: SparkSession, train: DataFrame, val: DataFrame, kind: str,
    trials: Sequence[tuple[float, int]], seed: int, length: int = st.LONG_WINDOW,
) -> DataFrame:
    """``kind, trial, rate, epochs, r2_mean, r2, smape, mae`` on the validation windows:
    ``train`` and ``val`` are channel-mean windows. Every trial's weights come
    from one set of sums and all trials are scored in one pass."""
    return _score(spark, val, kind, *_products(train, val, length), trials, seed, length)


def _products(train: DataFrame, val: DataFrame, length: int) -> tuple[list[str], linear.Products, linear.Products]:
    names, products = linear.zone_products(train, length)
    val_names, val_products = linear.zone_products(val, length)
    if names != val_names:
        raise ValueError("training and validation have different zones")
    return names, products, val_products


def _score(
    spark: SparkSession, val: DataFrame, kind: str, names: list[str], products: linear.Products,
    val_products: linear.Products, trials: Sequence[tuple[float, int]], seed: int, length: int,
) -> DataFrame:
    models = {}
    for i, (rate, epochs) in enumerate(trials):
        path = linear.decomposed_path(products, val_products, seed, rate, [epochs])
        models[str(i)] = path.at[epochs]
    scored = linear.score_zones(val, linear.zone_weights(spark, names, models), length)
    wide = metrics.accuracy(scored, "y", "predicted", ["model"])
    each = metrics.accuracy(scored, "y", "predicted", ["model", "zone"]).withColumnRenamed("r2", "zone_r2")
    wide = wide.join(each.groupBy("model").agg(F.avg("zone_r2").alias("r2_mean")), "model")
    listed = spark.createDataFrame(
        [(str(i), float(rate), int(epochs)) for i, (rate, epochs) in enumerate(trials)],
        "model string, rate double, epochs int")
    return listed.join(wide, "model").select(
        F.lit(kind).alias("kind"), F.col("model").cast("int").alias("trial"), "rate", "epochs", "r2_mean", "r2", "smape",
        "mae")


# The ends between which trials are drawn
SPACE = {"rate": search.Span(1e-4, 1e-2, log=True), "epochs": search.Span(50, 400, step=50)}


def searched_metrics(
    spark: SparkSession, train: DataFrame, val: DataFrame, kind: str, rounds: int, per_round: int, seed: int,
    length: int = st.LONG_WINDOW,
) -> DataFrame:
    """As ``trial_metrics``, with the ``round``: each round's trials are chosen by the fronts
    that those before form in mean R² and SMAPE, and scored in one pass."""
    found = _products(train, val, length)
    tables: list[DataFrame] = []

    def evaluate(values: list[dict]) -> list[tuple[float, float]]:
        some = [(v["rate"], v["epochs"]) for v in values]
        table = stored(_score(spark, val, kind, *found, some, seed, length), "trials")
        first = len(tables) * per_round
        tables.append(table.withColumns({"trial": F.col("trial") + first, "round": F.lit(len(tables))}))
        rows = sorted(table.select("trial", "r2_mean", "smape").collect())      # a row a trial
        return [(np.nan if r.r2_mean is None else -r.r2_mean, r.smape) for r in rows]

    search.search(SPACE, evaluate, rounds, per_round, seed)
    return reduce(DataFrame.unionByName, tables)


def best_trials(trials: DataFrame) -> DataFrame:
    """The first trial of each kind's front. Trials compete by R² averaged over
    the zones; R² over all zones together, ``r2``, is for the report."""
    front = results.pareto_front(trials, ["kind"], gain="r2_mean")
    return front.groupBy("kind").agg(
        F.min_by(F.struct("trial", "rate", "epochs", "r2_mean", "r2", "smape", "mae"), "trial").alias("t")
    ).select("kind", "t.*")


def run(
    trips: DataFrame, zones: DataFrame, k: int = st.CHOSEN_K, ridge: float = st.CHOSEN_RIDGE,
    multiplier: float = st.SYNTHETIC_MULTIPLIER, trials: int = 20, seed: int = 42,
    rezone_real: bool = True, fit_dates_on: str = "all", max_passes: int = 200, tolerance: float = 1e-3,
    period: filters.Period = filters.STUDY, rounds: int | None = None,
) -> DataFrame:
    """One row per kind: the chosen trial and its R², SMAPE and MAE. The trials are drawn
    beforehand or, with ``rounds``, chosen in that many rounds by what was reached before.

    ``rezone_real`` puts real trips into boxes like synthetic ones; ``False``
    keeps their own ids. ``fit_dates_on="train"`` keeps validation and hold-out
    dates out of the date distribution.
    """
    spark = trips.sparkSession
    real = filters.with_trip_columns(filters.study_period(trips, period))
    features = filters.MIXTURE_FEATURES
    complete = splits.split_by_weeks(filters.complete(real, features))
    folded = checkpointed(mixture.fold_points(complete.filter(F.col("part") == "train"), features))
    scaler = Scaler.fit(folded, features, weight="n")
    total = int(folded.agg(F.sum("n")).first()[0])
    model = mixture.fit_mixture(
        scaler.transform(folded), features, k, ridge, "full", max_passes, tolerance, seed)
    parted = splits.split_by_weeks(real)
    dated = parted.filter(F.col("part") == "train") if fit_dates_on == "train" else real
    synth = synthetic_trips(
        spark, model, scaler, int(total * multiplier), zones,
        dating.DateLookup(dating.date_probabilities(dated)), seed)
    named = zoning.locate_trips(parted, zones) if rezone_real else zoning.name_zones(parted, zones)
    named = named.select(PICKUP_TIME, "pu_zone", "trips", "part")
    grids = zone_grids(named, synth, zones)
    windows = {
        kind: checkpointed(linear.channel_mean_windows(grid, st.LONG_WINDOW)) for kind, grid in grids.items()}
    table = None
    for kind in st.TYPES:
        if rounds is None:
            one = trial_metrics(
                spark, windows[kind], windows["validation"], kind, linear.random_trials(trials, seed), seed)
        else:
            one = searched_metrics(
                spark, windows[kind], windows["validation"], kind, rounds, -(-trials // rounds), seed).drop("round")
        table = one if table is None else table.unionByName(one)
    return best_trials(table)
