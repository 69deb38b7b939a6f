"""Day-pair experiment: does adding synthetic trips help forecast the next slot?

Per cell of the grid (component count and run): draw synthetic trips, balance them to the
real hours, add count noise, give them dates, count all three kinds of trips per day
and slot, pair consecutive days, train on each kind and always validate on real
days. The cells are a column, so every step is done once for all of them. All epoch counts
of a kind come from one training path.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripcast.durable import forget, stored
from tripcast.functions.vectors import growth_weighting
from tripcast.operators import dating, demand, filters, linear, metrics, mixture, sampling, windows
from tripcast.operators.scaling import Scaler
from tripcast.plans import settings as st
from tripcast.sources.trips import PICKUP_TIME


CELL = ["nc", "seed"]


def weighted_windows(pairs: DataFrame, side: str, width: int = st.WINDOW, by: Sequence[str] = ()) -> DataFrame:
    """Growth-weighted inputs ``x*`` and target ``y`` of one side of the pairs."""
    xs = growth_weighting([F.col(f"h{k}_{side}").cast("double") for k in range(width)])
    return pairs.select(
        *by, *[x.alias(f"x{k}") for k, x in enumerate(xs)], F.col(f"target_{side}").cast("double").alias("y"))


def synthetic_counts(
    spark: SparkSession, cells: Sequence[tuple[int, int, mixture.Mixture]], scaler: Scaler, rows: int,
    real_hours: DataFrame, lookup: dating.DateLookup,
) -> DataFrame:
    """``nc, seed, date, slot, trips`` of trips drawn for every cell (component count, its
    seed and its mixture), balanced, perturbed and dated. Stored.

    One draw, one balancing and one perturbation serve all cells, each with its own seed, so
    a cell's trips don't hang on the other cells. Each resampling reads its
    input several times, so that (narrow) input is stored and removed again.
    """
    drawn = reduce(DataFrame.unionByName, [
        mixture.draw_trips(spark, model, rows, scaler, now).select(
            F.lit(k).alias("nc"), F.lit(now).alias("seed"), "sample_id", "hour", "trips") for k, now, model in cells])
    seed = F.col("seed")
    raw = stored(drawn, "drawn")
    even = stored(sampling.equal_frequency(raw, real_hours, "sample_id", seed, CELL), "even")
    noisy = sampling.perturb_counts(even, "sample_id", seed + 1, st.COUNT_NOISE, CELL)
    dated = dating.stamp(noisy, lookup, "sample_id", seed, quarters=False)
    counted = stored(demand.day_hours(dated, by=CELL).select(*CELL, "date", "slot", "trips"), "counts")
    forget(raw, even)
    return counted


def _trained(
    validation: DataFrame, val: linear.Products, train: dict[tuple, linear.Products], seeds: dict[tuple, int],
    keys: Sequence[str], epochs: Sequence[int], rate: float, patience: int, min_delta: float, width: int,
) -> DataFrame:
    """Long metrics of the models trained from the products of each key, all epoch counts,
    scored on the validation windows in one pass."""
    models = {}
    for key, products in train.items():
        start = linear.initial_weights(width, 1, seeds[key])
        path = linear.gradient_path(products, val, start, rate, epochs, patience, min_delta)
        models.update({(*key, e): w for e, w in path.at.items()})
    keys = [*keys, "epochs"]
    scored = linear.score_models(validation.sparkSession, validation, [f"x{k}" for k in range(width)], models, keys)
    wide = metrics.accuracy(scored, "y", "predicted", keys)
    return metrics.as_long(wide.select(*keys, "r2", "mae", "rmse", "mape"), keys)


def train_kinds(
    pairs: dict[str, DataFrame], epochs: Sequence[int], seed: int, rate: float = 0.01,
    patience: int = 10, min_delta: float = 1e-4, width: int = st.WINDOW,
) -> DataFrame:
    """Long metrics ``data_type, metric, value, epochs`` of each kind's models on
    the real validation windows. The pairs, at most a row a slot and day, are
    stored first: each kind is trained and scored from one count of its trips."""
    pairs = {kind: stored(frame, "pairs") for kind, frame in pairs.items()}
    xs = [f"x{k}" for k in range(width)]
    validation = weighted_windows(pairs["real"], "val", width)
    val = linear.Products.collect(validation, xs, "y")
    train = {
        (kind,): linear.Products.collect(weighted_windows(frame, "train", width), xs, "y") for kind, frame in pairs.items()}
    return _trained(validation, val, train, {key: seed for key in train}, ["data_type"], epochs, rate, patience, min_delta, width)


def train_cells(
    counted: DataFrame, drawn: DataFrame, epochs: Sequence[int], rate: float = 0.01,
    patience: int = 10, min_delta: float = 1e-4, width: int = st.WINDOW,
) -> DataFrame:
    """``data_type, nc, seed, epochs, metric, value`` for every cell of ``drawn``: models of
    the real counts, of the cell's synthetic ones and of both together, on the real
    validation windows. One pairing and one sum of products per kind serve all cells. A cell
    whose trips make no day pair of a kind has no rows of that kind."""
    xs = [f"x{k}" for k in range(width)]
    real = stored(windows.day_pairs(counted, width), "pairs")
    validation = weighted_windows(real, "val", width)
    val = linear.Products.collect(validation, xs, "y")
    alone = linear.Products.collect(weighted_windows(real, "train", width), xs, "y")
    listed = drawn.select(*CELL).distinct()
    both = demand.add_series(counted.crossJoin(F.broadcast(listed)), drawn, keys=[*CELL, "date", "slot"])   # a copy a cell
    train = {}
    for kind, series in (("synthetic", drawn), ("real+synthetic", both)):
        paired = windows.day_pairs(series, width, CELL)
        rows = linear.sums_of_products(weighted_windows(paired, "train", width, CELL), xs, "y", CELL).collect()   # a row a cell
        train.update({(kind, r["nc"], r["seed"]): linear.Products.from_rows([r], width) for r in rows})
    train.update({("real", *key[1:]): alone for key in list(train)})
    return _trained(
        validation, val, train, {key: key[2] for key in train}, ["data_type", *CELL], epochs, rate, patience, min_delta, width)


def run(
    trips: DataFrame, ks: Sequence[int] = st.PAIR_KS, runs: int = 5, epochs: Sequence[int] = st.PAIR_EPOCHS,
    multiplier: float = 2, seed: int = 42, ridge: float = 1e-4, max_passes: int = 200, tolerance: float = 1e-3,
    period: filters.Period = filters.STUDY,
) -> DataFrame:
    """Long result table ``data_type, metric, value, nc, epochs, seed`` from
    enriched trips, hourly slots. The number of jobs hangs on neither ``ks`` nor ``runs``."""
    spark = trips.sparkSession
    real = filters.with_trip_columns(filters.study_period(trips, period))
    hours = stored(demand.trips_per_hour(real), "hours")   # 24 rows
    lookup = dating.DateLookup(dating.date_probabilities(real))
    features = filters.MIXTURE_FEATURES
    folded = stored(mixture.fold_points(real, features), "folded")
    scaler = Scaler.fit(folded, features, weight="n")
    points = scaler.transform(folded)
    total = int(folded.agg(F.sum("n")).first()[0])
    fitted = mixture.fit_mixtures(
        points, features, [mixture.Candidate(k, ridge, "full", seed) for k in ks], max_passes, tolerance, seed)
    counted = stored(demand.day_hours(real).select("date", "slot", "trips"), "counted")   # 24 rows a day
    cells = [(k, seed + k + turn, model) for k, (model, _) in zip(ks, fitted) for turn in range(runs)]
    drawn = synthetic_counts(spark, cells, scaler, int(total * multiplier), hours, lookup)
    return train_cells(counted, drawn, epochs).select("data_type", "metric", "value", "nc", "epochs", "seed")
