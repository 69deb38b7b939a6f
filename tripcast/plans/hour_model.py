"""Sweep over component counts: how close are synthetic hours to real ones, and
does training on synthetic trips help predict the hour from the coordinates?"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripcast.durable import forget, stored
from tripcast.functions.vectors import unscale, unscale_to_int
from tripcast.operators import compare, filters, linear, metrics, mixture, sampling, splits
from tripcast.operators.scaling import Scaler
from tripcast.plans import settings as st
from tripcast.sources.trips import COORDINATES

FEATURES = ["hour", *COORDINATES]


def hour_accuracy(
    test: DataFrame, models: dict[tuple, object], scaler: Scaler, keys: Sequence[str] = ("model",)
) -> DataFrame:
    """``keys, mae, mse, r2`` in hours, all models in one pass."""
    keys = list(keys)
    scored = linear.score_models(test.sparkSession, test, COORDINATES, models, keys)
    mean, scale = scaler.means[0], scaler.scales[0]
    unscaled = scored.withColumns({
        "y": unscale(F.col("hour"), mean, scale), "p": unscale(F.col("predicted"), mean, scale)})
    return metrics.accuracy(unscaled, "y", "p", keys).select(*keys, "mae", "mse", "r2")


def drawn_sums(
    spark: SparkSession, cells: Sequence[tuple[int, mixture.Mixture]], rows: int, scaler: Scaler, seed: int
) -> DataFrame:
    """``n_clusters, decoded`` and sums of products over the trips drawn from each mixture,
    by their hour. One pass over the draws of all mixtures, which are never written: the
    sums serve training, and their counts are the histogram of the drawn hours. Stored."""
    drawn = reduce(DataFrame.unionByName, [
        mixture.draw(spark, model, rows, FEATURES, seed + k).withColumn("n_clusters", F.lit(k)) for k, model in cells])
    decoded = unscale_to_int(F.col("hour"), scaler.means[0], scaler.scales[0])
    return stored(linear.sums_of_products(
        drawn.withColumn("decoded", decoded), COORDINATES, "hour", ["n_clusters", "decoded"], complete=True), "sums")


def measure(
    cells: Sequence[tuple[int, mixture.Mixture]], train: DataFrame, test: DataFrame, products: dict[str, linear.Products],
    scaler: Scaler, rows: int, seed: int, epochs: int,
) -> DataFrame:
    """The sweep's row of every mixture in ``cells``: ``train`` are unscaled rows, ``test``
    scaled ones. The number of jobs doesn't grow with the cells."""
    spark = train.sparkSession
    sums = drawn_sums(spark, cells, rows, scaler, seed)
    found = sums.collect()     # a row a mixture and hour
    real = linear.gradient_path(
        products["train"], products["val"], linear.initial_weights(4, 1, seed), 1e-3, [epochs], 5).at[epochs]
    models = {}
    for k, _ in cells:
        extra = reduce(add, [linear.Products.from_rows([r], len(COORDINATES)) for r in found if r["n_clusters"] == k])
        models[k, "real"] = real
        models[k, "finetune"] = linear.gradient_path(extra, products["val"], real, 1e-4, [epochs], 5).at[epochs]
        models[k, "real_synth_init"] = linear.gradient_path(
            products["train"] + extra, products["val"], linear.initial_weights(4, 1, seed + 1), 1e-3,
            [epochs], 5).at[epochs]
    by = ["n_clusters"]
    listed = F.explode(F.array(*[F.lit(k) for k, _ in cells])).alias("n_clusters")
    hours = train.groupBy("hour").agg(F.count(F.lit(1)).cast("double").alias("n")).select("hour", "n", listed)
    drawn = sums.select("n_clusters", F.col("decoded").alias("hour"), "n")
    gaps = compare.divergence(compare.densities(hours, drawn, "hour", by=by, weight="n"), by=by)
    wides = hour_accuracy(test, models, scaler, ["n_clusters", "model"])
    accuracy = wides.groupBy(*by).pivot("model", ["real", "finetune", "real_synth_init"]).agg(
        *[F.first(c).alias(c) for c in ("mae", "mse", "r2")])
    return gaps.join(accuracy, by).orderBy(*by)


def sweep(
    trips: DataFrame, ks: Sequence[int] = st.SWEEP_KS, share: float = 1.0, multiplier: int = 10,
    id_col: str = "trip_id", seed: int = 42, epochs: int = 30, max_passes: int = 100, tolerance: float = 1e-3,
    weekdays: tuple[int, int] = (1, 3), starts: Sequence[mixture.Mixture] | None = None,
) -> DataFrame:
    """One row per component count: ``kl``, ``wd`` and the accuracy of the model
    trained on real trips, tuned on synthetic ones, and trained on both. ``starts`` gives
    the mixtures to begin from, over the standardised features."""
    rows = filters.complete(filters.on_weekdays(filters.with_trip_columns(trips), *weekdays), FEATURES)
    parted = splits.random_parts(sampling.sample_exact_share(rows, share, id_col, seed), id_col, seed)
    parted = stored(parted.select(*FEATURES, "part"), "parted")
    part = lambda name: parted.filter(F.col("part") == name)
    folded = stored(mixture.fold_points(part("train"), FEATURES), "folded")
    scaler = Scaler.fit(folded, FEATURES, weight="n")
    total = int(folded.agg(F.sum("n")).first()[0])
    scaled = {name: scaler.transform(part(name)) for name in ("train", "val", "test")}
    products = {n: linear.Products.collect(scaled[n], COORDINATES, "hour") for n in ("train", "val")}
    kind = starts[0].kind if starts else "full"
    fitted = mixture.fit_mixtures(
        scaler.transform(folded), FEATURES, [mixture.Candidate(k, 1e-6, kind, seed) for k in ks],
        max_passes, tolerance, seed, starts)
    cells = [(k, model) for k, (model, _) in zip(ks, fitted)]
    table = stored(measure(cells, part("train"), scaled["test"], products, scaler, total * multiplier, seed, epochs), "sweep")
    forget(parted, folded)
    return table
