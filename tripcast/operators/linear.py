"""Linear forecasters trained from sums of products.

A linear model with squared loss sees its data only through the sums of
products of its inputs and outputs. One aggregation over the windows gives
them; least squares, or every epoch of a gradient descent, is then worked out
from those few numbers. Sums of two tables add up, so training on real and
synthetic windows together needs no further pass.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import groupby
from operator import add

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripcast.durable import stored
from tripcast.functions import hashing
from tripcast.functions.vectors import dot, moving_average_matrix
from tripcast.operators.windows import sliding_windows, with_position

# The optimiser's usual settings
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8


def sums_of_products(
    df: DataFrame, xs: Sequence[str], y: str, by: Sequence[str] = (), complete: bool = False,
) -> DataFrame:
    """``n``, ``x_i``, ``x_i_x_j``, ``y``, ``x_i_y``, ``y_y`` summed, per group. Rows with a
    null are left out; ``complete`` says that there are none, as among drawn rows, whose
    columns Spark would otherwise work out once more for the filter, each one on its own."""
    value = {c: F.col(c).cast("double") for c in [*xs, y]}
    out = [F.count(F.lit(1)).cast("double").alias("n"), F.sum(value[y]).alias("y"), F.sum(value[y] * value[y]).alias("y_y")]
    for i, a in enumerate(xs):
        out += [F.sum(value[a]).alias(f"x{i}"), F.sum(value[a] * value[y]).alias(f"x{i}_y")]
        out += [F.sum(value[a] * value[b]).alias(f"x{i}_x{i + j}") for j, b in enumerate(xs[i:])]
    known = df if complete else df.dropna(subset=[*xs, y])
    return known.groupBy(*by).agg(*out)


@dataclass(frozen=True)
class Products:
    """Sums over n rows with z = (x, 1): ``zz`` of z z', ``zy`` of z y (one
    column per output), ``yy`` of y y per output and ``ysum``."""

    n: float
    zz: np.ndarray
    zy: np.ndarray
    yy: np.ndarray
    ysum: np.ndarray

    def __add__(self, other: Products) -> Products:
        return Products(
            self.n + other.n, self.zz + other.zz, self.zy + other.zy,
            self.yy + other.yy, self.ysum + other.ysum)

    @classmethod
    def from_rows(cls, rows: Sequence, width: int) -> Products:
        """One row per output, all over the same windows."""
        first = rows[0]
        zz = np.empty((width + 1, width + 1))
        for i in range(width):
            for j in range(i, width):
                zz[i, j] = zz[j, i] = first[f"x{i}_x{j}"]
            zz[i, width] = zz[width, i] = first[f"x{i}"]
        zz[width, width] = first["n"]
        zy = np.array([[r[f"x{i}_y"] for i in range(width)] + [r["y"]] for r in rows]).T
        return cls(
            float(first["n"]), zz, zy, np.array([r["y_y"] for r in rows]),
            np.array([r["y"] for r in rows]))

    @classmethod
    def collect(cls, df: DataFrame, xs: Sequence[str], y: str) -> Products:
        row = sums_of_products(df, xs, y).first()
        if not row["n"]:
            raise ValueError("no windows to train on")
        return cls.from_rows([row], len(xs))

    def sse(self, weights: np.ndarray) -> np.ndarray:
        """Squared error per output of ``(width + 1) x outputs`` weights."""
        fit = np.einsum("io,ij,jo->o", weights, self.zz, weights)
        return np.maximum(self.yy - 2 * (weights * self.zy).sum(0) + fit, 0)

    def mse(self, weights: np.ndarray) -> float:
        return float(self.sse(weights).sum() / (self.n * len(self.yy)))

    def r2(self, weights: np.ndarray) -> float:
        """Over all outputs flattened together."""
        count = self.n * len(self.yy)
        sst = self.yy.sum() - self.ysum.sum() ** 2 / count
        return float(1 - self.sse(weights).sum() / sst)

    def least_squares(self) -> np.ndarray:
        """Exact weights, the bias last; solved around the means."""
        width = len(self.zz) - 1
        mean = self.zz[:width, width] / self.n
        centred = self.zz[:width, :width] - self.n * np.outer(mean, mean)
        cross = self.zy[:width] - np.outer(mean, self.ysum)
        slope = np.linalg.lstsq(centred, cross, rcond=None)[0]
        return np.vstack([slope, self.ysum / self.n - mean @ slope])


@dataclass(frozen=True)
class Path:
    """Weights after a number of epochs, and the losses of every epoch run."""

    at: dict[int, np.ndarray]
    train_loss: list[float]
    val_loss: list[float]


def initial_weights(width: int, outputs: int, seed: int) -> np.ndarray:
    """Uniform within 1/sqrt(width), bias included."""
    reach = 1 / np.sqrt(width)
    return np.random.default_rng(seed).uniform(-reach, reach, (width + 1, outputs))


def gradient_path(
    train: Products, val: Products, start: np.ndarray, rate: float, epochs: Sequence[int],
    patience: int | None = None, min_delta: float = 0.0, restore: str = "best",
) -> Path:
    """Full-batch Adam on the mean squared error, all epoch counts in one run.

    With ``patience`` the run stops after that many epochs without a gain of
    ``min_delta`` in validation loss, and gives the best epoch's weights, or the
    last's with ``restore="last"``.
    """
    return _descend(train, val, [start], lambda p: p[0], lambda g: [g], rate, epochs, patience, min_delta, restore)


def deal_batches(
    df: DataFrame, xs: Sequence[str], y: str, keys: Sequence[str], batches: int, epochs: int, seed: int,
    output: str | None = None,
) -> DataFrame:
    """Sums of products per ``epoch, batch`` (and ``output``): in each epoch a row goes to
    one of the batches by a hash of its ``keys``, which the outputs of a window share.

    One aggregation gives every batch of every epoch, reduced in each task; what a batch
    contributes to training is those sums, so no row leaves its executor. Stored.
    """
    dealt = df.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).withColumn(
        "batch", F.floor(hashing.uniform(f"{seed}/batch", F.col("epoch"), *[F.col(k) for k in keys]) * batches).cast("int"))
    return stored(sums_of_products(dealt, xs, y, ["epoch", "batch", *([output] if output else [])]), "batches")


def _in_order(dealt: DataFrame, width: int, output: str | None) -> Callable[[int], list[Products]]:
    """The batches of one epoch after the other, fetched as training gets there."""
    keys = ["epoch", "batch", *([output] if output else [])]
    rows = groupby(dealt.orderBy(*keys).toLocalIterator(True), key=lambda r: r["epoch"])

    def batches(epoch: int) -> list[Products]:
        number, own = next(rows, (None, []))
        if number != epoch:
            raise ValueError(f"epoch {epoch} has no rows")
        return [Products.from_rows(list(some), width) for _, some in groupby(own, key=lambda r: r["batch"])]
    return batches


def minibatch_path(
    dealt: DataFrame, val: Products, start: np.ndarray, rate: float, epochs: Sequence[int],
    patience: int | None = None, min_delta: float = 0.0, restore: str = "best", output: str | None = None,
) -> Path:
    """``gradient_path`` with one step of the optimiser for each batch of ``deal_batches``,
    in order; an empty batch is left out. One batch an epoch is ``gradient_path`` itself."""
    batches = _in_order(dealt, len(start) - 1, output)
    return _descend(None, val, [start], lambda p: p[0], lambda g: [g], rate, epochs, patience, min_delta, restore, batches)


def decomposed_path(
    train: Products, val: Products, seed: int, rate: float, epochs: Sequence[int], kernel: int = 25,
    dealt: DataFrame | None = None, output: str = "zone",
) -> Path:
    """The same for a model with one head on the moving average of the window
    and one on the rest, each with a bias; outputs share the input. With ``dealt``, the
    sums of ``deal_batches`` per ``output``, a step is taken for each batch.

    Both heads are linear in the window, so together they are one weight matrix
    ``(I - A)' rest + A' trend``; the gradient flows back through it.
    """
    width = len(train.zz) - 1
    smooth = moving_average_matrix(width, kernel)
    rest = np.eye(width) - smooth
    outputs = train.zy.shape[1]
    heads = [initial_weights(width, outputs, seed), initial_weights(width, outputs, seed + 1)]

    def merge(p):
        slope = rest.T @ p[0][:-1] + smooth.T @ p[1][:-1]
        return np.vstack([slope, p[0][-1] + p[1][-1]])

    def split(g):
        return [np.vstack([rest @ g[:-1], g[-1]]), np.vstack([smooth @ g[:-1], g[-1]])]

    batches = None if dealt is None else _in_order(dealt, width, output)
    return _descend(train, val, heads, merge, split, rate, epochs, batches=batches)


def _descend(
    train, val, parameters, merge, split, rate, epochs, patience=None, min_delta=0.0, restore="best", batches=None,
) -> Path:
    """``batches`` gives the sums of each batch of an epoch; without it, all rows are one."""
    parameters = [p.copy() for p in parameters]
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    best, best_loss, waited, at = None, np.inf, 0, {}
    losses, val_losses, step = [], [], 0
    for epoch in range(1, max(epochs) + 1):
        weights = merge(parameters)
        own = [train] if batches is None else batches(epoch)
        losses.append(reduce(add, own).mse(weights))
        for batch in own:
            step += 1
            gradients = split(2 / (batch.n * batch.zy.shape[1]) * (batch.zz @ weights - batch.zy))
            for p, m, v, g in zip(parameters, first, second, gradients):
                m += (1 - BETA1) * (g - m)
                v += (1 - BETA2) * (g * g - v)
                p -= rate * (m / (1 - BETA1 ** step)) / (np.sqrt(v / (1 - BETA2 ** step)) + EPSILON)
            weights = merge(parameters)
        val_losses.append(val.mse(weights))
        if val_losses[-1] < best_loss - min_delta:
            best, best_loss, waited = weights.copy(), val_losses[-1], 0
        else:
            waited += 1
        keep_best = patience is not None and restore == "best" and best is not None
        if epoch in epochs:
            at[epoch] = best if keep_best else weights.copy()
        if patience is not None and waited >= patience:
            for e in epochs:
                if e > epoch:
                    at[e] = best if keep_best else weights.copy()
            break
    return Path(at, losses, val_losses)


WEIGHTS_SCHEMA = "output int, input int, weight double"     # the bias is the last input


def weights_table(spark: SparkSession, weights: np.ndarray) -> DataFrame:
    """A trained model as a table of parameters, ready to be saved."""
    rows = [(o, i, float(weights[i, o])) for o in range(weights.shape[1]) for i in range(weights.shape[0])]
    return spark.createDataFrame(rows, WEIGHTS_SCHEMA)


def weights_from(table: DataFrame) -> np.ndarray:
    """The weights of ``weights_table``: a start for further training, too."""
    rows = table.select("output", "input", "weight").collect()     # the parameters of one model
    if not rows:
        raise ValueError("no parameters in the table")
    out = np.full((1 + max(r["input"] for r in rows), 1 + max(r["output"] for r in rows)), np.nan)
    for r in rows:
        out[r["input"], r["output"]] = r["weight"]
    if np.isnan(out).any():
        raise ValueError("the table lacks some parameters")
    return out


def predict(df: DataFrame, xs: Sequence[str], weights: np.ndarray, name: str = "predicted") -> DataFrame:
    """Score windows with one output's weights, the bias last."""
    flat = np.asarray(weights, dtype=float).ravel()
    return df.withColumn(name, dot([F.col(x) for x in xs], flat[:-1], flat[-1]))


def score_models(
    spark: SparkSession, df: DataFrame, xs: Sequence[str], models: dict[tuple, np.ndarray], keys: Sequence[str]
) -> DataFrame:
    """Every window under every model, ``keys, predicted``, in one pass: the
    models ride along as a constant array of weights."""
    entry = [
        F.struct(
            *[F.lit(v).alias(k) for k, v in zip(keys, key)],
            F.array(*[F.lit(float(v)) for v in np.asarray(w).ravel()]).alias("w"))
        for key, w in models.items()]
    each = df.withColumn("_model", F.explode(F.array(*entry)))
    weights = [F.col("_model.w")[i] for i in range(len(xs) + 1)]
    return each.select(
        *df.columns, *[F.col(f"_model.{k}").alias(k) for k in keys],
        dot([F.col(x) for x in xs], weights[:-1], weights[-1]).alias("predicted"))


def channel_mean_windows(grid: DataFrame, length: int = 8) -> DataFrame:
    """Per target slot and zone: the ``length`` earlier means over all channels,
    ``x*``, and the zone's demand ``y``.

    The model's heads are shared by the channels and its output is averaged over
    them, so it depends on the window only through the channel mean; the slot of
    the day is a channel too. One short series replaces the wide matrix.
    """
    means = grid.groupBy("slot_ts").agg(
        ((F.sum("trips") + F.first("slot")) / (F.count(F.lit(1)) + 1)).alias("mean"))
    numbered = with_position(
        means.withColumn("date", F.to_date("slot_ts")), "mean", within=("slot_ts",))
    inputs = sliding_windows(numbered, "mean", length, of_target=["slot_ts"]).drop("pos", "y")
    return inputs.join(grid.select("slot_ts", "zone", F.col("trips").cast("double").alias("y")), "slot_ts")


def zone_products(windows: DataFrame, length: int = 8) -> tuple[list[str], Products]:
    """Zone names and the sums over their windows: nine sums per zone leave the
    executors."""
    xs = [f"x{k}" for k in range(length)]
    rows = sums_of_products(windows, xs, "y", ["zone"]).orderBy("zone").collect()
    if not rows:
        raise ValueError("no windows to train on")
    return [r["zone"] for r in rows], Products.from_rows(rows, length)


def zone_weights(
    spark: SparkSession, zones: Sequence[str], models: dict[str, np.ndarray]
) -> DataFrame:
    """``model, zone, w``: a parameter table with the bias last in ``w``."""
    rows = [
        (name, zone, [float(v) for v in w[:, i]])
        for name, w in models.items() for i, zone in enumerate(zones)]
    schema = T.StructType([
        T.StructField("model", T.StringType()), T.StructField("zone", T.StringType()),
        T.StructField("w", T.ArrayType(T.DoubleType()))])
    return spark.createDataFrame(rows, schema)


def score_zones(windows: DataFrame, weights: DataFrame, length: int = 8) -> DataFrame:
    """``slot_ts, model, zone, y, predicted``."""
    joined = windows.join(weights, "zone")
    w = [F.col("w")[i] for i in range(length + 1)]
    p = dot([F.col(f"x{k}") for k in range(length)], w[:-1], w[-1])
    return joined.select("slot_ts", "model", "zone", "y", p.alias("predicted"))


def random_trials(trials: int, seed: int) -> list[tuple[float, int]]:
    """Seeded (rate, epochs): log-uniform 1e-4..1e-2, and 50..400 by 50."""
    rng = np.random.default_rng(seed)
    return [
        (float(np.exp(rng.uniform(np.log(1e-4), np.log(1e-2)))), int(rng.integers(1, 9)) * 50)
        for _ in range(trials)]
