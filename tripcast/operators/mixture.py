"""Gaussian mixtures: fitting, scoring, choosing and drawing.

Trips lie on zone centroids and whole hours, so the trip table is first folded
into distinct points with a weight (``fold_points``); the fold is exact, and its
size is bounded by hours x zones x zones. The passes of expectation and
maximisation then read the folded points. Each task reduces its points to one
set of sums per component, Spark adds the sums, and the driver holds only the
parameters. Several candidate mixtures are fitted in the same passes.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripcast.durable import forget, stored
from tripcast.functions import hashing, timecols as tc
from tripcast.operators import trials

START_ROUNDS = 4          # nearest-centre rounds of a start
DRAW_ROUNDS = 5           # rounds in which candidates for centres are drawn, whatever their number
RECLUSTER_ROUNDS, RECLUSTER_TRIES = 10, 8
OVERSAMPLE = 2            # candidates a round, as a multiple of the centres wanted
TASK_POINTS = 50_000      # fewest points worth a task of their own
STRIP_CELLS = 1 << 22     # numbers held at a time while adding up products
EMPTY = 1e-10             # weight that keeps an empty component finite


def fold_points(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Distinct feature vectors with their number of rows, ``n``."""
    as_double = [F.col(c).cast("double").alias(c) for c in features]
    return df.select(*as_double).dropna().groupBy(*features).agg(F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class Candidate:
    """What to fit: component count, ridge on the covariance diagonal, and
    covariance kind, ``full`` or ``diag``."""

    k: int
    ridge: float = 1e-6
    kind: str = "full"
    seed: int = 42

    def __post_init__(self):
        if self.kind not in ("full", "diag"):
            raise ValueError(f"unknown covariance kind: {self.kind}")


@dataclass(frozen=True)
class Mixture:
    """Parameters of a mixture: k weights, k x d means, k x d x d covariances."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    kind: str = "full"
    passes: int = 0
    history: tuple[float, ...] = field(default=(), compare=False)
    converged: bool = field(default=False, compare=False)

    @property
    def k(self) -> int:
        return len(self.weights)

    @property
    def d(self) -> int:
        return self.means.shape[1]

    def parameter_count(self) -> int:
        """Free parameters: weights, means and the covariances of its kind."""
        return parameter_count(self.k, self.d, self.kind)

    @cached_property
    def _factors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What ``joint`` needs of the parameters, worked out once a mixture: a common
        origin, the inverse factors of all components side by side, what they make of
        the means, and the logarithms that no point changes."""
        origin = self.means.mean(axis=0)
        low = np.linalg.cholesky(self.covariances)
        inverse = np.linalg.inv(low)
        side = inverse.transpose(2, 0, 1).reshape(self.d, self.k * self.d)
        shift = np.einsum("kij,kj->ki", inverse, self.means - origin).ravel()
        logs = np.log(self.weights) - np.log(np.diagonal(low, axis1=1, axis2=2)).sum(1) - 0.5 * self.d * np.log(2 * np.pi)
        return origin, side, shift, logs

    def joint(self, x: np.ndarray) -> np.ndarray:
        """ln(weight * density) of every point under every component."""
        origin, side, shift, logs = self._factors
        out = np.empty((len(x), self.k))
        step = max(1, STRIP_CELLS // (self.k * self.d))
        for at in range(0, len(x), step):
            z = ((x[at:at + step] - origin) @ side - shift).reshape(-1, self.k, self.d)
            out[at:at + step] = logs - 0.5 * np.einsum("nkd,nkd->nk", z, z)
        return out

    def to_rows(self, model: int = 0) -> list[tuple]:
        return [
            (model, c, self.kind, float(self.weights[c]), self.means[c].tolist(),
             self.covariances[c].ravel().tolist())
            for c in range(self.k)]

    def to_table(self, spark: SparkSession, model: int = 0) -> DataFrame:
        return spark.createDataFrame(self.to_rows(model), PARAMETER_SCHEMA)

    @classmethod
    def from_rows(cls, rows: Sequence[Row]) -> Mixture:
        rows = sorted(rows, key=lambda r: r["component"])
        means = np.array([r["mean"] for r in rows], dtype=float)
        d = means.shape[1]
        return cls(
            np.array([r["weight"] for r in rows], dtype=float), means,
            np.array([r["covariance"] for r in rows], dtype=float).reshape(-1, d, d),
            rows[0]["kind"])


PARAMETER_SCHEMA = T.StructType([
    T.StructField("model", T.IntegerType()),
    T.StructField("component", T.IntegerType()),
    T.StructField("kind", T.StringType()),
    T.StructField("weight", T.DoubleType()),
    T.StructField("mean", T.ArrayType(T.DoubleType())),
    T.StructField("covariance", T.ArrayType(T.DoubleType())),
])


def parameter_count(k: int, d: int, kind: str) -> int:
    if kind == "full":
        spread = k * d * (d + 1) // 2
    elif kind == "diag":
        spread = k * d
    else:
        raise ValueError(f"unknown covariance kind: {kind}")
    return (k - 1) + k * d + spread


def _log_total(joint: np.ndarray) -> np.ndarray:
    top = joint.max(axis=1, keepdims=True)
    return (top + np.log(np.exp(joint - top).sum(axis=1, keepdims=True)))[:, 0]


def expected_sums(points: DataFrame, features: Sequence[str], models: Sequence[Mixture]) -> DataFrame:
    """One expectation pass: ``model, component, pos, value``.

    Per component, position 0 is the expected weight, then come the d sums of
    x and the sums of the products x_i x_j (squares only for ``diag``). Component
    -1 holds the log-likelihood.
    """
    features = list(features)

    def reduce_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = [np.zeros((m.k, 1 + m.d + (m.d * m.d if m.kind == "full" else m.d))) for m in models]
        likelihood = np.zeros(len(models))
        for batch in batches:
            rows, weight = batch[features].to_numpy(float), batch["n"].to_numpy(float)
            step = max(1, STRIP_CELLS // (len(features) ** 2 + 1))
            for at in range(0, len(rows), step):
                x, w = rows[at:at + step], weight[at:at + step]
                full = np.einsum("ni,nj->nij", x, x).reshape(len(x), -1)
                for i, m in enumerate(models):
                    joint = m.joint(x)
                    total = _log_total(joint)
                    share = np.exp(joint - total[:, None]) * w[:, None]
                    likelihood[i] += w @ total
                    second = full if m.kind == "full" else x * x
                    sums[i] += share.T @ np.hstack([np.ones((len(x), 1)), x, second])
        out = [
            pd.DataFrame({
                "model": i, "component": np.repeat(np.arange(m.k), s.shape[1]),
                "pos": np.tile(np.arange(s.shape[1]), m.k), "value": s.ravel()})
            for i, (m, s) in enumerate(zip(models, sums))]
        out.append(pd.DataFrame({
            "model": np.arange(len(models)), "component": -1, "pos": 0, "value": likelihood}))
        yield pd.concat(out, ignore_index=True)

    parts = points.select(*features, "n").mapInPandas(
        reduce_task, "model int, component int, pos int, value double")
    return parts.groupBy("model", "component", "pos").agg(F.sum("value").alias("value"))


def _gather(points: DataFrame, features: Sequence[str], models: Sequence[Mixture]):
    """The sums of a pass as arrays: parameters only, whatever the data."""
    found = expected_sums(points, features, models).toPandas()
    out = []
    for i, m in enumerate(models):
        mine = found[found["model"] == i]
        inner = mine[mine["component"] >= 0].sort_values(["component", "pos"])
        sums = inner["value"].to_numpy().reshape(m.k, -1)
        out.append((sums, float(mine.loc[mine["component"] < 0, "value"].iloc[0])))
    return out


def maximise(sums: np.ndarray, d: int, kind: str, ridge: float) -> Mixture:
    """Parameters from the expected sums of one pass."""
    mass = sums[:, 0] + EMPTY
    means = sums[:, 1:1 + d] / mass[:, None]
    second = sums[:, 1 + d:] / mass[:, None]
    if kind == "full":
        spread = second.reshape(-1, d, d) - np.einsum("ki,kj->kij", means, means)
    else:
        spread = np.einsum("ki,ij->kij", np.maximum(second - means ** 2, 0), np.eye(d))
    return Mixture(mass / mass.sum(), means, spread + ridge * np.eye(d), kind)


@dataclass(frozen=True)
class _Nearest:
    """Centres that take the points nearest to them whole, as a model of a pass."""

    centres: np.ndarray
    kind: str

    @property
    def k(self) -> int:
        return len(self.centres)

    @property
    def d(self) -> int:
        return self.centres.shape[1]

    def joint(self, x: np.ndarray) -> np.ndarray:
        nearest = squared_gaps(x, self.centres).argmin(1)
        return np.where(np.arange(self.k)[None, :] == nearest[:, None], 0.0, -np.inf)


def squared_gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.stack([((x - c) ** 2).sum(1) for c in centres], axis=1)


def spread_centres(points: DataFrame, features: Sequence[str], k: int, seed: int | str) -> np.ndarray:
    """``k`` centres drawn from all points, each next one with a chance in
    proportion to weight times squared distance from those before.

    The draw is the largest of ln(gap² n) plus Gumbel noise hashed from seed, step
    and point, so every task names one point and the result hangs on neither
    partitions nor order. With fewer distinct points than ``k`` the rest repeat,
    drawn by weight.
    """
    features = list(features)
    centres = np.empty((0, len(features)))
    schema = "score double, " + ", ".join(f"`{f}` double" for f in features)
    for step in range(k):
        def best_of_task(batches: Iterator[pd.DataFrame], known: np.ndarray = centres) -> Iterator[pd.DataFrame]:
            found = []
            for batch in batches:
                x, n = batch[features].to_numpy(float), batch["n"].to_numpy(float)
                gap = squared_gaps(x, known).min(1) if len(known) else np.ones(len(x))
                with np.errstate(divide="ignore"):
                    far = np.where(gap > 0, np.log(gap * n), np.log(n) - 1e6)
                score = far - np.log(-np.log(np.maximum(batch["u"].to_numpy(), 2.0 ** -53)))
                batch = batch[features].assign(score=score)
                found.append(batch.nlargest(1, "score"))
            if found:
                yield pd.concat(found).sort_values(["score", *features]).tail(1)[["score", *features]]
        noisy = points.withColumn("u", hashing.uniform(f"{seed}/{step}", *[F.col(c) for c in features]))
        best = noisy.mapInPandas(best_of_task, schema).orderBy(F.desc("score"), *features).first()
        centres = np.vstack([centres, [best[f] for f in features]])
    return centres


def draw_candidates(
    points: DataFrame, features: Sequence[str], draws: Mapping[int | str, int], rounds: int = DRAW_ROUNDS,
) -> dict[int | str, np.ndarray]:
    """Candidates for centres (k-means||, Bahmani et al., 2012), for each seed of ``draws``:
    one point by weight, then in every round as many as ``draws`` says, without
    replacement, with chances in proportion to weight times squared distance from all
    candidates so far. A round is one job for all seeds.

    A round takes the largest of ln(gap² n) plus Gumbel noise hashed from seed, round and
    point, so a task names no more points than a round draws, and the result hangs on
    neither partitions nor order. Points that are candidates already aren't drawn again.
    """
    features, seeds = list(features), list(draws)
    known = {s: np.empty((0, len(features))) for s in seeds}
    schema = "seed int, score double, " + ", ".join(f"`{f}` double" for f in features)
    noisy = [f"_u{i}" for i in range(len(seeds))]
    for step in range(rounds + 1):
        wanted = [draws[s] if step else 1 for s in seeds]

        def best_of_task(
            batches: Iterator[pd.DataFrame], centres: list = [known[s] for s in seeds], wanted: list = wanted,
        ) -> Iterator[pd.DataFrame]:
            best = [None] * len(wanted)
            for batch in batches:
                x, n = batch[features].to_numpy(float), batch["n"].to_numpy(float)
                for i, (near, many) in enumerate(zip(centres, wanted)):
                    gap = squared_gaps(x, near).min(1) if len(near) else np.ones(len(x))
                    far = gap > 0
                    u = np.maximum(batch[noisy[i]].to_numpy()[far], 2.0 ** -53)
                    found = batch.loc[far, features].assign(seed=i, score=np.log(gap[far] * n[far]) - np.log(-np.log(u)))
                    found = found if best[i] is None else pd.concat([best[i], found])
                    best[i] = found.sort_values(["score", *features], ascending=[False] + [True] * len(features)).head(many)
            for found in best:
                if found is not None:
                    yield found[["seed", "score", *features]]

        columns = {u: hashing.uniform(f"{s}/{step}", *[F.col(c) for c in features]) for u, s in zip(noisy, seeds)}
        first = W.partitionBy("seed").orderBy(F.desc("score"), *features)
        found = (
            points.withColumns(columns).mapInPandas(best_of_task, schema)
            .withColumn("_place", F.row_number().over(first)).filter(F.col("_place") <= F.lit(max(wanted))).toPandas())
        for i, s in enumerate(seeds):
            mine = found[(found["seed"] == i) & (found["_place"] <= wanted[i])].sort_values("_place")
            known[s] = np.vstack([known[s], mine[features].to_numpy(float)])
    return known


def _recluster(candidates: np.ndarray, mass: np.ndarray, k: int, seed: str) -> np.ndarray:
    """``k`` centres of the weighted candidates, which are a few per centre: drawn apart,
    then moved to the middle of what is nearest to them; the closest of several tries."""
    rng = np.random.default_rng(zlib.crc32(seed.encode()))
    mass = np.maximum(mass, EMPTY)
    best, least = None, np.inf
    for _ in range(RECLUSTER_TRIES):
        chosen = [int(rng.choice(len(mass), p=mass / mass.sum()))]
        gap = squared_gaps(candidates, candidates[chosen])[:, 0]
        while len(chosen) < k:
            chances = gap * mass
            chances = chances if chances.sum() > 0 else mass      # fewer distinct points than centres: some repeat
            chosen.append(int(rng.choice(len(mass), p=chances / chances.sum())))
            gap = np.minimum(gap, squared_gaps(candidates, candidates[chosen[-1:]])[:, 0])
        centres = candidates[chosen]
        for _ in range(RECLUSTER_ROUNDS):
            nearest = squared_gaps(candidates, centres).argmin(1)
            held = np.bincount(nearest, mass, k)
            moved = np.stack([np.bincount(nearest, mass * candidates[:, j], k) for j in range(candidates.shape[1])], axis=1)
            centres = np.where(held[:, None] > 0, moved / np.maximum(held, EMPTY)[:, None], centres)
        cost = float(mass @ squared_gaps(candidates, centres).min(1))
        if cost < least:
            best, least = centres, cost
    return best


def oversampled_centres(
    points: DataFrame, features: Sequence[str], candidates: Sequence[Candidate], seed: int,
) -> list[np.ndarray]:
    """Centres to start each candidate mixture from. Mixtures of one seed share the draws,
    and all share the jobs: one a round and one that weighs the drawn points."""
    most: dict[str, int] = {}
    for c in candidates:
        name = f"{seed}/{c.seed}"
        most[name] = max(c.k * OVERSAMPLE, most.get(name, 0))
    drawn = draw_candidates(points, features, most)
    weighed = _gather(points, features, [_Nearest(x, "diag") for x in drawn.values()])
    mass = {s: sums[:, 0] for s, (sums, _) in zip(drawn, weighed)}
    names = [f"{seed}/{c.seed}" for c in candidates]
    return [_recluster(drawn[s], mass[s], c.k, f"{s}/{c.k}") for s, c in zip(names, candidates)]


def _starts(
    points: DataFrame, features: Sequence[str], candidates: Sequence[Candidate], seed: int, start: str,
) -> list[Mixture]:
    """Spread-out centres, a few nearest-centre rounds and one maximisation, all
    over every point. Candidates of one seed share the draws, all share the rounds."""
    if start == "oversampled":
        centres = oversampled_centres(points, features, candidates, seed)
    elif start == "drawn":
        most = {}
        for c in candidates:
            most[c.seed] = max(c.k, most.get(c.seed, 0))
        drawn = {s: spread_centres(points, features, k, f"{seed}/{s}") for s, k in most.items()}
        centres = [drawn[c.seed][:c.k] for c in candidates]
    else:
        raise ValueError(f"unknown start: {start}")
    models = [_Nearest(x, c.kind) for x, c in zip(centres, candidates)]
    for left in range(START_ROUNDS, -1, -1):
        found = [sums for sums, _ in _gather(points, features, models)]
        if left:
            models = [
                _Nearest(np.where(s[:, :1] > 0, s[:, 1:1 + m.d] / np.maximum(s[:, :1], EMPTY), m.centres), m.kind)
                for m, s in zip(models, found)]
    out = []
    for c, m, sums in zip(candidates, models, found):
        fitted, empty = maximise(sums, m.d, c.kind, c.ridge), sums[:, 0] <= 0
        out.append(replace(
            fitted,
            means=np.where(empty[:, None], m.centres, fitted.means),
            covariances=np.where(empty[:, None, None], np.eye(m.d), fitted.covariances),
            weights=(fitted.weights + 1e-6) / (fitted.weights + 1e-6).sum()))
    return out


def fit_mixtures(
    points: DataFrame, features: Sequence[str], candidates: Sequence[Candidate],
    max_passes: int = 200, tolerance: float = 1e-3, seed: int = 42,
    starts: Sequence[Mixture] | None = None, start: str = "oversampled",
) -> list[tuple[Mixture, float]]:
    """Fit all candidates to folded points; ``(mixture, log-likelihood)`` each.

    A candidate stops when its mean log-likelihood gains less than
    ``tolerance``, and only then is marked ``converged``; the rest go on without
    it. ``starts`` gives each candidate's first parameters, in place of a start
    drawn from the points: ``oversampled``, in as many jobs for any number of centres and
    mixtures, or ``drawn``, one centre a job. Repeated points are added up and stored first; every
    pass reads that table.
    """
    features = list(features)
    kept = stored(points.groupBy(*features).agg(F.sum("n").alias("n")), "points")
    try:
        size = kept.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("points")).first()
        if not size["points"]:
            raise ValueError("no points to fit")
        total, work = size["n"], kept.coalesce(max(1, -(-size["points"] // TASK_POINTS)))
        if starts is None:
            models = _starts(work, features, candidates, seed, start)
        else:
            models = list(starts)
        before = [-np.inf] * len(models)
        active = list(range(len(models)))
        for step in range(1, max_passes + 1):
            found = _gather(work, features, [models[i] for i in active])
            going = []
            for i, (sums, likelihood) in zip(active, found):
                c = candidates[i]
                trace = models[i].history + (likelihood,)
                settled = likelihood / total - before[i] < tolerance
                models[i] = replace(
                    maximise(sums, len(features), c.kind, c.ridge), passes=step, history=trace, converged=settled)
                if not settled:
                    going.append(i)
                before[i] = likelihood / total
            active = going
            if not active:
                break
        ends = _gather(work, features, models)
        return [(m, likelihood) for m, (_, likelihood) in zip(models, ends)]
    finally:
        forget(kept)


def fit_mixture(
    points: DataFrame, features: Sequence[str], k: int, ridge: float = 1e-6, kind: str = "full",
    max_passes: int = 200, tolerance: float = 1e-3, seed: int = 42,
) -> Mixture:
    return fit_mixtures(
        points, features, [Candidate(k, ridge, kind, seed)], max_passes, tolerance, seed)[0][0]


def information(parameters: int, rows: float, likelihood: float) -> tuple[float, float]:
    """BIC and AIC; the likelihood is the sum of ln p(x)."""
    return parameters * np.log(rows) - 2 * likelihood, 2 * parameters - 2 * likelihood


def random_candidates(
    trials: int, seed: int, components: tuple[int, int] = (20, 60),
    ridge: tuple[float, float] = (1e-6, 1e-3), kinds: Sequence[str] = ("full",),
) -> list[Candidate]:
    """Seeded trials: uniform in components, log-uniform in ridge."""
    rng = np.random.default_rng(seed)
    low, high = np.log(ridge[0]), np.log(ridge[1])
    return [
        Candidate(
            int(rng.integers(components[0], components[1] + 1)),
            float(np.exp(rng.uniform(low, high))), str(rng.choice(list(kinds))), seed)
        for _ in range(trials)]


RUN_SCHEMA = "trial int, seed long, k int, ridge double, kind string, passes int, converged boolean, log_likelihood double, bic double, aic double"


@dataclass(frozen=True)
class Selection:
    """Every trial as a table, the fitted mixtures by trial, and the best."""

    runs: DataFrame
    mixtures: list[Mixture]
    best: Mixture
    best_trial: int


def select_mixture(
    points: DataFrame, features: Sequence[str], candidates: Sequence[Candidate],
    max_passes: int = 200, tolerance: float = 1e-3, seed: int = 42,
    starts: Sequence[Mixture] | None = None, start: str = "oversampled",
) -> Selection:
    """Fit all candidates and take the least BIC, then AIC. Candidates of
    several seeds may be mixed: the best of all seeds is the best trial."""
    from tripcast.operators.results import best_by_information

    fitted = fit_mixtures(points, features, candidates, max_passes, tolerance, seed, starts, start)
    rows = points.agg(F.sum("n").alias("n")).first()["n"]
    table = []
    for i, (c, (m, likelihood)) in enumerate(zip(candidates, fitted)):
        bic, aic = information(m.parameter_count(), rows, likelihood)
        table.append((i, c.seed, c.k, c.ridge, c.kind, m.passes, m.converged, likelihood, float(bic), float(aic)))
    runs = points.sparkSession.createDataFrame(table, RUN_SCHEMA)
    best = best_by_information(runs).first()
    if best is None:
        raise RuntimeError("no trial has a finite BIC")
    mixtures = [m for m, _ in fitted]
    return Selection(runs, mixtures, mixtures[best["trial"]], best["trial"])


def search_mixture(
    points: DataFrame, features: Sequence[str], rounds: int = 5, per_round: int = 6, seed: int = 42,
    components: tuple[int, int] = (20, 60), ridge: tuple[float, float] = (1e-6, 1e-3), kinds: Sequence[str] = ("full",),
    max_passes: int = 200, tolerance: float = 1e-3,
) -> Selection:
    """As ``select_mixture``, the candidates chosen in rounds by what those before reached in
    BIC; ``runs`` has the ``round``. The mixtures of a round share the passes."""
    space = {"k": trials.Span(*components, step=1), "ridge": trials.Span(*ridge, log=True), "kind": list(kinds)}
    kept = stored(points.groupBy(*features).agg(F.sum("n").alias("n")), "points")
    chosen: list[Selection] = []

    def evaluate(values: list[dict]) -> list[tuple[float]]:
        candidates = [Candidate(v["k"], v["ridge"], v["kind"], seed) for v in values]
        chosen.append(select_mixture(kept, features, candidates, max_passes, tolerance, seed))
        return [(r["bic"],) for r in chosen[-1].runs.orderBy("trial").collect()]      # a row a trial

    trials.search(space, evaluate, rounds, per_round, seed)
    runs = None
    for turn, one in enumerate(chosen):
        part = one.runs.withColumns({"trial": F.col("trial") + turn * per_round, "round": F.lit(turn)})
        runs = part if runs is None else runs.unionByName(part)
    mixtures = [m for one in chosen for m in one.mixtures]
    forget(kept)
    from tripcast.operators.results import best_by_information

    best = best_by_information(runs).first()["trial"]
    return Selection(runs, mixtures, mixtures[best], best)


def _matrix(columns: tuple[pd.Series, ...]) -> np.ndarray:
    return np.column_stack([c.to_numpy(float) for c in columns])


def assign_clusters(df: DataFrame, features: Sequence[str], mixture: Mixture, name: str = "cluster") -> DataFrame:
    """Add the most likely component of each row."""

    @F.pandas_udf("int")
    def likeliest(*columns: pd.Series) -> pd.Series:
        return pd.Series(mixture.joint(_matrix(columns)).argmax(1).astype("int32"))

    return df.withColumn(name, likeliest(*[F.col(c).cast("double") for c in features]))


def log_density(df: DataFrame, features: Sequence[str], mixture: Mixture, name: str = "log_density") -> DataFrame:
    """Add ln p(x) of each row."""

    @F.pandas_udf("double")
    def density(*columns: pd.Series) -> pd.Series:
        return pd.Series(_log_total(mixture.joint(_matrix(columns))))

    return df.withColumn(name, density(*[F.col(c).cast("double") for c in features]))


def model_scores(df: DataFrame, features: Sequence[str], mixture: Mixture) -> DataFrame:
    """One row: ``rows, parameters, log_likelihood, bic, aic``."""
    scored = log_density(df, features, mixture)
    p = F.lit(mixture.parameter_count())
    return scored.agg(
        F.count(F.lit(1)).alias("rows"), F.sum("log_density").alias("log_likelihood")
    ).select(
        "rows", p.cast("long").alias("parameters"), "log_likelihood",
        (p * F.log("rows") - 2 * F.col("log_likelihood")).alias("bic"),
        (2 * p - 2 * F.col("log_likelihood")).alias("aic"))


def draw(
    spark: SparkSession, mixture: Mixture, rows: int, features: Sequence[str], seed: int,
    id_col: str = "sample_id",
) -> DataFrame:
    """``rows`` points from the mixture, with ids 0, 1, 2...

    The component comes from the id's hash against the running weights, the
    point from ``mean + L z`` with hashed normals; all of it is column
    arithmetic over a range, so it runs in as many tasks as wanted.
    """
    d = mixture.d
    base = spark.range(rows).withColumnRenamed("id", id_col)
    u = hashing.uniform(f"{seed}/component", F.col(id_col))
    running = np.cumsum(mixture.weights)[:-1]
    component = sum(((F.lit(float(edge)) <= u).cast("int") for edge in running), F.lit(0))
    lower = [(i, j) for i in range(d) for j in range(i + 1)]
    low = np.linalg.cholesky(mixture.covariances)
    # one constant: the mean of each component, then its factor; a component is looked up, not joined
    table = [[float(v) for v in (*mixture.means[c], *(low[c][i, j] for i, j in lower))] for c in range(mixture.k)]
    parameters = F.from_json(F.lit(json.dumps(table)), "array<array<double>>")
    normals = {}
    for block in range(0, d, 4):
        words = hashing.gaussians(F.col(f"_key{block}"))
        normals.update({f"_z{block + i}": z for i, z in enumerate(words) if block + i < d})
    keys = {f"_key{b}": hashing.digest(f"{seed}/point{b // 4}", F.col(id_col)) for b in range(0, d, 4)}
    drawn = base.withColumns({"component": component, **keys}).withColumns(normals).withColumn(
        "_own", F.get(parameters, F.col("component")))
    part = {pair: F.get("_own", F.lit(d + n)) for n, pair in enumerate(lower)}
    values = [
        sum((part[i, j] * F.col(f"_z{j}") for j in range(i + 1)), F.get("_own", F.lit(i))).alias(name)
        for i, name in enumerate(features)]
    return drawn.select(id_col, "component", *values)


def draw_trips(
    spark: SparkSession, mixture: Mixture, rows: int, scaler, seed: int, id_col: str = "sample_id"
) -> DataFrame:
    """Synthetic trips: drawn, unscaled, the hour decoded, one trip per row."""
    points = scaler.inverse(draw(spark, mixture, rows, scaler.columns, seed, id_col))
    hour = tc.decode_hour(F.col("sin_hr"), F.col("cos_hr"))
    return points.drop("component").withColumns({"hour": hour, "trips": F.lit(1)})
