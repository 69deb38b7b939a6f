"""Cluster compactness: mean distance between the members of each cluster."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripcast.durable import checkpointed
from tripcast.operators import distance, filters, mixture, sampling
from tripcast.operators.scaling import Scaler
from tripcast.plans import settings as st
from tripcast.sources.trips import COORDINATES

FEATURES = ["hour", "weekday", *COORDINATES]

# Pickup zones of the study area
STUDY_ZONES = [
    4, 12, 13, 24, 41, 42, 43, 45, 48, 50, 68, 74, 75, 79, 87, 88, 90, 100, 103, 107, 113, 114, 116,
    120, 125, 127, 128, 137, 140, 141, 142, 143, 144, 148, 151, 152, 153, 158, 161, 162, 163, 164,
    166, 170, 186, 194, 202, 209, 211, 224, 229, 230, 231, 232, 233, 234, 236, 237, 238, 239, 243,
    244, 246, 249, 261, 262, 263,
]


@dataclass(frozen=True)
class Clustering:
    """Distinct points ``raw_hour, raw_weekday``, standardised features, ``n``
    and ``cluster``; and what is needed to place trips the same way."""

    points: DataFrame
    scaler: Scaler
    model: mixture.Mixture

    def place(self, trips: DataFrame) -> DataFrame:
        return mixture.assign_clusters(self.scaler.transform(trips), FEATURES, self.model)


def cluster_points(
    trips: DataFrame, k: int, ridge: float, seed: int, max_passes: int, tolerance: float,
    start: mixture.Mixture | None = None,
) -> Clustering:
    """Fit and assign on the folded points: far fewer than trips. ``start`` gives
    the first parameters over the standardised features, and the covariance kind."""
    folded = checkpointed(mixture.fold_points(trips, FEATURES))
    scaler = Scaler.fit(folded, FEATURES, weight="n")
    candidate = mixture.Candidate(k, ridge, start.kind if start else "full", seed)
    (model, _), = mixture.fit_mixtures(
        scaler.transform(folded), FEATURES, [candidate], max_passes, tolerance, seed, [start] if start else None)
    kept = folded.withColumns({"raw_hour": F.col("hour"), "raw_weekday": F.col("weekday")})
    return Clustering(mixture.assign_clusters(scaler.transform(kept), FEATURES, model), scaler, model)


def _distances(
    points: DataFrame, seed: int, draws: int | None, error: float | None, alone: float | None, clusters: range | None = None,
) -> DataFrame:
    if draws is None and error is None:
        return distance.mean_pair_distance(points, "cluster", FEATURES, alone, clusters, weight="n")
    return distance.sampled_pair_distance(
        points, "cluster", FEATURES, draws or distance.DRAWS, error, seed, alone, clusters, "n")


def cluster_distances(
    trips: DataFrame, k: int = st.COMPACT_K, ridge: float = st.COMPACT_RIDGE, share: float = 1.0,
    zones: list[int] | None = None, id_col: str = "trip_id", seed: int = 42,
    max_passes: int = 100, tolerance: float = 1e-3, start: mixture.Mixture | None = None,
    draws: int | None = None, error: float | None = None,
) -> DataFrame:
    """``cluster, mean_distance`` over a share of the study-area trips; clusters
    with fewer than two members report 0. With ``draws`` or ``error`` (a share of the
    mean) clusters with many pairs are measured on drawn ones, with an interval."""
    rows = filters.complete(filters.with_trip_columns(trips), FEATURES)
    rows = filters.from_zones(rows, STUDY_ZONES if zones is None else zones)
    rows = sampling.sample_exact_share(rows, share, id_col, seed)
    found = cluster_points(rows, k, ridge, seed, max_passes, tolerance, start)
    return _distances(found.points, seed, draws, error, 0.0, range(k))


@dataclass(frozen=True)
class Evening:
    distances: DataFrame   # per cluster, of Wednesday 18 h trips
    trips: DataFrame       # those trips with their cluster's distance
    busiest: DataFrame     # trips of the ten busiest clusters
    tightest: DataFrame    # trips of the ten most compact clusters
    report: DataFrame      # distances of the ten busiest, most compact first


def wednesday_evening(
    trips: DataFrame, k: int = st.BUSY_K, seed: int = 42, max_passes: int = 100, tolerance: float = 1e-3,
    start: mixture.Mixture | None = None, draws: int | None = None, error: float | None = None,
) -> Evening:
    """Clusters fitted on all trips, measured on Wednesdays at 18 h; ``draws`` and
    ``error`` as for ``cluster_distances``."""
    rows = filters.complete(filters.with_trip_columns(trips), FEATURES)
    found = cluster_points(rows, k, 1e-6, seed, max_passes, tolerance, start)
    points = found.points.filter((F.col("raw_hour") == 18) & (F.col("raw_weekday") == 2))
    distances = _distances(points, seed, draws, error, None)
    evening = found.place(filters.at_hour_on(rows, 18, 2))
    joined = distance.with_distance(evening, distances, clusters=k)
    busiest = distance.busiest_clusters(evening)
    return Evening(
        distances, joined,
        distance.of_clusters(joined, busiest),
        distance.of_clusters(joined, distance.tightest_clusters(distances)),
        distance.tightest_clusters(distance.of_clusters(distances, busiest)))
