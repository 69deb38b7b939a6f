"""Real against drawn trips per origin, destination and hour."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripcast.durable import checkpointed
from tripcast.operators import compare, dating, filters, mixture, splits, zoning
from tripcast.operators.scaling import Scaler
from tripcast.plans import settings as st
from tripcast.sources.sinks import write_csv
from tripcast.sources.trips import DROPOFF_ZONE, PICKUP_TIME, PICKUP_ZONE


@dataclass(frozen=True)
class Comparison:
    table: DataFrame    # trips of both sides per origin, destination and hour
    lost: DataFrame     # drawn trips outside every zone box, and all drawn trips


def compare_draws(
    real: DataFrame, zones: DataFrame, drawn: DataFrame, lookup: dating.DateLookup
) -> Comparison:
    """Both sides put into zone boxes, the drawn trips dated; trips without a
    date or a zone are counted in ``lost`` or left out, not compared."""
    index = zoning.BoxIndex(zones)

    def placed(trips: DataFrame) -> DataFrame:
        at = index.locate(trips, "PU_longitude", "PU_latitude", PICKUP_ZONE, "pu_zone")
        return index.locate(at, "DO_longitude", "DO_latitude", DROPOFF_ZONE, "do_zone")
    synth = checkpointed(placed(drawn).select("sample_id", PICKUP_ZONE, DROPOFF_ZONE, "hour", "trips"))
    dated = dating.stamp(synth, lookup, "sample_id", st.DATE_SEED).filter(F.col(PICKUP_TIME).isNotNull())
    return Comparison(
        compare.compare_groups(placed(real), dated), filters.trips_without_zone(synth, PICKUP_ZONE, DROPOFF_ZONE))


def run(
    trips: DataFrame, zones: DataFrame, out: str | None = None, k: int = st.CHOSEN_K, ridge: float = st.CHOSEN_RIDGE,
    multiplier: float = st.SYNTHETIC_MULTIPLIER, runs: int = 1, seed: int = 42, max_passes: int = 200,
    tolerance: float = 1e-3, period: filters.Period = filters.STUDY,
) -> list[Comparison]:
    """One comparison per run, of trips drawn from a mixture of the training
    weeks; with ``out`` each is written there as CSV, in the folder ``run=i``."""
    spark = trips.sparkSession
    features = filters.MIXTURE_FEATURES
    real = filters.with_trip_columns(filters.study_period(trips, period))
    train = splits.split_by_weeks(filters.complete(real, features)).filter(F.col("part") == "train")
    folded = checkpointed(mixture.fold_points(train, features))
    scaler = Scaler.fit(folded, features, weight="n")
    total = int(folded.agg(F.sum("n")).first()[0])
    model = mixture.fit_mixture(scaler.transform(folded), features, k, ridge, "full", max_passes, tolerance, seed)
    lookup = dating.DateLookup(dating.date_probabilities(real))
    done = []
    for turn in range(runs):
        drawn = mixture.draw_trips(spark, model, int(total * multiplier), scaler, seed + turn)
        one = compare_draws(train, zones, drawn, lookup)
        if out:
            write_csv(one.table, f"{out.rstrip('/')}/run={turn + 1}")
        done.append(one)
    return done
