"""Tables over finished runs. A run is one row per metric; there are as many
rows as trials, not trips."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripcast.durable import stored
from tripcast.joins import join_same, small
from tripcast.operators.ranking import group_positions

RUN = ["data_type", "nc", "epochs", "seed"]


def wide_results(results: DataFrame, metrics: Sequence[str], keys: Sequence[str] = RUN) -> DataFrame:
    """One column per metric, averaged over repeats of a run."""
    return results.groupBy(*keys).pivot("metric", list(metrics)).agg(F.avg("value"))


def mean_over_seeds(results: DataFrame, metrics: Sequence[str] = ("R²", "MAE")) -> DataFrame:
    """Mean of each metric per data type, epochs and component count."""
    wide = wide_results(results, metrics)
    return wide.groupBy("data_type", "epochs", "nc").agg(
        *[F.avg(F.col(f"`{m}`")).alias(m) for m in metrics])


def grouped_quantiles(
    df: DataFrame, groups: Sequence[str], column: str, shares: Sequence[float]
) -> DataFrame:
    """Exact quantiles per group: ``n`` and an array ``quantiles``, interpolated between
    the two nearest values; nulls don't count.

    Equal values are folded into one with a count, then put in order once for all groups
    and shares, so a group with many values spreads over tasks and none holds them all.
    """
    return _quantiles(_value_positions(df, groups, column), groups, column, shares)


def _value_positions(df: DataFrame, groups: Sequence[str], column: str) -> DataFrame:
    """Distinct values with their count ``w``, their ``position`` in the group and its size ``n``."""
    folded = stored(df.filter(F.col(column).isNotNull()).groupBy(*groups, column).agg(F.count(F.lit(1)).alias("w")), "folded")
    return group_positions(folded, groups, [column], "w", total="n")


def _quantiles(placed: DataFrame, groups: Sequence[str], column: str, shares: Sequence[float]) -> DataFrame:
    def at(rank: Column) -> Column:
        holds = (F.col("position") <= rank) & (rank < F.col("position") + F.col("w"))
        return F.max(F.when(holds, F.col(column)))

    places = [(F.col("n") - 1) * F.lit(float(s)) for s in shares]
    ends = placed.groupBy(*groups, "n").agg(
        *[at(F.floor(p)).alias(f"_lo{i}") for i, p in enumerate(places)],
        *[at(F.ceil(p)).alias(f"_hi{i}") for i, p in enumerate(places)])
    between = [
        F.when(F.col(f"_lo{i}") == F.col(f"_hi{i}"), F.col(f"_lo{i}")).otherwise(
            F.col(f"_lo{i}") * (F.ceil(p) - p) + F.col(f"_hi{i}") * (p - F.floor(p))) for i, p in enumerate(places)]
    return ends.select(*groups, "n", F.array(*[b.cast("double") for b in between]).alias("quantiles"))


def box_statistics(
    results: DataFrame, by: Sequence[str] = ("metric", "nc", "epochs", "data_type")
) -> DataFrame:
    """Quartiles, and whiskers at the last values within 1.5 interquartile
    ranges of the box. A null key is a group of its own."""
    by = list(by)
    placed = _value_positions(results, by, "value")    # a join of two stored tables
    boxes = stored(_quantiles(placed, by, "value", [0.25, 0.5, 0.75]).select(
        *by, F.col("quantiles")[0].alias("q1"), F.col("quantiles")[1].alias("median"), F.col("quantiles")[2].alias("q3")), "boxes")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    return join_same(placed, small(boxes, boxes.count()), by).groupBy(*by, "n", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("value"))).alias("low"),
        F.max(F.when(inside, F.col("value"))).alias("high"),
        F.sum(F.when(inside, 0).otherwise(F.col("w"))).cast("long").alias("outliers"),
    )


def model_comparison(results: DataFrame, metrics: Sequence[str] = ("R²", "SMAPE", "MAE")) -> DataFrame:
    """One row per data type, one column per metric."""
    return wide_results(results, metrics, ["data_type"])


def pareto_front(
    trials: DataFrame, study: Sequence[str], gain: str = "r2", loss: str = "smape"
) -> DataFrame:
    """Trials no other trial of the study beats: none has as much gain and as
    little loss with one of them better.

    Walking down the gain, a trial stays when its loss is the least of its own
    gain and below every loss seen at a higher gain: one ordered pass instead of
    comparing all pairs.
    """
    study = list(study)
    usable = trials.filter(F.col(gain).isNotNull() & F.col(loss).isNotNull())
    least = usable.groupBy(*study, gain).agg(F.min(loss).alias("_least"))
    above = W.partitionBy(*study).orderBy(F.col(gain).desc()).rowsBetween(W.unboundedPreceding, -1)
    front = least.withColumn("_above", F.min("_least").over(above)).filter(
        F.col("_above").isNull() | (F.col("_least") < F.col("_above")))
    kept = usable.join(front.drop("_above"), [*study, gain])
    return kept.filter(F.col(loss) == F.col("_least")).drop("_least")


def best_by_information(runs: DataFrame) -> DataFrame:
    """The run with the least BIC, then the least AIC; only finite values."""
    infinite = [F.lit(float(v)) for v in ("inf", "-inf", "nan")]
    finite = F.col("bic").isNotNull() & ~F.col("bic").isin(*infinite)
    return runs.filter(finite).orderBy("bic", "aic").limit(1)
