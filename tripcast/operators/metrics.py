"""Forecast accuracy, in one aggregation pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values
SMAPE_FLOOR = 1e-8    # added to the divisor
MAPE_LIMIT = 1e9      # larger values are reported as null
METRICS = ["R²", "MAE", "MSE", "RMSE", "MAPE", "SMAPE"]


def metric_columns(actual: Column, predicted: Column) -> dict[str, Column]:
    """Aggregate columns ``n, r2, mae, mse, rmse, mape, smape``.

    R² is 1 - SSE/SST, null for a single row; with constant actuals it is 1 for
    a perfect forecast and 0 otherwise. MAPE skips zero actuals.
    """
    y, p = actual.cast("double"), predicted.cast("double")
    n = F.count(y)
    sse, sst = F.sum((y - p) * (y - p)), F.var_pop(y) * n
    r2 = F.when(n > 1, F.when(sst == 0, F.when(sse == 0, 1.0).otherwise(0.0)).otherwise(1 - sse / sst))
    mse = F.avg((y - p) * (y - p))
    mape = F.avg(F.when(y != 0, F.abs((y - p) / y))) * 100
    smape = F.avg(2 * F.abs(p - y) / (F.abs(y) + F.abs(p) + F.lit(SMAPE_FLOOR))) * 100
    return {
        "n": n, "r2": r2, "mae": F.avg(F.abs(y - p)), "mse": mse, "rmse": F.sqrt(mse),
        "mape": F.when(mape <= MAPE_LIMIT, mape), "smape": smape,
    }


def accuracy(
    df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()
) -> DataFrame:
    columns = metric_columns(F.col(actual), F.col(predicted))
    return df.groupBy(*by).agg(*[c.alias(name) for name, c in columns.items()])


def mean_r2_over_outputs(df: DataFrame, actual: str, predicted: str, output: str) -> DataFrame:
    """R² of each output, then their plain mean."""
    return accuracy(df, actual, predicted, [output]).agg(F.avg("r2").alias("r2"))


def as_long(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, metric, value``: one row per metric."""
    names = [m for m, c in _COLUMN.items() if c in wide.columns]
    pairs = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(_COLUMN[m]).alias("value")) for m in names])
    return wide.select(*keys, F.inline(pairs))


_COLUMN = {"R²": "r2", "MAE": "mae", "MSE": "mse", "RMSE": "rmse", "MAPE": "mape", "SMAPE": "smape"}
