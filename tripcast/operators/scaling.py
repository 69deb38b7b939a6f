"""Standardising features with their mean and population deviation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scale_parameters(df: DataFrame, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """``feature, mean, scale``; a constant feature keeps scale 1. With a weight
    column each row counts that many times."""
    values = []
    for c in columns:
        x = F.col(c).cast("double")
        if weight is None:
            mean, deviation = F.avg(x), F.stddev_pop(x)
        else:
            total = F.sum(weight)
            mean = F.sum(x * F.col(weight)) / total
            square = F.sum(x * x * F.col(weight)) / total
            deviation = F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))
        values += [mean.alias(f"m_{c}"), deviation.alias(f"s_{c}")]
    row = df.agg(*values)
    pairs = F.array(*[
        F.struct(
            F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean"),
            F.when(F.col(f"s_{c}") == 0, 1.0).otherwise(F.col(f"s_{c}")).alias("scale"),
        ) for c in columns])
    return row.select(F.inline(pairs))


@dataclass(frozen=True)
class Scaler:
    """The fitted parameters: two numbers per feature."""

    columns: list[str]
    means: list[float]
    scales: list[float]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str], weight: str | None = None) -> Scaler:
        return cls.from_table(scale_parameters(df, columns, weight), columns)

    @classmethod
    def from_table(cls, table: DataFrame, columns: Sequence[str]) -> Scaler:
        rows = {r["feature"]: r for r in table.collect()}
        if any(rows[c]["mean"] is None for c in columns):
            raise ValueError("no rows to scale")
        return cls(list(columns), [rows[c]["mean"] for c in columns], [rows[c]["scale"] for c in columns])

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: (F.col(c) - F.lit(m)) / F.lit(s)
            for c, m, s in zip(self.columns, self.means, self.scales)})

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: F.col(c) * F.lit(s) + F.lit(m)
            for c, m, s in zip(self.columns, self.means, self.scales)})
