"""Writers and the matching readers for results and model parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("errorifexists").option("header", True).option("sep", sep).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One object per line, nulls kept."""
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def save_model(parameters: DataFrame, path: str) -> None:
    """Model state is an ordinary table of parameters."""
    write_parquet(parameters, path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
