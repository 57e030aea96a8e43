"""Readers, generated relations and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_stream(spark: SparkSession, sf_dir: str, name: str, schema: StructType) -> DataFrame:
    """A table as a stream of its files. The path is a pattern, as a stream's plain path must be a folder and a table may be one file."""
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """With header; types inferred unless a schema is given."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def features_and_target(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Named columns as doubles, the target renamed ``label``."""
    return df.select(*[F.col(c).cast("double") for c in features], F.col(target).cast("double").alias("label"))


def by_position(df: DataFrame, features: slice, target: int) -> DataFrame:
    """Columns by place: a slice of them, and one renamed ``label``."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns[features]], F.col(f"`{df.columns[target]}`").alias("label"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def write_text(df: DataFrame, path: str, column: str = "value", exclusive: bool = False) -> int:
    """Characters written, counted as they are written. ``exclusive`` fails if the path exists; else it is replaced. A null is an empty line."""
    seen = Observation()
    lines = df.select(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")).alias("value"))
    lines.observe(seen, F.coalesce(F.sum(F.length("value")), F.lit(0)).alias("characters")).write.mode("errorifexists" if exclusive else "overwrite").text(path)
    return seen.get["characters"]


def numbers(spark: SparkSession, start: int, stop: int, step: int = 1) -> DataFrame:
    """Half-open like Python's range, empty where that is."""
    return spark.range(start, stop, step)


def grid(spark: SparkSession, a: float, b: float, n: int) -> DataFrame:
    """n evenly spaced points from a to b, both ends included."""
    return spark.range(n).select(F.col("id"), (F.lit(float(a)) + F.col("id") * ((b - a) / max(n - 1, 1))).alias("x"))


def until_sentinel(df: DataFrame, order: Column, value: str, sentinel: str, key: str | None = None) -> DataFrame:
    """Rows before the first one that holds the sentinel, by a total order, of all or of every ``key`` (null is one). Two passes over ``df``: one
    finds those rows, of which only the order travels, so no rows are gathered. ``streaming.sentinel`` does it on a stream."""
    stops = df.filter(F.col(value) == sentinel)
    if key is None:
        stop = stops.agg(F.min(order).alias("__stop"))
        return df.join(F.broadcast(stop), F.col("__stop").isNull() | (order < F.col("__stop"))).drop("__stop")
    stop = stops.groupBy(F.col(key).alias("__key")).agg(F.min(order).alias("__stop"))
    joined = df.join(stop, F.col(key).eqNullSafe(F.col("__key")), "left")
    return joined.filter(F.col("__stop").isNull() | (order < F.col("__stop"))).drop("__key", "__stop")


def coo(spark: SparkSession, rows: list[list[float]]) -> DataFrame:
    return spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(rows) for j, v in enumerate(r)], "i long, j long, v double")
