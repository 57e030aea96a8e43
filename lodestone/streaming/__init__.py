"""Unbounded versions of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def odd_squares(stream: DataFrame, column: str = "value") -> DataFrame:
    """Squares of the odd integers of a text stream; text that is no integer is dropped. Stateless."""
    n = F.col(column).try_cast("bigint")
    return stream.filter(n.isNotNull() & (F.pmod(n, F.lit(2)) == 1)).select((n * n).alias("square"))


def character_counts(stream: DataFrame, column: str = "value") -> DataFrame:
    """Running counts of characters."""
    return stream.select(F.explode(F.split(F.col(column), "")).alias("c")).filter("c <> ''").groupBy("c").count()


def text_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.text(path)
