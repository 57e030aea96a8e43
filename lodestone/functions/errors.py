"""Expressions that may fail: the value, or a record of what went wrong, row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHOLE, DECIMAL = r"^[+-]?[0-9]+$", r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)([eE][+-]?[0-9]+)?$"


def _outcome(value: Column, kind: Column, given: Column) -> Column:
    """A struct of ``value`` and ``error`` (class, input); one of them is null."""
    return F.struct(F.when(kind.isNull(), value).alias("value"), F.when(kind.isNotNull(), F.struct(kind.alias("class"), given.cast("string").alias("input"))).alias("error"))


def whole_number(text: Column, kind: str = "bigint") -> Column:
    """Text as a whole number. Classes of failure: MISSING (null), EMPTY (blank), FRACTION (a number that is not whole), NOT_A_NUMBER and
    OUT_OF_RANGE (whole, but not of this type). Blanks around a number do not matter."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    value = F.when(t.rlike(WHOLE), t.try_cast(kind))
    wrong = F.when(text.isNull(), "MISSING").when(t == "", "EMPTY").when(t.rlike(WHOLE), F.when(value.isNull(), "OUT_OF_RANGE"))
    return _outcome(value, wrong.when(t.rlike(DECIMAL), "FRACTION").otherwise("NOT_A_NUMBER"), text)


def element(a: Column, index: Column) -> Column:
    """The element at a 0-based index, from the end if it is negative. Classes: MISSING (no array or no index), INDEX (none there)."""
    n = F.size(a)
    at = F.when(index < 0, n + index).otherwise(index)
    wrong = F.when(a.isNull() | index.isNull(), "MISSING").when((at < 0) | (at >= n), "INDEX")
    return _outcome(F.get(a, at), wrong, index)


def parted(df: DataFrame, outcome: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose outcome has a value, which takes its place, and those to be looked at, with ``error_class`` and ``error_input``."""
    x = F.col(f"`{outcome}`")
    good = df.filter(x["error"].isNull()).withColumn(outcome, x["value"])
    bad = df.filter(x["error"].isNotNull()).withColumns({"error_class": x["error"]["class"], "error_input": x["error"]["input"]}).drop(outcome)
    return good, bad
