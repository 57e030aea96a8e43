"""Least squares with a train/test split."""

from __future__ import annotations

import math

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.store import fresh

#: Digits of a key that one pass of a selection counts: 16**3 bins come to the driver.
DIGITS = 3


def up_to_kth(df: DataFrame, keys: list[tuple[Column, int]], k) -> Column:
    """A predicate that holds for the ``k`` rows of ``df`` that are least by ``keys``: texts of so many lower-case hexadecimal digits, without
    nulls; a later key only counts among rows that are equal in all before. ``k`` is a number or a function of the number of rows. Of rows
    with the same keys all or none are taken, the fewer.

    A radix selection: one pass counts rows by their first digits, the next looks only at the bin in which the k-th falls, until a bin
    ends at the k-th row: log(n) / log(4096) passes and one more, each over the first key alone. No row is moved, sorted or ranked.
    """
    (key, digits), prefix, wanted = keys[0], "", None
    for seen in range(0, digits, DIGITS):
        width = min(DIGITS, digits - seen)
        inside = df.filter(key.startswith(prefix)) if prefix else df
        bins = sorted(map(tuple, inside.groupBy(F.substring(key, seen + 1, width)).agg(F.count("*")).collect()))
        if wanted is None:
            n = sum(c for _, c in bins)
            wanted = min(k(n) if callable(k) else k, n)
        for label, c in bins:
            if wanted < c:
                prefix += label
                break
            wanted -= c
        else:  # all of them are taken
            return key.startswith(prefix) | (F.substring(key, 1, len(prefix)) < prefix) if bins else F.lit(False)
        if wanted == 0:  # none of the bin is
            return F.substring(key, 1, len(prefix)) < prefix
    rest = up_to_kth(df.filter(key == prefix), keys[1:], wanted) if keys[1:] else F.lit(False)
    return (key < prefix) | ((key == prefix) & rest)


def exact_split(df: DataFrame, id_col: str, test_share: float, seed: int) -> DataFrame:
    """Adds ``is_test`` for exactly ceil(share * rows) rows, those of least md5(seed:id). Rows of one id are told apart by their other
    columns, equal rows by their place; a null id counts as an empty one. Where about the share is enough, :func:`hash_split` reads once."""
    place, hexed = fresh(df, "split_place"), lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    held = df.withColumn(place, F.monotonically_increasing_id())
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    content = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in df.columns])
    first = up_to_kth(held, [(digest, 32), (hexed(content), 16), (hexed(F.col(place)), 16)], lambda n: math.ceil(n * test_share))
    return held.withColumn("is_test", first).drop(place)


def hash_split(df: DataFrame, id_col: str, test_share: float, seed: int) -> DataFrame:
    """Adds ``is_test`` row by row, without a shuffle; the share is met on average."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    return df.withColumn("is_test", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") < int(test_share * 2**32))


def fit(df: DataFrame, features: list[str], label: str) -> LinearRegressionModel:
    """By the platform's solver, which collects the model; :func:`least_squares` keeps it a row."""
    vectors = VectorAssembler(inputCols=features, outputCol="features").transform(df)
    return LinearRegression(solver="normal", regParam=0.0, labelCol=label).fit(vectors)


def predict(model: LinearRegressionModel, df: DataFrame, features: list[str]) -> DataFrame:
    return model.transform(VectorAssembler(inputCols=features, outputCol="features").transform(df)).drop("features")


def r2(df: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """One row; both sums in one pass: 1 - SSE / (n var). Null for a label that does not vary and for no rows."""
    y = F.col(label)
    sse = F.sum((y - F.col(prediction)) * (y - F.col(prediction)))
    return df.agg((1 - F.try_divide(sse, F.count(y) * F.var_pop(y))).alias("r2"))


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def _fold(steps: Column, f) -> Column:
    """An array of doubles that grows by ``f(grown so far, step)``."""
    return F.aggregate(steps, F.array().cast("array<double>"), lambda done, step: F.array_append(done, f(done, step)))


def _range(n: Column) -> Column:
    """0 .. n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _cell(i: Column, j: Column) -> Column:
    """The 1-based place of cell (i, j), j <= i, in a triangle that is stored row by row."""
    return (i * (i + 1) / 2).cast("int") + j + 1


def cholesky(packed: Column, size: int) -> Column:
    """The lower factor of a symmetric matrix; both as triangles row by row. A pivot that is zero but for rounding makes it and all
    that follows null: columns that depend on each other have no unique solution."""
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(size) for j in range(i + 1)])

    def cell(done, at):
        i, j = at["i"], at["j"]
        own, other = (F.slice(done, _cell(r, F.lit(0)), j) for r in (i, j))
        value = F.element_at(packed, _cell(i, j))
        rest = value - _dot(own, other)
        pivot = F.when(rest > F.abs(value) * 1e-13, F.sqrt(rest))
        return F.when(i == j, pivot).otherwise(rest / F.element_at(done, _cell(j, j)))

    return _fold(cells, cell)


def solve(lower: Column, right: Column, size: int) -> Column:
    """x of L L' x = right: forwards through the rows of L, then backwards through its columns."""
    row = lambda i: F.slice(lower, _cell(i, F.lit(0)), i)
    pivot = lambda i: F.element_at(lower, _cell(i, i))
    y = _fold(_range(F.lit(size)), lambda done, i: (F.element_at(right, i + 1) - _dot(row(i), done)) / pivot(i))

    def back(done, i):  # done holds x from the last one down to i + 1
        below = F.transform(_range(F.size(done)), lambda k: F.element_at(lower, _cell(F.lit(size - 1) - k, i)))
        return (F.element_at(y, i + 1) - _dot(below, done)) / pivot(i)

    return F.reverse(_fold(F.reverse(_range(F.lit(size))), back))


def least_squares(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """One row: ``coefficients`` (array, in the order of ``features``) and ``intercept`` of ordinary least squares.

    One aggregation makes the centred Gram matrix (it combines before its shuffle, and k features need about k * k / 2 numbers), array folds
    factor and solve it; nothing is collected. Rows with a null or NaN in a column used do not count. Without a unique solution all is null.
    """
    k, names = len(features), [*features, label]
    clean = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(names)])
    clean = clean.filter(" AND ".join(f"x{i} IS NOT NULL AND NOT isnan(x{i})" for i in range(k + 1)))
    covered = F.array(*[F.covar_pop(f"x{i}", f"x{j}") for i in range(k) for j in range(i + 1)])
    moments = clean.agg(covered.alias("gram"), F.array(*[F.covar_pop(f"x{i}", f"x{k}") for i in range(k)]).alias("right"), F.array(*[F.avg(f"x{i}") for i in range(k)]).alias("centre"), F.avg(f"x{k}").alias("mean"))
    factored = moments.withColumn("lower", cholesky(F.col("gram"), k))
    solved = factored.withColumn("coefficients", solve(F.col("lower"), F.col("right"), k))
    solved = solved.withColumn("coefficients", F.when(F.forall("coefficients", lambda c: c.isNotNull()), F.col("coefficients")))
    return solved.select("coefficients", (F.col("mean") - _dot(F.col("coefficients"), F.col("centre"))).alias("intercept"))


def apply_row(df: DataFrame, model: DataFrame, features: list[str], out: str = "prediction") -> DataFrame:
    """``df`` with the prediction of a model of one row, as :func:`least_squares` makes it."""
    names = [fresh(df, c) for c in ("coefficients", "intercept")]
    one = F.broadcast(model.select("coefficients", "intercept").toDF(*names))
    x = F.array(*[F.col(f"`{c}`").cast("double") for c in features])
    return df.join(one).withColumn(out, F.col(names[1]) + _dot(F.col(names[0]), x)).drop(*names)
