"""Joins, sets and grouped computations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import sequences as S
from lodestone.functions.numbers import MOST_FACTORIAL, factorial_text
from lodestone.store import Stored, fresh, tasks


def _grams(df: DataFrame, threshold: int) -> DataFrame:
    """``seq`` with a row for each of its ``gram``s (width, number, text): those that a text of any length up to its own may need."""
    t, n = threshold, F.length("seq")

    def cut(w: int):
        """Grams for shorter texts of ``low`` to ``top`` characters, the band of this width."""
        low, top = (w + 1) * t // w + 1, w * t // (w - 1) if w > 1 else None
        shorter = F.least(n, F.lit(top)) if top else n
        numbers = F.when(n >= low, F.sequence(F.lit(0), shorter - t - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(numbers, lambda k: F.struct(F.lit(w).alias("width"), k.alias("number"), F.substr("seq", k * w + 1, F.lit(w)).alias("text")))

    widths = sorted({m // (m - t) for m in range(t + 1, 2 * t + 2)})  # beyond, all are 1
    return df.filter(n > t).select("seq", n.alias("n"), F.explode(F.concat(*[cut(w) for w in widths])).alias("gram"))


def similar_pairs(a: DataFrame, b: DataFrame, threshold: int, blocks: bool = False) -> DataFrame:
    """Pairs (seq_a, seq_b, score) of texts ``seq`` with more than ``threshold`` equal positions, up to the shorter length.

    With ``blocks`` every different pair once, by an equi-join on positional grams: if the shorter text has n characters, at most n - t - 1 of
    them differ, so of its first n - t grams of n // (n - t) characters, side by side, one at least is equal. That width falls from t + 1 to
    1 as n grows to 2 t + 1 and each width serves a band of lengths, so a text writes a row a character and some t log t for the bands
    of shorter texts, whatever lengths there are. Lossless, and the way to go at scale; without it every pair is compared.
    """
    left, right = a.select(F.col("seq").alias("seq_a")), b.select(F.col("seq").alias("seq_b"))
    score = S.matches(F.col("seq_a"), F.col("seq_b"))
    if not blocks:
        return left.join(right, score > threshold).withColumn("score", score)
    x, y = (_grams(df.select("seq").distinct(), threshold).toDF(f"seq_{k}", f"n_{k}", "gram") for k, df in (("a", a), ("b", b)))
    n = F.least("n_a", "n_b")
    rest = n - threshold
    width = F.floor(n / rest).cast("int")
    met = x.join(y, "gram").filter((F.col("gram.width") == width) & (F.col("gram.number") < rest))
    gram = lambda c, k: F.substr(F.col(c), k * width + 1, width)
    before = F.when(F.col("gram.number") > 0, F.sequence(F.lit(0), F.col("gram.number") - 1)).otherwise(F.array().cast("array<int>"))
    first = ~F.exists(before, lambda k: gram("seq_a", k) == gram("seq_b", k))  # a pair counts where it first meets
    return met.filter(first).select("seq_a", "seq_b", score.alias("score")).filter(F.col("score") > threshold)


def ranked(df: DataFrame, by: list[Column], out: str) -> DataFrame:
    """Adds the rank from 1 in the order ``by`` (long). Ties take an order of their own, so that copies of one key do not share a task; end
    ``by`` with a unique column where reruns must agree.

    Rows are dealt to ranges whose bounds Spark samples, sorted there and stored with their place. Ranges ascend, so a rank is the place in
    the range plus the sizes of the ranges before it: no task sees more than its range, and the driver one number a range.
    """
    spark, tie, at = df.sparkSession, fresh(df, "ranked_tie"), fresh(df, "ranked_at")
    order = [*by, F.col(tie)]
    dealt = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(tasks(spark), *order).sortWithinPartitions(*order)
    held = Stored(dealt.withColumn(at, F.monotonically_increasing_id()).drop(tie), "ranked").df
    part = F.shiftright(at, 33)  # the range's number; the lower 33 bits are the place in it
    sizes = sorted(map(tuple, held.groupBy(part.alias("part")).agg(F.count("*")).collect()))
    before, moves = 0, []
    for k, n in sizes:
        moves.append((k, before - (k << 33) + 1))
        before += n
    ranges = spark.createDataFrame(moves, "ranked_part long, ranked_move long")
    moved = held.join(F.broadcast(ranges), part == F.col("ranked_part")).withColumn(out, F.col(at) + F.col("ranked_move"))
    return moved.drop(at, "ranked_part", "ranked_move")


def zip_by_order(a: DataFrame, b: DataFrame, by_a: list[Column], by_b: list[Column]) -> DataFrame:
    """Rows of equal rank side by side, to the shorter length. See :func:`ranked`."""
    return ranked(a, by_a, "pos").join(ranked(b, by_b, "pos"), "pos")


def with_factorial(df: DataFrame, n_col: str, out: str) -> DataFrame:
    """Adds the decimal text of a column's factorial, null where it is null, negative or above ``MOST_FACTORIAL``. Each number that occurs is multiplied
    out once, whatever the rows: at most 9,001 of them, which bounds what is broadcast."""
    key, n = fresh(df, "factorial_of"), F.col(f"`{n_col}`")
    numbers = df.filter((n >= 0) & (n <= MOST_FACTORIAL)).select(n.cast("long").alias(key)).distinct()
    made = numbers.select(key, factorial_text(F.col(key)).alias(out))
    return df.join(F.broadcast(made), n == F.col(key), "left").drop(key)


def duplicated(df: DataFrame, key: str, at_least: int = 2) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") >= at_least)


def max_distinct_key(df: DataFrame, key: str, value: str, order: Column) -> DataFrame:
    """The key with most different values; of equals the one that is first by ``order`` (an aggregate)."""
    per = df.groupBy(key).agg(F.countDistinct(value).alias("n_distinct"), order.alias("ord"))
    return per.orderBy(F.col("n_distinct").desc(), F.col("ord"), F.col(key)).limit(1).select(key, "n_distinct")


def char_mode(df: DataFrame, key: str, text: str) -> DataFrame:
    """Per key the most frequent character; of equals the one whose last use is latest. Within a row, so no shuffle."""
    cs = F.split(F.col(text), "")
    counted = F.transform(F.array_distinct(cs), lambda c: F.struct(F.size(F.filter(cs, lambda x: x == c)).alias("n"), (F.length(F.col(text)) - F.call_function("instr", F.reverse(F.col(text)), c)).alias("last"), c.alias("c")))
    top = F.array_max(counted)
    return df.filter(F.length(text) > 0).select(key, top["c"].alias("c"), top["n"].cast("long").alias("n"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b).union(b.subtract(a))


def is_subset(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether every row of a is in b."""
    return a.subtract(b).agg((F.count("*") == 0).alias("is_subset"))
