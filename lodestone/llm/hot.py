"""Joins of rows with a table of one row a key, where a few keys may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of the rows is hot, so fewer than its inverse are.
SHARE = 1000


def join_keyed(rows: DataFrame, keys: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``keys``, which has one row for every different ``key`` and their number in ``count``.

    Hot keys, fewer than a thousand whatever the data, are broadcast; rows of the others are shuffled, none of whose keys has more than
    a thousandth of all rows. ``rows`` is read twice. Null keys meet nothing.
    """
    least = total // SHARE
    hot = F.broadcast(keys.filter(F.col(count) > least))
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(keys.filter(F.col(count) <= least), key))
