"""Connected components of a graph too large for the driver: alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Both steps are a grouped minimum and a join on the
same key; hubs are pre-aggregated by the partial minimum and split by the skew join, never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.store import Stored


def _tidy(e: DataFrame) -> DataFrame:
    return e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))  # u > v in every tidy edge
    return e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, rounds: int = 50) -> Stored:
    """``edges`` (u, v long) -> stored (node, component): nodes other than a component's least, with that least node.

    Nodes without edges are not listed. Loops and repeated edges do no harm; no edges give no rows.
    """
    now = Stored(_tidy(edges), "cc")
    for _ in range(rounds):
        mid = _tidy(_large_star(now.df))
        new = Stored(_tidy(_small_star(mid)), "cc")
        mark = lambda s: s.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        same = mark(now) == mark(new)
        now.drop()
        now = new
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    now.df = now.df.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return now
