"""Mixing sources to target weights.

Tokens are aggregated per source, each source's repetition rate is target / size, and each document is emitted
floor(rate) times plus one more time when a hash-seeded uniform number falls below the fraction. The draw depends on
the seed, the document id and nothing else, so reruns agree and no random state crosses tasks.

Targets: every source gets a weight by its rank in code-point order (null last); ``budget`` times all tokens are shared
by weight, a source's target stops at ``max_repeat`` times its size, and the excess is shared again by weight until none
is above. The fixed point has a closed form: order sources by cap / weight; the level L with sum(min(cap, L * weight)) =
budget is found from prefix sums, so no iteration is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.store import BLANKS, WORD, Stored, fresh

#: More sources than this are joined by shuffle instead of broadcast (a row is a name and four numbers).
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    """Words of the text; null has none. Each word becomes one letter, so no array of words is built."""
    marks = F.regexp_replace(text, WORD, "w")
    return F.coalesce(F.length(F.translate(marks, BLANKS, "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], budget: float, max_repeat: float) -> DataFrame:
    """One row per source: ``source, source_size, target``. ``sizes`` has ``source, size`` with one row per document.

    An empty table gives no row; sources without any token have target 0. One row per source reaches the window
    functions, which run in one task; documents never do.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.lit(float(weights[-1]))
    for k in range(len(weights) - 2, -1, -1):
        weight = F.when(rank % len(weights) == k, float(weights[k])).otherwise(weight)
    per = per.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(max_repeat))
    by_ratio = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    per = (
        per.withColumn("capped_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("all_size", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("w").over(everything))
    )
    level = (F.col("all_size") * float(budget) - F.col("capped_before")) / (F.col("all_weight") - F.col("weight_before"))
    per = per.withColumn("level", level).withColumn("open", F.col("level") * F.col("w") < F.col("cap"))
    # The first open source in ratio order fixes the level for itself and all after it; with none open all are capped.
    final = F.min(F.when(F.col("open"), F.struct("weight_before", "level"))).over(everything)["level"]
    target = F.when(final.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), final * F.col("w")))
    return per.select("source", "source_size", target.alias("target"))


def copies(doc_id: Column, rate: Column, seed: int) -> Column:
    """floor(rate) plus a Bernoulli draw of the fraction, from the first 32 bits of md5(seed:id)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    return F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    budget: float = 1.5,
    max_repeat: float = 2.0,
    seed: int = 17,
    out: Sequence[str] = ("size", "source_size", "target", "copies"),
) -> DataFrame:
    """``docs`` plus the four columns ``out``: words, its source's words, its source's target, times to emit.

    Null text has size 0; null is a source of its own, ranked last; rows with equal ids draw alike; an empty table
    gives an empty result. Columns are added under names that ``docs`` must not have (an error); :func:`plan_names` finds free ones.
    """
    if taken := {c.lower() for c in docs.columns} & {c.lower() for c in out}:
        raise ValueError(f"docs has {', '.join(sorted(taken))} already; plan_names() finds free names")
    size, source_size, target, n = out
    text, source = F.col(f"`{text_col}`"), F.col(f"`{source_col}`")
    sized = docs.withColumn(size, word_count(text))
    per = source_targets(docs.select(source.alias("source"), word_count(text).alias("size")), weights, budget, max_repeat)
    key = fresh(docs, "mix_source_key")
    per = per.select(F.col("source").alias(key), F.col("source_size").alias(source_size), F.col("target").alias(target))
    per = Stored(per, "mix-sources").df
    if per.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        per = F.broadcast(per)
    joined = sized.join(per, source.eqNullSafe(F.col(key)), "left").drop(key)
    rate = F.when(F.col(source_size) > 0, F.col(target) / F.col(source_size)).otherwise(F.lit(1.0))
    return joined.withColumn(n, copies(F.col(f"`{id_col}`"), rate, seed).cast("int"))


def plan_names(docs: DataFrame) -> list[str]:
    return [fresh(docs, c) for c in ("size", "source_size", "target", "copies")]


def emit(mixed: DataFrame, copies_col: str) -> DataFrame:
    """Each row as often as ``copies_col`` says; rows with 0 go."""
    some = mixed.filter(F.col(copies_col) > 0)
    k = fresh(some, "copy_no")
    return some.withColumn(k, F.explode(F.sequence(F.lit(1), F.col(copies_col)))).drop(k, copies_col)


#: op2: the same arithmetic in DuckDB. Words by RE2; the draw from the same md5 prefix.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, (source_size * 2.0)::DOUBLE AS cap FROM s),
p AS (SELECT *,
    coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)::DOUBLE AS cb,
    coalesce(sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)::DOUBLE AS wb,
    sum(source_size) OVER ()::DOUBLE AS total, sum(w) OVER ()::DOUBLE AS tw FROM r),
l AS (SELECT *, (total * 1.5 - cb) / (tw - wb) AS level FROM p),
f AS (SELECT arg_min(level, wb) FILTER (WHERE level * w < cap) AS final FROM l),
t AS (SELECT source, source_size, CASE WHEN final IS NULL THEN cap ELSE least(cap, final * w) END AS target FROM l, f),
j AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 1.0::DOUBLE END AS rate,
    ('0x' || substr(md5('17:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
    (size * (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM j
"""
