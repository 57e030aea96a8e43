"""SimHash near-duplicates with pivot distance tables.

Fingerprints are 64 majority bits over XXH64 hashes of word shingles. Distinct fingerprints get a table of Hamming
distances to fixed pivots. Two fingerprints at most ``radius`` bits apart agree on at least ``blocks - radius`` of
``blocks`` bit blocks, so pairs are formed only inside buckets of such block combinations; a pair whose pivot distances
differ by more than ``radius`` in any coordinate is discarded by the triangle inequality, and survivors are verified bit by
bit. A bucket with more than ``BUCKET`` fingerprints is not paired: for radius 2 its members meet instead at the
fingerprints one bit away from them (two are within 2 bits exactly if they share such a neighbour or one is the other's),
which is linear in the bucket and loses no link between components.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import components
from lodestone.llm.store import Stored, fresh

SEED = 42
RADIUS, BLOCKS = 2, 4
#: Fingerprints in a bucket that are still paired directly.
BUCKET = 48
PIVOTS = 16


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of the text's shingles, repeats included; a text of fewer words is one shingle, none gives none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: lower() touches A-Z only
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    grams = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, len(words) - width + 1)


def majority(h: np.ndarray) -> int:
    """A bit is 1 if set in over half the hashes; no hashes: 0."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for part in np.array_split(h, len(h) // 8192 + 1):
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int("".join("1" if b else "0" for b in 2 * ones > len(h)), 2)


def fingerprint(text: str | None, width: int) -> int:
    """The majority bits of the text's shingle hashes; no words: 0."""
    return majority(shingle_hashes(text, width))


def with_fingerprint(docs: DataFrame, text_col: str, out: str, width: int = 3, keep_columns: Sequence[str] | None = None) -> DataFrame:
    """``keep_columns`` (all by default) plus ``out``: the fingerprint as a signed long."""
    names = list(docs.columns if keep_columns is None else keep_columns)
    source = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`"))
    source = source.toDF(*[f"c{k}" for k in range(len(names) + 1)])  # Arrow functions take no names with dots, nor two of a name
    schema = source.drop(f"c{len(names)}").schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(t, width) for t in b.column(len(names)).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(prints)], names=schema.names)

    return source.mapInArrow(run, schema).toDF(*names, out)


def pivots(n: int = PIVOTS) -> list[int]:
    """Fixed reference fingerprints, as signed longs."""
    made = [xxhash.xxh64_intdigest(f"pivot {k}".encode(), 0) for k in range(n)]
    return [x - (1 << 64) if x >> 63 else x for x in made]


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def pivot_table(prints: DataFrame, fp: str = "fp") -> DataFrame:
    """Adds ``p0..``: Hamming distance to each pivot."""
    return prints.withColumns({f"p{k}": _distance(F.col(fp), F.lit(p)).cast("byte") for k, p in enumerate(pivots())})


def bucket_masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """Bit masks of every choice of blocks - radius blocks; two fingerprints within radius agree under one at least."""
    size = 64 // blocks
    ones = [((1 << size) - 1) << (size * k) for k in range(blocks)]
    made = [sum(c) for c in combinations(ones, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in made]


def bucketed(prints: DataFrame) -> DataFrame:
    """``prints`` (node, fp), a row per choice of blocks that it shares with others: ``which``, ``key``, pivot distances, members ``n``."""
    masks = F.array(*[F.struct(F.lit(k).alias("which"), F.lit(m).alias("mask")) for k, m in enumerate(bucket_masks())])
    keyed = pivot_table(prints).withColumn("b", F.explode(masks))
    keyed = keyed.withColumn("which", F.col("b.which")).withColumn("key", F.col("fp").bitwiseAND(F.col("b.mask"))).drop("b")
    sizes = keyed.groupBy("which", "key").agg(F.count("*").alias("n")).filter("n > 1")
    return keyed.join(sizes, ["which", "key"])


def close_pairs(buckets: DataFrame) -> DataFrame:
    """Pairs (u < v) of nodes of a bucket at most ``RADIUS`` bits apart: pivot distances first, then the bits."""
    a, b = buckets.alias("a"), buckets.alias("b")
    near = F.greatest(*[F.abs(F.col(f"a.p{k}") - F.col(f"b.p{k}")) for k in range(PIVOTS)]) <= RADIUS
    same = (F.col("a.which") == F.col("b.which")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node"))
    pairs = a.join(b, same & near & (_distance(F.col("a.fp"), F.col("b.fp")) <= RADIUS))
    return pairs.select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))


def links(prints: DataFrame) -> DataFrame:
    """Edges (u, v) between fingerprints whose components are those of "at most 2 bits apart" among the distinct ``fp`` of ``prints``.

    In large buckets members point to shared neighbours, which are folded to the least member, so every edge joins two that occur.
    """
    sized = bucketed(prints.select(F.col("fp").alias("node"), "fp"))
    small, large = sized.filter(F.col("n") <= BUCKET), sized.filter(F.col("n") > BUCKET)
    direct = close_pairs(small)

    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << k) - (1 << 64) if k == 63 else 1 << k).cast("long") for k in range(64)])
    star = large.select("fp").distinct().withColumn("near", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))))
    hub = star.groupBy("near").agg(F.min("fp").alias("hub"), F.max("fp").alias("top")).filter("hub < top").drop("top")
    shared = star.join(hub, "near").filter("fp > hub").select(F.col("fp").alias("u"), F.col("hub").alias("v"))
    return direct.union(shared)


def with_component(prints: DataFrame, id_col: str, fp_col: str, out: str) -> DataFrame:
    """``prints`` (a row per document) plus ``out``: the least id reachable over links of at most 2 bits.

    The graph's nodes are the fingerprints that occur, whatever ids they have. A null id cannot name a component and counts
    only as a member, through which others are linked; a component of null ids alone is named null. Repeated ids share what their
    fingerprints get; an empty table stays empty.
    """
    nodes = Stored(prints.groupBy(F.col(f"`{fp_col}`").alias("fp")).agg(F.min(f"`{id_col}`").alias("least")), "simhash-nodes").df
    found = components(links(nodes.select("fp"))).df.withColumnRenamed("node", "fp")
    labelled = nodes.join(found, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("label"))
    key = fresh(prints, "simhash_fp")
    least = Stored(labelled.groupBy("label").agg(F.min("least").alias("name")), "simhash-names").df
    named = labelled.join(least, "label").select(F.col("fp").alias(key), F.col("name").alias(out))
    return prints.join(named, F.col(f"`{fp_col}`") == F.col(key), "left").drop(key)
