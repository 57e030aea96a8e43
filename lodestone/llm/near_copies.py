"""Near copies by word shingles: candidates by SimHash and min-hash, verified on whole shingle sets.

Two texts are near copies if the sets of their five-word shingles have Jaccard similarity 0.8 or more. Close copies are found
as SimHash near-dedup finds them (see :mod:`simhash`): fingerprints, of the sets here, of few different bits, through pivot distances. No number of
bits follows from a similarity of 0.8 (texts of few shingles differ in many), so that is not all: candidates are also texts
that share one of ``BANDS`` min-hash bands; of a pair at 0.8 one in 2,500 shares none, of closer pairs far fewer. Candidates
are discarded by set sizes only, which the similarity implies, and the others are verified on their whole shingle sets.

A bucket of up to ``BUCKET`` texts is paired; in a larger one every text first meets the bucket's leader, which the bucket's own
hash picks. That ties most groups of many copies together in linear time. Large buckets whose members are not all tied by then
are searched whole: they are cut into blocks, every two blocks meet, and there a search from member to member over their
shingle sets finds every further link between members not yet tied.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import simhash
from lodestone.llm.components import components
from lodestone.llm.simhash import BUCKET, shingle_hashes
from lodestone.llm.store import Stored, fresh

WIDTH, BANDS, ROWS = 5, 20, 5
_RNG = np.random.default_rng(6)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
#: Texts and shingles of a large bucket that make a block.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 19
PROFILE = "struct<n: int, k1: long, k2: long, fp: long, bands: array<long>>"


def band_keys(shingles: np.ndarray) -> list[int]:
    """A key per band from the least values of its hash functions; none for no shingles."""
    if not len(shingles):
        return []
    least = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for lo in range(0, len(shingles), 2048):
        np.minimum(least, (_TIMES[:, None] * shingles[None, lo : lo + 2048] + _PLUS[:, None]).min(axis=1), out=least)
    keys = np.array([xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)], np.uint64)
    return keys.view(np.int64).tolist()


def profile(text: str | None) -> dict:
    """Number of different shingles, 128 bits of their set, its SimHash fingerprint, band keys."""
    own = np.unique(shingle_hashes(text, WIDTH))
    k1, k2, fp = np.array([*(xxhash.xxh64_intdigest(own.tobytes(), s) for s in (1, 2)), simhash.majority(own)], np.uint64).view(np.int64).tolist()
    return {"n": len(own), "k1": k1, "k2": k2, "fp": fp, "bands": band_keys(own)}


def with_profile(docs: DataFrame, text_col: str, out: str) -> DataFrame:
    place, names = docs.columns.index(text_col), docs.columns
    kind = pa.struct([("n", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64()))])
    source = docs.toDF(*[f"c{k}" for k in range(len(names))])  # Arrow functions take no names with dots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([profile(t) for t in b.column(place).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*b.schema.names, "profile"])

    return source.mapInArrow(run, source.select("*", F.lit(None).cast(PROFILE).alias("profile")).schema).toDF(*names, out)


def buckets(nodes: DataFrame) -> DataFrame:
    """``nodes`` (node, n, bands), a row per band shared with others: key, number of texts and shingles, leader's hash."""
    keyed = nodes.select("node", "n", F.explode("bands").alias("key"))
    of = keyed.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("total"), F.min(F.xxhash64("node", "key")).alias("lead"))
    return Stored(keyed.join(of.filter("m > 1"), "key"), "near-buckets").df


def candidates(shared: DataFrame) -> DataFrame:
    """Pairs (u < v) in ``shared`` buckets of sizes that allow the similarity: all pairs of small buckets, those with the
    leader of large ones."""
    a, b = shared.alias("a"), shared.alias("b")
    lead = F.xxhash64("a.node", "a.key") == F.col("a.lead")
    many = (F.col("a.m") > BUCKET) & lead & (F.col("a.node") != F.col("b.node"))
    few = (F.col("a.m") <= BUCKET) & (F.col("a.node") < F.col("b.node"))
    alike = F.least("a.n", "b.n") * 5 >= F.greatest("a.n", "b.n") * 4
    same = F.col("a.key") == F.col("b.key")
    made = [a.filter(side).join(b, same & pick & alike) for side, pick in ((F.col("a.m") <= BUCKET, few), ((F.col("a.m") > BUCKET) & lead, many))]
    ends = (F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v"))
    return made[0].select(*ends).union(made[1].select(*ends)).distinct()


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(node, text) -> (node, shingles): the different shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t, WIDTH)).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return texts.mapInArrow(run, "node long, shingles array<long>")


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) whose texts, rows (node, text), have similarity 0.8 or more."""
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    sets = Stored(shingle_sets(texts.join(wanted, "node", "left_semi").select("node", "text")), "near-sets").df
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    return both.filter(shared * 9 >= (F.size("a") + F.size("b")) * 4).select("u", "v")


def spanning(label: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of similar members that, with the pairs of one label, connect whatever similar members connect.

    Member k has label ``label[k]`` and the next ``sizes[k]`` shingles of ``flat``. Every member reached is held against all
    that are not, by counting along the lists of members of its shingles.
    """
    m = len(sizes)
    owner = np.repeat(np.arange(m), sizes)
    _, word = np.unique(flat, return_inverse=True)
    common = np.bincount(word)[word] > 1
    word, owner = word[common], owner[common]
    ends = np.cumsum(np.bincount(owner, minlength=m))
    count = np.bincount(word)
    start = np.cumsum(count) - count
    who = owner[np.argsort(word, kind="stable")]
    _, group = np.unique(label, return_inverse=True)
    members = np.split(np.argsort(group, kind="stable"), np.cumsum(np.bincount(group))[:-1])
    left, out = np.ones(m, bool), []
    for own in members:
        if not left[own[0]]:
            continue
        left[own] = False
        reached = own.tolist()
        while reached and left.any():
            x = reached.pop()
            w = word[ends[x - 1] if x else 0 : ends[x]]
            at = np.arange(count[w].sum()) + np.repeat(start[w] - np.cumsum(count[w]) + count[w], count[w])
            shared = np.bincount(who[at], minlength=m)
            near = np.flatnonzero(left & (shared * 9 >= (sizes[x] + sizes) * 4))
            for g, k in zip(*np.unique(group[near], return_index=True), strict=True):
                out.append((x, int(near[k])))
                left[members[g]] = False
                reached += members[g].tolist()
    return out


def tie(t: pa.Table) -> pa.Table:
    node, sets = t.column("node").to_numpy(), t.column("shingles").combine_chunks()
    sizes = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.array(spanning(t.column("label").to_numpy(), sizes, sets.flatten().to_numpy()), np.int64).reshape(-1, 2)
    return pa.table({"u": node[ends[:, 0]], "v": node[ends[:, 1]]})


def large_links(shared: DataFrame, merged: DataFrame, texts: DataFrame) -> DataFrame | None:
    """Links (u, v) still missing between members of large ``shared`` buckets that ``merged`` (node, component) does not tie;
    none if all are tied. A task gets two blocks at a time, whatever the size of the bucket."""
    label = F.coalesce("component", "node")
    large = shared.filter(F.col("m") > BUCKET).join(merged, "node", "left").select("key", "node", "m", "total", label.alias("label"))
    apart = large.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    large = Stored(large.join(apart, "key", "left_semi"), "near-large").df
    if large.isEmpty():
        return None
    sets = Stored(shingle_sets(texts.join(large.select("node").distinct(), "node", "left_semi").select("node", "text")), "near-large-sets").df
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    dealt = large.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("blocks = 1 OR own <> other")
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "label")
    return dealt.join(sets, "node").groupBy("key", "i", "j").applyInArrow(tie, "u long, v long")


def drop_copies(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near copies, columns unchanged.

    Texts with equal shingle sets are one node. Texts without words (null included) form one group; a text of fewer than
    five words is one shingle, so only its equals are its copies. Of a group the row that comes first in the input stays,
    so rows with equal or null ids are told apart; an empty table stays empty.
    """
    row, at = fresh(docs, "near_row"), fresh(docs, "near_profile")
    held = Stored(with_profile(docs.withColumn(row, F.monotonically_increasing_id()), text_col, at), "near-docs").df
    p = lambda c: F.col(f"{at}.{c}")
    least = held.groupBy(p("k1"), p("k2")).agg(F.min(F.struct(F.col(row).alias("node"), p("n").alias("n"), p("fp").alias("fp"), p("bands").alias("bands"))).alias("x"))
    nodes = Stored(least.select("x.*"), "near-nodes").df
    shared, texts = buckets(nodes), held.select(F.col(row).alias("node"), F.col(f"`{text_col}`").alias("text"))
    alike = Stored(simhash.bucketed(nodes.filter("n > 0").select("node", "fp", F.col("n").alias("shingles"))), "near-prints").df
    close = simhash.close_pairs(alike.filter(F.col("n") <= BUCKET))
    pairs = Stored(candidates(shared).union(close).distinct(), "near-pairs").df
    merged = components(similar(pairs, texts)).df
    crowded = alike.filter(F.col("n") > BUCKET)
    totals = crowded.groupBy("which", "key").agg(F.sum("shingles").alias("total"))
    crowded = crowded.join(totals, ["which", "key"]).select(F.xxhash64(F.lit("bits"), "which", "key").alias("key"), "node", F.col("n").alias("m"), "total")
    more = large_links(shared.select("key", "node", "m", "total").union(crowded), merged, texts)
    if more is not None:
        merged = components(merged.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more)).df
    first = nodes.join(merged, "node", "left_anti").select(F.col("node").alias(row))
    return held.join(first, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
