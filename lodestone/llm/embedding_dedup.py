"""Near-duplicate embeddings: balanced binary codes by iterative quantisation, multi-index Hamming tables, reranking with the vectors.

Equal vectors are one class with a count. Codes come from rotations learned on a bounded sample (Gong and Lazebnik, "Iterative Quantization",
2011): principal directions, turned until their signs lie close to them, with a threshold at each bit's median. The code is cut into
substrings, one a table; vectors that agree in one of them meet in its bucket. How many tables that takes is found on the sample, for
pairs exactly at the threshold. In a bucket codes are compared first; only vectors with a partner near by Hamming distance are fetched, and
all pairs of those are held against the threshold in double precision. A pair counts in the first table in which it agrees.

A large bucket is split into blocks, every two of which meet in a task of their own, so no task grows with the data. Pairs never leave a task:
it returns, for every vector, the links it found and the least vector they lead to.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from lodestone.llm.components import components
from lodestone.llm.hot import join_keyed
from lodestone.llm.store import Stored

#: Cosine of a link; share of the pairs at that cosine that the tables should find.
COSINE, RECALL = 0.9, 0.99
#: Numbers in the sample that codes are learned from, at most, and its rows.
SAMPLE_NUMBERS, SAMPLE_ROWS = 2**20, 8192
#: Vectors a bucket should hold on average and a block at most; bytes of a code that travel with every table's row; bits of a rotation.
BUCKET, BLOCK, HEAD, BITS = 256, 1024, 32, 64
MOST_TABLES, MOST_DIMENSIONS, TURNS = 400, 4096, 20
#: Split buckets that are still broadcast (a row each).
BROADCAST_BUCKETS = 50_000


class Codes:
    """Rotations learned from a sample, and how their bits are dealt to tables."""

    def __init__(self, sample: np.ndarray, n: int):
        """``sample``: unit vectors, a row each; ``n``: vectors to be indexed."""
        self.mean = sample.mean(axis=0)
        held = sample - self.mean
        self.basis = np.linalg.eigh(held.T @ held)[1][:, ::-1][:, :BITS]
        self.low = held @ self.basis
        self.rng = np.random.default_rng(7)
        self.turns, self.cuts = [], []
        at, near = self._edge_pairs(sample)
        self.bits = max(0, math.ceil(math.log2(max(n, 1) / BUCKET)))
        while True:  # shorter substrings until few enough tables do; without bits all vectors meet
            self.tables = self._enough(at, near)
            if self.tables:
                break
            self.bits -= 1
        apart = np.bitwise_count(words(self.encode(at)[0]) ^ words(self.encode(near)[0])).sum(axis=1)
        self.radius = int(np.quantile(apart, 0.999)) if self.bits > 0 else 8 * HEAD

    def _edge_pairs(self, sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sampled vectors, each with one at exactly the threshold: half of them away in any direction, half towards other vectors."""
        at = sample[self.rng.integers(0, len(sample), 2000)]
        way = self.rng.normal(size=at.shape)
        way[::2] = sample[self.rng.integers(0, len(sample), 1000)] - sample[self.rng.integers(0, len(sample), 1000)] + way[::2] * 1e-9
        way -= (way * at).sum(axis=1, keepdims=True) * at
        norm = np.linalg.norm(way, axis=1, keepdims=True)
        way = np.divide(way, norm, out=np.zeros_like(way), where=norm > 0)
        return at, COSINE * at + math.sqrt(1 - COSINE**2) * way

    def _learn(self) -> None:
        """One more rotation: signs are the nearest corners of a cube, and the rotation brings the vectors nearest to their corners."""
        d = self.basis.shape[1]
        turn = np.linalg.qr(self.rng.normal(size=(d, d)))[0]
        for _ in range(TURNS):
            corner = np.where(self.low @ turn >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(self.low.T @ corner)
            turn = left @ right
        self.turns.append(turn)
        self.cuts.append(np.median(self.low @ turn, axis=0))

    def _bits(self, unit: np.ndarray, count: int) -> np.ndarray:
        while sum(t.shape[1] for t in self.turns) < count:
            self._learn()
        low = (unit - self.mean) @ self.basis
        return np.hstack([low @ t >= c for t, c in zip(self.turns, self.cuts, strict=True)])[:, :count]

    def _enough(self, at: np.ndarray, near: np.ndarray) -> int:
        """The fewest tables that find the wanted share of both kinds of pairs; 0 if too many would be needed."""
        if self.bits <= 0:
            return 1
        missed, step = np.ones(len(at), bool), 8
        for t in range(MOST_TABLES):
            if t % step == 0:
                a, b = (self._bits(x, (t + step) * self.bits) for x in (at, near))
            own = slice(t * self.bits, (t + 1) * self.bits)
            missed &= (a[:, own] != b[:, own]).any(axis=1)
            if max(missed[::2].mean(), missed[1::2].mean()) <= 1 - RECALL:
                return t + 1
        return 0

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes as bytes, HEAD of them at least, and every table's key."""
        code = np.packbits(self._bits(unit, max(self.tables * max(self.bits, 0), 8 * HEAD)), axis=1, bitorder="little")
        return code, self.table_keys(code, self.tables)

    def table_keys(self, code: np.ndarray, tables: int) -> np.ndarray:
        """The keys of the first tables, from codes as bytes."""
        width = max(self.bits, 0)
        bits = np.unpackbits(code, axis=1, bitorder="little")[:, : tables * width]
        return bits.reshape(len(code), tables, width) @ (1 << np.arange(width, dtype=np.int64))

    def whole_tables(self) -> int:
        """Tables whose bits are all in a code's head."""
        return self.tables if self.bits <= 0 else min(self.tables, 8 * HEAD // self.bits)


def words(code: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(code[:, :HEAD]).view(np.uint64)


def _matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of doubles, filled up with zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims))
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(k) for k in sizes])] = flat
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Scaled by the largest component first, so no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _bytes(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def linkable(v: Column) -> Column:
    """Whether a vector has a direction: not null nor empty, all components finite, one of them not zero."""
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def coded(classes: DataFrame, codes: Codes, dims: int) -> DataFrame:
    """``classes`` with ``code`` and the tables' ``keys``."""
    schema = StructType([*classes.schema.fields, StructField("code", BinaryType()), StructField("keys", ArrayType(LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, keys = codes.encode(_unit(_matrix(b.column("v"), dims))) if b.num_rows else (np.empty((0, HEAD), np.uint8), np.empty((0, 1), np.int64))
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in code], pa.binary()), listed], names=schema.names)

    return classes.mapInArrow(run, schema)


def buckets(held: DataFrame) -> DataFrame:
    """A row for every class, table and pair of blocks in which it may meet others: ``t, key, i, j``, its ``own`` block, the code's head."""
    rows = held.select("node", F.size("v").alias("size"), F.substring("code", 1, HEAD).alias("head"), F.posexplode("keys").alias("t", "key"))
    sizes = rows.groupBy("t", "key", "size").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = Stored(sizes.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n"), "embedding-buckets").df
    whole, split = sizes.filter("blocks = 1").drop("blocks"), sizes.filter("blocks > 1")
    split = F.broadcast(split) if split.count() <= BROADCAST_BUCKETS else split
    place = ["t", "key", "size"]
    one = rows.join(whole, place, "left_semi").select(*place, F.lit(0).alias("i"), F.lit(0).alias("j"), "node", F.lit(0).alias("own"), "head")
    own = rows.join(split, place).withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return one.union(met.select(*place, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "own", "head"))


PLACE = ("t", "key", "size", "i", "j")


def _apart(own: np.ndarray, i: int, j: int) -> np.ndarray | None:
    """Of a meeting of two blocks only pairs across count."""
    return None if i == j else own[:, None] != own[None]


def _new(keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs those that agree in none of the tables of ``keys``."""
    out = np.ones(len(a), bool)
    for t in range(keys.shape[1]):
        out &= keys[a, t] != keys[b, t]
    return out


def candidates(met: DataFrame, codes: Codes) -> DataFrame:
    """Rows of :func:`buckets` that have a partner there within the codes' radius that no earlier table shows."""
    schema = met.drop("head").schema

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        t, i, j = (key[k].as_py() for k in (0, 3, 4))
        code, own = _bytes(rows["head"]), rows["own"].to_numpy()
        head, earlier = words(code), codes.table_keys(code, min(t, codes.whole_tables()))
        hit, across = np.zeros(len(head), bool), _apart(own, i, j)
        for start in range(0, len(head), 128):
            part = slice(start, start + 128)
            near = np.bitwise_count(head[part, None] ^ head[None]).sum(axis=2, dtype=np.int64) <= codes.radius
            if across is not None:
                near &= across[part]
            a, b = np.nonzero(near)
            a = a + start
            keep = a < b
            a, b = a[keep], b[keep]
            new = _new(earlier, a, b)
            hit[a[new]] = hit[b[new]] = True
        return rows.filter(pa.array(hit)).drop_columns(["head"])

    return met.groupBy(*PLACE).applyInArrow(run, schema)


def verified(found: DataFrame, held: DataFrame, codes: Codes) -> DataFrame:
    """``node, links, least``: how many vectors (copies counted) a class links with in a bucket, and the least class its links lead to there."""
    schema = StructType([StructField(c, LongType()) for c in ("node", "links", "least")])

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        t, size, i, j = (key[k].as_py() for k in (0, 2, 3, 4))
        x = _matrix(pa.concat_arrays(rows["v"].chunks), size)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        norm = np.sqrt((x * x).sum(axis=1))
        linked = x @ x.T >= COSINE * norm[:, None] * norm[None]
        np.fill_diagonal(linked, False)
        if (across := _apart(rows["own"].to_numpy(), i, j)) is not None:
            linked &= across
        a, b = np.nonzero(linked)
        old = ~_new(codes.table_keys(_bytes(rows["code"]), t), a, b)
        linked[a[old], b[old]] = False
        node, copies = rows["node"].to_numpy(), rows["copies"].to_numpy()
        order = node.argsort()
        label = np.empty(len(node), np.int64)
        label[order] = np.arange(len(node))
        while True:  # the least label within reach
            less = np.minimum(label, np.where(linked, label[None], len(node)).min(axis=1))
            less = np.minimum(less, less[order[less]])
            if (less == label).all():
                break
            label = less
        links = linked @ copies
        some = links > 0
        return pa.table({"node": node[some], "links": links[some].astype(np.int64), "least": node[order[label]][some]}, schema=pa.schema([(c, pa.int64()) for c in schema.names]))

    rows = found.join(held.select("node", "v", "copies", "code"), "node").select(*PLACE, "own", "node", "v", "copies", "code")
    return rows.groupBy(*PLACE).applyInArrow(run, schema)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: its id, ``n_links`` (other rows linked directly), ``component_id`` (least id within reach) and ``kept``
    (whether that is its own).

    Null, empty and zero vectors and those with a null or not finite component link with nothing, nor do vectors of different lengths. Rows
    with equal vectors link, whatever their ids. A null id names no component: alone it has null and is kept. An empty table stays empty.
    Vectors of over 4,096 components are an error.
    """
    id_, v = F.col(f"`{id_col}`"), F.col(f"`{vector_col}`")
    rows = vectors.select(id_.alias("id"), v.alias("v"))
    able = linkable(F.col("v"))
    classes = rows.filter(able).groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    classes = Stored(classes.withColumn("node", F.monotonically_increasing_id()), "embedding-classes").df
    n, total, dims = classes.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if dims > MOST_DIMENSIONS:
        raise ValueError(f"a vector has {dims} components; codes are learned for up to {MOST_DIMENSIONS}")
    alone = rows.filter(~able).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if n:
        sample = classes.orderBy(F.xxhash64("v"), "v").limit(min(SAMPLE_ROWS, SAMPLE_NUMBERS // dims)).select("v").toArrow()["v"]
        codes = Codes(_unit(_matrix(pa.concat_arrays(sample.chunks), dims)), n)
        held = Stored(coded(classes, codes, dims), "embedding-codes").df
        found = Stored(candidates(buckets(held), codes), "embedding-candidates").df
        links = Stored(verified(found, held, codes), "embedding-links").df
        graph = components(links.filter("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))).df
        counted = links.groupBy("node").agg(F.sum("links").alias("links"))
        labelled = held.select("node", "v", "least", "copies").join(counted, "node", "left").join(graph, "node", "left")
        labelled = Stored(labelled.select("v", "copies", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("label")), "embedding-labels").df
        names = Stored(labelled.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("members")), "embedding-names").df
        named = join_keyed(labelled, names, "label", "members", n).select("v", "copies", "n_links", "component_id")
        named = Stored(named, "embedding-named").df
        alone = alone.union(join_keyed(rows.filter(able), named, "v", "copies", total).select("id", "n_links", "component_id"))
    return alone.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


#: op12 by comparing all pairs.
ORACLE = f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding AS v FROM embeddings),
u AS MATERIALIZED (SELECT r, list_transform(v, lambda x: x::DOUBLE) AS v, sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM e
    WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NOT NULL AND isfinite(x))) = len(v) AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.r AS x, b.r AS y FROM u a, u b WHERE a.r <> b.r AND CASE WHEN len(a.v) = len(b.v) THEN list_dot_product(a.v, b.v) / (a.norm * b.norm) ELSE -1 END >= {COSINE}),
reach(x, y) AS (SELECT r, r FROM e UNION SELECT reach.x, l.y FROM reach JOIN l ON l.x = reach.y),
c AS (SELECT x, min(vec_id) AS component_id FROM reach JOIN e ON r = y GROUP BY x),
k AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM e JOIN c ON c.x = r LEFT JOIN k ON k.x = r
"""
