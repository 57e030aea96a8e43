"""Centroid clustering in exact integers, filtered through kd-trees.

Vectors are turned into integers once and stored as kd-trees, each over a few thousand vectors of one partition: a node holds its box, its
number of vectors and their sum. A round walks the trees level by level with the centroids that may be nearest: one that another beats
strictly in every point of a node's box is pruned for that node and all below; a node with one centroid left is taken whole, by its number
and sum; vectors of a leaf with more are compared with those left. What is pruned is never nearest and ties go to the smaller
number, so every round is exact. Sums are combined in each task, so a round shuffles and collects one row a centroid and task at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from lodestone.llm.store import Stored

#: Vectors of a tree and, at most, of a leaf (equal vectors are never parted).
TREE, LEAF = 4096, 32
#: Components times SCALE stay below LIMIT, so squared distances and bounds fit 64 bits; below EXACT they are exact as doubles.
SCALE, LIMIT, EXACT = 256, 2**27, 2**20


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector has so many components, none of them null or not finite."""
    return F.coalesce((F.size(vector) == dims) & F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))), F.lit(False))


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x)."""
    v = np.floor(SCALE * x.astype(np.float64))
    if v.size and np.abs(v).max() > LIMIT:
        raise ValueError(f"components beyond {LIMIT // SCALE} do not fit exact 64-bit distances")
    return v.astype(np.int64)


class Tree:
    """A kd-tree: ``points`` in its order; of every node the box, sum, range of points and children (-1: a leaf). Children follow their node."""

    FIELDS = ("points", "low", "high", "total", "span", "child")

    def __init__(self, points, low, high, total, span, child):
        self.points, self.low, self.high, self.total, self.span, self.child = points, low, high, total, span, child

    @classmethod
    def build(cls, points: np.ndarray) -> tuple[Tree, np.ndarray]:
        """The tree of at least one point, and the points' order in it."""
        order, span, child, low, high, total = np.arange(len(points)), [[0, len(points)]], [], [], [], []
        for k in range(2 * len(points)):
            if k == len(span):
                break
            start, stop = span[k]
            own = points[order[start:stop]]
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            total.append(own.sum(axis=0))
            wide = high[-1] - low[-1]
            if stop - start <= LEAF or not wide.any():
                child.append(-1)
                continue
            half = (stop - start) // 2
            order[start:stop] = order[start:stop][np.argpartition(own[:, wide.argmax()], half)]
            child.append(len(span))
            span += [[start, start + half], [start + half, stop]]
        return cls(points[order], np.array(low), np.array(high), np.array(total), np.array(span), np.array(child)), order

    def packed(self) -> list[bytes]:
        small = next(t for t in (np.int16, np.int32, np.int64) if np.abs(self.points).max() <= np.iinfo(t).max)
        kinds = (small, small, small, np.int64, np.int32, np.int32)
        return [np.dtype(kind).char.encode() + np.ascontiguousarray(getattr(self, f), kind).tobytes() for f, kind in zip(self.FIELDS, kinds, strict=True)]

    @classmethod
    def unpacked(cls, held: list[bytes], dims: int) -> Tree:
        raw = [np.frombuffer(x, np.dtype(x[:1].decode()), offset=1) for x in held]
        widths = (dims, dims, dims, dims, 2, 1)
        return cls(*[(r.reshape(-1, w) if w > 1 else r).astype(np.int64) for r, w in zip(raw, widths, strict=True)])


def filtered(tree: Tree, centroids: np.ndarray, whole: Callable, each: Callable) -> None:
    """Assigns every point to its nearest centroid: ``whole(node, centroid)`` for whole nodes, ``each(places, centroids)`` for the points of leaves."""
    exact = max(np.abs(tree.low).max(), np.abs(tree.high).max(), np.abs(centroids).max()) < EXACT
    kind = np.float64 if exact else np.int64  # sums of products that are whole numbers, either way
    low, high, c = (x.astype(kind) for x in (tree.low, tree.high, centroids))
    norm = (c * c).sum(axis=1)
    nodes, left = np.zeros(1, np.int64), np.ones((1, len(c)), bool)
    never = np.inf if exact else np.iinfo(np.int64).max
    while len(nodes):
        middle = np.where(left, norm - (low[nodes] + high[nodes]) @ c.T, never).argmin(axis=1)
        for best in np.unique(middle):
            at = np.flatnonzero(middle == best)
            way = c - c[best]
            reach = high[nodes[at]] @ np.maximum(way, 0).T + low[nodes[at]] @ np.minimum(way, 0).T
            left[at] &= norm - norm[best] - 2 * reach <= 0  # else farther than the best one in the whole box
        single = left.sum(axis=1) == 1
        for node, centroid in zip(nodes[single], left[single].argmax(axis=1), strict=True):
            whole(node, centroid)
        leaf = ~single & (tree.child[nodes] < 0)
        if leaf.any():
            spans = tree.span[nodes[leaf]]
            sizes = spans[:, 1] - spans[:, 0]
            places = np.arange(sizes.sum()) + np.repeat(spans[:, 0] - (sizes.cumsum() - sizes), sizes)
            far = norm - 2 * (tree.points[places].astype(kind) @ c.T)
            each(places, np.where(np.repeat(left[leaf], sizes, axis=0), far, never).argmin(axis=1))
        down = ~single & ~leaf
        nodes, left = np.repeat(tree.child[nodes[down]], 2), np.repeat(left[down], 2, axis=0)
        nodes[1::2] += 1


def sums(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many points go to each centroid, and their sum."""
    n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)

    def whole(node, k):
        n[k] += tree.span[node, 1] - tree.span[node, 0]
        total[k] += tree.total[node]

    def each(places, ks):
        order = ks.argsort(kind="stable")
        first = np.flatnonzero(np.diff(ks[order], prepend=-1))
        which = ks[order][first]
        n[which] += np.diff(first, append=len(ks))
        total[which] += np.add.reduceat(tree.points[places[order]], first, axis=0)

    filtered(tree, centroids, whole, each)
    return n, total


def nearest(tree: Tree, centroids: np.ndarray) -> np.ndarray:
    """The centroid of every point, in the tree's order."""
    out = np.empty(len(tree.points), np.int64)

    def whole(node, k):
        out[tree.span[node, 0] : tree.span[node, 1]] = k

    def each(places, ks):
        out[places] = ks

    filtered(tree, centroids, whole, each)
    return out


def forest(vectors: DataFrame, id_col: str, vector_col: str, dims: int) -> Stored:
    """The usable vectors as stored trees, a row each: ``ids`` in the tree's order, and the tree."""
    held = vectors.filter(usable(F.col(f"`{vector_col}`"), dims)).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    schema = StructType([StructField("ids", ArrayType(held.schema["id"].dataType)), *[StructField(f, BinaryType()) for f in Tree.FIELDS]])

    def row(rows: pa.Table, ids_type: pa.DataType) -> pa.RecordBatch:
        flat = pa.concat_arrays(rows["v"].chunks).flatten().to_numpy(zero_copy_only=False)
        tree, order = Tree.build(integers(flat.reshape(-1, dims)))
        ids = pa.concat_arrays(rows["id"].chunks).take(pa.array(order))
        held_ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays([held_ids, *[pa.array([x], pa.binary()) for x in tree.packed()]], names=schema.names)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in batches:
            rest = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            while rest.num_rows >= TREE:
                yield row(rest.slice(0, TREE), rest.schema.field("id").type)
                rest = rest.slice(TREE)
        if rest is not None and rest.num_rows:
            yield row(rest, rest.schema.field("id").type)

    return Stored(held.mapInArrow(build, schema), "centroid-trees")


def _trees(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, Tree]]:
    for b in batches:
        for k in range(b.num_rows):
            yield b.column("ids")[k].values, Tree.unpacked([b.column(f)[k].as_py() for f in Tree.FIELDS], dims)


def improved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floor of each mean; one without vectors stays."""
    k, dims = centroids.shape
    columns = [f"s{j}" for j in range(dims)]
    schema = StructType([StructField("cluster", IntegerType()), *[StructField(c, LongType()) for c in ("n", *columns)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, tree in _trees(batches, dims):
            more = sums(tree, centroids)
            n, total = n + more[0], total + more[1]
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(n[own]), *[pa.array(total[own, j]) for j in range(dims)]], names=schema.names)

    added = trees.mapInArrow(run, schema).groupBy("cluster").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", *columns)])
    out = centroids.copy()
    for r in added.collect():  # a row a centroid
        out[r["cluster"]] = [int(r[c]) // int(r["n"]) for c in columns]
    return out


def clusters(vectors: DataFrame, k: int, rounds: int, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, seed: str = "2:") -> DataFrame:
    """One row per usable vector: its id, ``cluster``, squared ``distance``, that summed over its cluster and over all, and its centroid's digest.

    The first centroids are the vectors of the ``k`` least sha256 of seed and id, in that order, ties by components; fewer vectors make fewer
    centroids. A null id starts none but is clustered; rows of one id or with equal vectors count each; without usable vectors there are no
    rows. Components beyond 2**19 are an error.
    """
    v = F.col(f"`{vector_col}`")
    starts = vectors.filter(usable(v, dims) & F.col(f"`{id_col}`").isNotNull())
    starts = starts.orderBy(F.sha2(F.concat(F.lit(seed), F.col(f"`{id_col}`").cast("string")), 256), v).limit(k).select(v.alias("v")).collect()
    trees = forest(vectors, id_col, vector_col, dims).df
    out = StructType([StructField(id_col, vectors.schema[id_col].dataType), StructField("cluster", IntegerType()), StructField("distance", LongType())])
    if not starts:
        empty = vectors.sparkSession.createDataFrame([], out)
        return empty.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    centroids = integers(np.array([r["v"] for r in starts]))
    for _ in range(rounds):
        centroids = improved(trees, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tree in _trees(batches, dims):
            own = nearest(tree, centroids)
            way = tree.points - centroids[own]
            yield pa.RecordBatch.from_arrays([ids, pa.array(own, pa.int32()), pa.array((way * way).sum(axis=1))], names=out.names)

    found = Stored(trees.mapInArrow(run, out), "centroid-clusters").df
    parts = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    rows = [(c, d, sum(parts.values()), digest(centroids[c].tolist())) for c, d in parts.items()]
    each = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(each), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row a centroid


def oracle(k: int, rounds: int, dims: int = 64, seed: str = "2:") -> str:
    """SQL that compares every vector with every centroid."""
    near = "SELECT rid, first(k ORDER BY d, k) AS k, min(d) AS d FROM (SELECT rid, k, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept, c{r}) GROUP BY rid"
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, embedding, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}' || vec_id), embedding) - 1 AS k, v AS c FROM kept WHERE vec_id IS NOT NULL ORDER BY k LIMIT {k})",
    ]
    for r in range(rounds):
        steps += [
            f"a{r} AS MATERIALIZED ({near.format(r=r)})",
            f"m{r} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM (SELECT k, j, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, unnest(range({dims})) AS j FROM a{r} JOIN kept USING (rid)) GROUP BY k, j) GROUP BY k)",
            f"c{r + 1} AS MATERIALIZED (SELECT o.k, coalesce(m.c, o.c)::BIGINT[] AS c FROM c{r} o LEFT JOIN m{r} m USING (k))",
        ]
    steps.append(f"a{rounds} AS MATERIALIZED ({near.format(r=rounds)})")
    return f"WITH {', '.join(steps)} SELECT vec_id, k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM kept JOIN a{rounds} USING (rid) JOIN c{rounds} USING (k)"
