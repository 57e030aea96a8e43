"""Clusters against a direct computation in exact integers."""

import hashlib
import math

import numpy as np
import pytest

from lodestone.llm import centroids as C

D = 64


def brute(rows, k, rounds):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == D and all(x is not None and math.isfinite(x) for x in v)]
    starts = sorted(((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None))[:k]
    c = [v for _, v in starts]
    x = np.array([v for _, v in kept], object).reshape(-1, D)

    def near():
        far = [((x - np.array(one, object)) ** 2).sum(axis=1) for one in c]
        return [min((int(far[j][n]), j) for j in range(len(c))) for n in range(len(kept))]

    for _ in range(rounds):
        own = near()
        for j in range(len(c)):
            members = [v for (_, v), (_, at) in zip(kept, own, strict=True) if at == j]
            if members:
                c[j] = [sum(col) // len(members) for col in zip(*members, strict=True)]
    own = near()
    total = {j: sum(d for d, at in own if at == j) for j in range(len(c))}
    return [(i, j, d, total[j], sum(total.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, own, strict=True)]


def check(spark, rows, k=7, rounds=3):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster string").repartition(3)
    got = C.clusters(df, k, rounds)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    got = list(map(tuple, got.collect()))
    assert sorted(map(repr, got)) == sorted(map(repr, brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], k, rounds)))
    return got


def test_groups_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, D))
    rows = [(k, (centres[k % 5] + rng.normal(scale=0.02, size=D)).tolist()) for k in range(400)]
    rows += [(1000 + k, [round(x) / 2 for x in rng.integers(-1, 2, D)]) for k in range(60)]  # far ones, with ties
    rows += [(k, rows[5][1]) for k in range(2000, 2100)] + [(7, rows[9][1]), (None, rows[3][1]), (None, [0.0] * D)]
    rows += [(3000, None), (3001, []), (3002, [1.0] * 63), (3003, [float("nan")] * D), (3004, [None] + [1.0] * 63), (3005, [float("inf")] * D), (3006, [-0.001] * D)]
    assert len({r[1] for r in check(spark, rows)}) > 3


def test_fewer_vectors_than_clusters_and_none(spark):
    check(spark, [(1, [0.5] * D), (2, [0.25] * D)])
    check(spark, [(1, [1.0] * 3), (None, [0.5] * D)][:1])
    assert C.clusters(spark.createDataFrame([], "vec_id long, embedding array<float>"), 4, 2).count() == 0


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(4)
    check(spark, [(k, (rng.normal(size=D) * 100_000).tolist()) for k in range(90)])
    with pytest.raises(Exception, match="64-bit"):
        C.clusters(spark.createDataFrame([(1, [1e6] * D)], "vec_id long, embedding array<float>"), 4, 2).count()


@pytest.mark.parametrize("scale", [1, 2**15])
def test_trees_prune_without_loss(scale):
    """Grouped points are mostly taken by whole nodes; every assignment is the least number of the nearest centroids."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-2000, 2000, (6, 8))
    points = (np.repeat(centres, 700, axis=0) + rng.integers(-9, 10, (4200, 8))) * scale
    tree, order = C.Tree.build(points)
    tree = C.Tree.unpacked(tree.packed(), 8)
    assert (tree.points == points[order]).all() and sorted(order) == list(range(4200))
    near = np.concatenate([centres, centres[:2], rng.integers(-3000, 3000, (4, 8))]) * scale  # two of them twice
    own = C.nearest(tree, near)
    far = ((tree.points[:, None, :].astype(object) - near[None].astype(object)) ** 2).sum(axis=2)
    assert (own == [min(range(len(near)), key=lambda j: (row[j], j)) for row in far]).all()
    n, total = C.sums(tree, near)
    assert n.sum() == 4200 and all((total[j] == tree.points[own == j].sum(axis=0)).all() for j in range(len(near)))
    alone = []
    C.filtered(tree, near[:6], lambda node, k: alone.append(np.diff(tree.span[node])[0]), lambda places, ks: None)
    assert sum(alone) > 3000
