"""Matrices as coordinate rows (i, j, v), one a cell."""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of a block of rows, columns of a tile, and tiles that are added up in one go.
BLOCK_CELLS, TILE, FAN_IN = 2**20, 128, 64


def _cellwise(a: DataFrame, b: DataFrame, sign: int) -> DataFrame:
    """Cells that one side lacks count as 0."""
    y = b.select("i", "j", F.col("v").alias("w"))
    return a.join(y, ["i", "j"], "full").select("i", "j", (F.coalesce("v", F.lit(0.0)) + sign * F.coalesce("w", F.lit(0.0))).alias("v"))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return _cellwise(a, b, 1)


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return _cellwise(a, b, -1)


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def gram(a: DataFrame) -> DataFrame:
    """A transposed times A: rows meet on their row number, sums are combined before the shuffle."""
    x, y = a.select("i", F.col("j").alias("p"), F.col("v").alias("x")), a.select("i", F.col("j").alias("q"), F.col("v").alias("y"))
    return x.join(y, "i").groupBy("p", "q").agg(F.sum(F.col("x") * F.col("y")).alias("v")).select(F.col("p").alias("i"), F.col("q").alias("j"), "v")


_TILES = "p long, q long, step long, value array<double>, seen array<boolean>"


def _tiles(rows: list[tuple]) -> pa.Table:
    names, kinds = ("p", "q", "step", "value", "seen"), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.bool_()))
    return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def _block_products(key: tuple, cells: pa.Table) -> pa.Table:
    """The products of every two tiles of columns of one block of rows, as dense arrays; empty tiles have none."""
    i, j, v = (cells[c].to_numpy() for c in "ijv")
    which, tile = np.unique(j // TILE, return_inverse=True)
    line = np.unique(i, return_inverse=True)[1]
    dense, there = np.zeros((line.max() + 1, len(which) * TILE)), np.zeros((line.max() + 1, len(which) * TILE), np.float32)
    at = (line, tile * TILE + j % TILE)
    np.add.at(dense, at, v)
    there[at] = 1
    part = [slice(k * TILE, (k + 1) * TILE) for k in range(len(which))]
    pairs = combinations_with_replacement(range(len(which)), 2)
    return _tiles([(which[a], which[b], key[0].as_py() // FAN_IN, (dense[:, part[a]].T @ dense[:, part[b]]).ravel(), (there[:, part[a]].T @ there[:, part[b]]).ravel() > 0) for a, b in pairs])


def _added(key: tuple, tiles: pa.Table) -> pa.Table:
    value, seen = (pa.concat_arrays(tiles[c].chunks).flatten().to_numpy(zero_copy_only=False).reshape(len(tiles), -1) for c in ("value", "seen"))
    return _tiles([(key[0].as_py(), key[1].as_py(), key[2].as_py() // FAN_IN, value.sum(axis=0), seen.any(axis=0))])


def gram_tiled(a: DataFrame) -> DataFrame:
    """As :func:`gram`, for wide matrices: a row of w cells costs its share of dense tiles, not w * w rows.

    Rows are taken in blocks of about a million cells; a block's tiles of columns are multiplied as dense arrays, half of them as the result
    is symmetric, and products of one place are added 64 at a time until one is left. What is shuffled is the cells once and a tile for every
    64 blocks and place, so no task holds more than a block or 64 tiles. Cells are those of columns that meet in some row.
    """
    last_i, last_j = a.agg(F.max("i"), F.max("j")).first()
    height = max(1, BLOCK_CELLS // ((last_j or 0) + 1))
    blocks = a.select(F.floor(F.col("i") / height).alias("block"), F.col("i").cast("long"), F.col("j").cast("long"), F.col("v").cast("double"))
    tiles, count = blocks.groupBy("block").applyInArrow(_block_products, _TILES), (last_i or 0) // height + 1
    while True:
        tiles = tiles.groupBy("p", "q", "step").applyInArrow(_added, _TILES)
        count = -(-count // FAN_IN)
        if count == 1:
            break
    cells = tiles.select("p", "q", F.posexplode(F.arrays_zip("value", "seen")).alias("at", "x")).filter("x.seen")
    cells = cells.select((F.col("p") * TILE + F.floor(F.col("at") / TILE)).alias("i"), (F.col("q") * TILE + F.col("at") % TILE).alias("j"), F.col("x.value").alias("v"), (F.col("p") < F.col("q")).alias("above"))
    both = F.when(F.col("above"), F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).otherwise(F.array(F.struct("i", "j")))
    return cells.select(F.explode(both).alias("ij"), "v").select("ij.i", "ij.j", "v")


def rows(a: DataFrame) -> DataFrame:
    return a.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda c: c["v"]).alias("row"))
