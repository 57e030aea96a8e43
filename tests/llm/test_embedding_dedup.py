"""Near-duplicate embeddings against all pairs."""

import math

import duckdb
import numpy as np
import pytest

from lodestone.llm import embedding_dedup as X

DDL = "vec_id long, embedding array<float>, n_links string"


def brute(rows):
    """Per row: links, least id within reach."""
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, _ in rows]
    x = [np.array(np.float32(v), float) if good else None for (_, v, _), good in zip(rows, ok, strict=True)]
    x = [None if v is None else v / np.linalg.norm(v) for v in x]
    linked = [[j for j in range(len(rows)) if j != i and ok[i] and ok[j] and len(x[i]) == len(x[j]) and x[i] @ x[j] >= 0.9] for i in range(len(rows))]
    seen, out = {}, []
    for i in range(len(rows)):
        if i not in seen:
            todo, group = [i], {i}
            while todo:
                for j in linked[todo.pop()]:
                    if j not in group:
                        group.add(j)
                        todo.append(j)
            least = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
            seen |= dict.fromkeys(group, least)
        out.append((rows[i][0], len(linked[i]), seen[i], rows[i][0] == seen[i]))
    return out


def key(rs):
    return sorted(map(repr, map(tuple, rs)))


def near(rng, v, cosine):
    way = rng.normal(size=len(v))
    way -= way @ v / (v @ v) * v
    return cosine * v / np.linalg.norm(v) + math.sqrt(1 - cosine**2) * way / np.linalg.norm(way)


def odd_rows():
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=16).tolist(), "x") for k in range(60)]
    rows += [(100 + k, near(rng, np.array(rows[k % 7][1]), rng.uniform(0.93, 0.99)).tolist(), "x") for k in range(40)]
    rows += [(200 + k, rows[3][1], "x") for k in range(30)] + [(5, rows[8][1], "x"), (None, rows[9][1], "x"), (None, [9.0] + [0.0] * 15, "x")]
    rows += [(300, (np.array(rows[2][1]) * 1e-30).tolist(), "x"), (301, (np.array(rows[2][1]) * 1e25).tolist(), "x")]  # one direction
    rows += [(400, None, None), (401, [], None), (402, [0.0] * 16, None), (403, [None] + [1.0] * 15, None), (404, [float("nan")] * 16, None), (405, [float("-inf")] * 16, None)]
    rows += [(406, rows[4][1] + [0.0], None), (407, rows[4][1] + [0.0], None), (-7, [-0.0, 1.0], None), (-8, [0.0, 1.0], None), (409, [1.0], None), (410, [2.0], None), (411, [-1.0], None)]
    return rows


@pytest.mark.parametrize("bucket,block", [(256, 1024), (16, 1024), (16, 8)])
def test_odd_rows_and_split_buckets(spark, monkeypatch, bucket, block):
    """All in one bucket; in tables; and in buckets that are split into blocks."""
    monkeypatch.setattr(X, "BUCKET", bucket)
    monkeypatch.setattr(X, "BLOCK", block)
    rows = odd_rows()
    assert key(X.near_duplicates(spark.createDataFrame(rows, DDL).repartition(3)).collect()) == key(brute(rows))


def test_against_sql(spark, tmp_path):
    rows = [r for r in odd_rows() if r[0] not in (300, 301)]
    spark.createDataFrame(rows, DDL).coalesce(1).write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    assert key(con.sql(X.ORACLE).fetchall()) == key((i, n, c, i == c) for i, n, c, _ in brute(rows))


def test_recall_at_the_threshold(spark, monkeypatch):
    """Pairs with cosines just above 0.9 among many other vectors, with substrings of ten bits."""
    monkeypatch.setattr(X, "BUCKET", 4)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(3000, 64)) * np.linspace(2, 0.2, 64)
    rows = [(k, v.tolist(), None) for k, v in enumerate(base)] + [(10_000 + k, near(rng, base[k], rng.uniform(0.9005, 0.92)).tolist(), None) for k in range(1000)]
    x = np.array([v for _, v, _ in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= 0.9
    np.fill_diagonal(close, False)
    want = dict(zip((r[0] for r in rows), close.sum(axis=1).tolist(), strict=True))
    got = {r["vec_id"]: r["n_links"] for r in X.near_duplicates(spark.createDataFrame(rows, DDL)).collect()}
    assert all(got[k] <= want[k] for k in want) and sum(want.values()) >= 2000
    assert sum(got.values()) >= 0.97 * sum(want.values())


def test_codes_are_balanced_and_close_for_close_vectors():
    rng = np.random.default_rng(9)
    sample = X._unit(rng.normal(size=(4000, 32)) + 0.3)
    codes = X.Codes(sample, 10**6)
    bits = np.unpackbits(codes.encode(sample)[0], axis=1, bitorder="little")
    assert abs(bits.mean(axis=0) - 0.5).max() < 0.01 and codes.bits == 12
    one, two = codes.encode(sample[:500])[0], codes.encode(X._unit(np.array([near(rng, v, 0.95) for v in sample[:500]])))[0]
    apart = np.unpackbits(one ^ two, axis=1).sum(axis=1)
    assert np.median(apart) < 0.15 * bits.shape[1]


def test_no_rows(spark):
    assert X.near_duplicates(spark.createDataFrame([], DDL)).count() == 0
    assert key(X.near_duplicates(spark.createDataFrame([(1, None, None)], DDL)).collect()) == key([(1, 0, 1, True)])
