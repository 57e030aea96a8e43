"""The Merkle manifest against recursion in SQL and a direct computation."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest

from lodestone.llm import manifest
from lodestone.llm.hot import join_keyed

DDL = "doc_id long, source string, lang string, n_chars long, text string, leaf string, `a.b` int"


def rows():
    out = [(k, f"s{k % 3}", ("en", "de", None, "", "é", "en")[k % 6], 10 * k, f"text ä {k}", "clash", k) for k in range(150)]
    out += [(7, "s1", "en", 70, "text", "x", 1)] * 3  # one id, equal rows
    out += [(None, None, "en", None, None, None, 2), (None, "s", None, 4, "", "y", 3), (0, "s", "one", 2**63 - 1, "zero", "z", 4)]
    out += [(-k, "s", "neg", None if k % 2 else k, "t" * k, "", 5) for k in range(1, 40)]
    return out


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """The root, and of every node its siblings with their side (None: alone)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            paths[k].append((nodes[p ^ 1], p % 2) if p ^ 1 < len(nodes) else None)
        nodes, at = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)], [p // 2 for p in at]
    return nodes[0], paths


def brute(data):
    groups = defaultdict(list)
    for r in data:
        groups[r[2]].append(r[:5])
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {g: climb([x for _, x in sorted(((r[0] is not None, r[0] or 0), leaf(r[0], r[1], g, *r[3:])) for r in groups[g])]) for g in names}
    root, over = climb([made[g][0] for g in names])
    out = []
    for g, above in zip(names, over, strict=True):
        rows = sorted((((r[0] is not None, r[0] or 0), leaf(r[0], r[1], g, *r[3:]), r) for r in groups[g]), key=lambda x: x[:2])
        for (_, own, r), path in zip(rows, made[g][1], strict=True):
            path = path + above
            hit = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now = leaf(r[0], r[1], g, r[3] + 1, r[4]) if hit else own
            for s in path:
                now = h(now) if s is None else h(s[0], now) if s[1] else h(now, s[0])
            out.append((r[0], own, made[g][0], root, h(*(s[0] for s in path if s)), now, now == root))
            assert (now == root) == (not hit)
    return out


def key(rs):
    return sorted(map(repr, map(tuple, rs)))


@pytest.mark.parametrize("depth", [1, 2, 12])
def test_against_brute_force(spark, monkeypatch, depth):
    """Buckets of two and four leaves make many tiers; the production ones hold all."""
    monkeypatch.setattr(manifest, "DEPTH", depth)
    monkeypatch.setattr(manifest, "BUCKET", 2**depth)
    got = manifest.verified_manifest(spark.createDataFrame(rows(), DDL)).collect()
    want = brute(rows())
    assert key(got) == key(want) and not all(r["verified"] for r in got) and len({r["root"] for r in got}) == 1


def test_against_sql(spark, tmp_path):
    spark.createDataFrame(rows(), DDL).coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = con.sql(f"SELECT {', '.join(names)} FROM ({manifest.ORACLE})").fetchall()
    assert key(want) == key(brute(rows()))


def test_small_sizes(spark):
    docs = spark.createDataFrame(rows(), DDL)
    assert manifest.verified_manifest(docs.limit(0)).count() == 0
    one = manifest.verified_manifest(docs.filter("lang = 'one'")).collect()
    assert key(one) == key(brute([r for r in rows() if r[2] == "one"])) and one[0]["proof_sha256"] == h() and one[0]["leaf"] == one[0]["root"]


def test_hot_keys_are_joined_apart(spark):
    """Keys of a third of the rows and keys of one row each; null meets nothing."""
    made = spark.range(9000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 1000 = 1 THEN NULL ELSE concat('k', id) END AS k", "id")
    sizes = made.filter("k IS NOT NULL").groupBy("k").count()
    got = join_keyed(made, sizes, "k", "count", 9000)
    assert got.filter("k = 'hot' AND count = 3000").count() == 3000 and got.count() == made.filter("k IS NOT NULL").count()
