"""WARC records and a Merkle fixity audit of two stores.

Every record is hashed into a leaf. A store keeps its records in shards by digest, in order of digest, so a node of its tree is a digest's first
hexadecimal digits: it hashes what lies below in order, with the byte range each child takes, and up to 16 children make a node, down from
one root. As places come from content, two stores with different records still have comparable nodes: a record that one lacks changes
the nodes above it and no others. An audit compares the roots and descends only below nodes that differ, so the rows it joins are
the mismatching branches, not the archive; in the last of them records are compared one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.store import Stored

#: Distinct records a shard should hold at most, on average; digits of the lowest nodes beyond those of shards.
SHARD_RECORDS, DIGITS = 1024, 2


def record(page_id: Column, url: Column, html: Column) -> Column:
    """One WARC/1.1 resource record as text. Null url: no target line; null html: an empty block."""
    body = F.coalesce(html, F.lit(""))
    target = F.coalesce(F.concat(F.lit("WARC-Target-URI: "), url, F.lit("\r\n")), F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("none")),
        F.lit(">\r\n"),
        target,
        F.lit("Content-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def leaf_digest(rec: Column) -> Column:
    """SHA-256 of the record behind a leaf mark, so no inner node can pass for a leaf."""
    return F.sha2(F.concat(F.lit("leaf\n"), rec).cast("binary"), 256)


def shard_digits(records: int, shard_records: int = SHARD_RECORDS) -> int:
    """Digits of the digest that name a shard."""
    k = 0
    while records > shard_records * 16**k:
        k += 1
    return k


def manifest(leaves: DataFrame, id_col: str, digits: int) -> DataFrame:
    """What a store holds: ``id_col, shard, seq, start, end, n_bytes, copies, digest`` of ``leaves`` (id, n_bytes, digest).

    Copies of a record are one leaf with a count and take the offsets of all copies, so no group of repeated rows makes a shard
    large. Order in a shard: digest, then id (null first).
    """
    one = leaves.select(id_col, "n_bytes", "digest").groupBy(id_col, "n_bytes", "digest").agg(F.count("*").alias("copies"))
    one = one.withColumn("shard", F.substring("digest", 1, digits))
    order = Window.partitionBy("shard").orderBy("digest", F.col(id_col).asc_nulls_first(), "n_bytes")
    span = F.col("n_bytes") * F.col("copies")
    end = F.sum(span).over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = one.withColumn("seq", F.row_number().over(order) - 1).withColumn("end", end).withColumn("start", F.col("end") - span)
    return placed.select(id_col, "shard", "seq", "start", "end", "n_bytes", "copies", "digest")


def tree(held: DataFrame, id_col: str, digits: int) -> list[DataFrame]:
    """Stored levels of a store's tree, root first: ``node, bytes, hash``; the node of level k is k digits. An empty store has no nodes.

    A node gathers at most 16 children, the lowest ones the records of equal first ``digits`` digits: digests spread them evenly.
    """
    leaf = F.struct("digest", F.col(id_col).alias("id"), "n_bytes", "copies")
    level = held.groupBy(F.substring("digest", 1, digits).alias("node")).agg(F.sum(F.col("n_bytes") * F.col("copies")).alias("bytes"), F.array_sort(F.collect_list(leaf)).alias("below"))
    text = F.transform("below", lambda x: F.concat_ws(":", (x["n_bytes"] * x["copies"]).cast("string"), x["digest"]))
    levels = []
    for k in range(digits, -1, -1):
        hashed = F.sha2(F.concat(F.lit("node\n"), F.array_join(text, "\n")).cast("binary"), 256)
        levels.append(Stored(level.select("node", "bytes", hashed.alias("hash")), f"warc-level-{k}").df)
        child = F.struct("node", "bytes", "hash")
        level = levels[-1].groupBy(F.substring("node", 1, k - 1).alias("node") if k > 1 else F.lit("").alias("node")).agg(F.sum("bytes").alias("bytes"), F.array_sort(F.collect_list(child)).alias("below"))
        text = F.transform("below", lambda x: F.concat_ws(":", x["node"], x["bytes"].cast("string"), x["hash"]))
    return levels[::-1]


def differing(a: list[DataFrame], b: list[DataFrame]) -> DataFrame:
    """Lowest nodes (``node``) whose hash differs between two trees, or that one lacks. Starts at the roots; of each level below only
    children of nodes that differed are read."""
    suspects = None
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        if suspects is not None:
            x, y = (z.join(suspects, F.substring("node", 1, k - 1) == F.col("up") if k > 1 else F.lit(True), "left_semi") for z in (x, y))
        both = x.select("node", "hash").join(y.select("node", F.col("hash").alias("other")), "node", "full")
        suspects = Stored(both.filter(~F.col("hash").eqNullSafe(F.col("other"))).select(F.col("node").alias("up")), "warc-suspects").df
    return suspects.withColumnRenamed("up", "node")


def damaged(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """``pages`` (id, url, html) as a faulty replica holds them, by hash of the id: some records lost, some cut short, some with one
    letter changed, some there that never were in the archive."""
    kind = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("none"))), 1, 8), 16, 10).cast("long") % 97
    html = F.when(kind == 1, F.substr("html", F.lit(1), F.floor(F.length("html") / 2).cast("int"))).when(kind == 2, F.concat(F.lit("?"), F.substr("html", F.lit(2)))).otherwise(F.col("html"))
    kept = pages.filter(kind != 0).select(id_col, "url", html.alias("html"))
    return kept.unionByName(pages.filter(kind == 3).select((-F.col(id_col) - 1).alias(id_col), "url", "html"))


def audit(leaves: DataFrame, replica: DataFrame, id_col: str = "page_id", shard_records: int = SHARD_RECORDS) -> DataFrame:
    """Two stores' records (id, n_bytes, digest), each laid out on its own, compared through their trees.

    One row per distinct record of either: id, n_bytes, digest, copies and copies there; shard, start and end in the store that
    should have it (in the replica, for a record that only that has); status ``ok``, or, found in a branch that differs, ``altered`` (its id
    has another record on the other side), ``lost`` (fewer copies there) or ``extra``. Null ids cannot be told apart, so they are lost or extra;
    equal rows are one record with copies; empty stores give an empty audit, one of them a whole store of lost or extra ones.
    """
    leaves, replica = Stored(leaves, "warc-leaves").df, Stored(replica, "warc-replica").df
    digits = shard_digits(leaves.count(), shard_records)
    here, there = (Stored(manifest(x, id_col, digits), "warc-manifest").df for x in (leaves, replica))
    low = digits + DIGITS
    suspects = differing(tree(here, id_col, low), tree(there, id_col, low))
    at = F.substring("digest", 1, low)
    mine, theirs = (x.join(suspects, at == F.col("node"), "left_semi") for x in (here, there))
    key = [id_col, "n_bytes", "digest"]
    record = [F.col("a.digest").eqNullSafe(F.col("b.digest")), F.col("a.n_bytes") == F.col("b.n_bytes"), F.col(f"a.{id_col}").eqNullSafe(F.col(f"b.{id_col}"))]
    both = mine.alias("a").join(theirs.alias("b"), record[0] & record[1] & record[2], "full")
    merged = both.select(
        *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in (*key, "shard", "start", "end")],
        F.coalesce("a.copies", F.lit(0)).alias("copies"),
        F.coalesce("b.copies", F.lit(0)).alias("copies_there"),
    )
    bad = Stored(merged.filter("copies <> copies_there"), "warc-differing").df
    sides = bad.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max("copies").alias("most"), F.min(F.col("copies") - F.col("copies_there")).alias("least"), F.max(F.col("copies") - F.col("copies_there")).alias("top"))
    two = Stored(sides.filter("least < 0 AND top > 0").select("id"), "warc-altered").df
    status = F.when(F.col("id").isNotNull(), "altered").when(F.col("copies") > F.col("copies_there"), "lost").otherwise("extra")
    out = [id_col, "n_bytes", "digest", "shard", "start", "end", "copies", "copies_there"]
    found = bad.join(two, F.col(id_col) == F.col("id"), "left").select(*out, status.alias("status"))
    clean = here.alias("a").join(bad.filter("copies > 0").alias("b"), record[0] & record[1] & record[2], "left_anti")
    return clean.select(*out[:-1], F.col("copies").alias("copies_there"), F.lit("ok").alias("status")).select(*out, "status").union(found)


#: op7: the same by comparing all records, without trees.
ORACLE = r"""
WITH p AS (SELECT page_id, url, html, ('0x' || substr(md5(coalesce(page_id::VARCHAR, 'none')), 1, 8))::BIGINT % 97 AS kind FROM pages),
both_stores AS (SELECT true AS here, page_id, url, html FROM p
    UNION ALL SELECT false, page_id, url, CASE kind WHEN 1 THEN substr(html, 1, (length(html) // 2)::BIGINT) WHEN 2 THEN concat('?', substr(html, 2)) ELSE html END FROM p WHERE kind <> 0
    UNION ALL SELECT false, -page_id - 1, url, html FROM p WHERE kind = 3),
r AS (SELECT here, page_id, concat(
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:', coalesce(page_id::VARCHAR, 'none'), '>' || chr(13) || chr(10),
    coalesce('WARC-Target-URI: ' || url || chr(13) || chr(10), ''),
    'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ', strlen(coalesce(html, ''))::VARCHAR, chr(13) || chr(10) || chr(13) || chr(10),
    coalesce(html, ''), chr(13) || chr(10) || chr(13) || chr(10)) AS rec FROM both_stores),
o AS (SELECT here, page_id, strlen(rec)::BIGINT AS n_bytes, sha256('leaf' || chr(10) || rec) AS digest, count(*)::BIGINT AS copies FROM r GROUP BY ALL),
n AS (SELECT count(*) AS records FROM p),
d AS (SELECT CASE WHEN records <= 1024 THEN 0 WHEN records <= 16384 THEN 1 WHEN records <= 262144 THEN 2 WHEN records <= 4194304 THEN 3 ELSE 4 END AS digits FROM n),
s AS (SELECT *, substr(digest, 1, digits) AS shard FROM o, d),
w AS (SELECT *, (sum(n_bytes * copies) OVER (PARTITION BY here, shard ORDER BY digest, page_id ASC NULLS FIRST, n_bytes ROWS UNBOUNDED PRECEDING))::BIGINT AS "end" FROM s),
m AS (SELECT coalesce(a.page_id, b.page_id) AS page_id, coalesce(a.n_bytes, b.n_bytes) AS n_bytes, coalesce(a.digest, b.digest) AS digest, coalesce(a.shard, b.shard) AS shard,
    coalesce(a."end" - a.n_bytes * a.copies, b."end" - b.n_bytes * b.copies) AS start, coalesce(a."end", b."end") AS "end", coalesce(a.copies, 0) AS copies, coalesce(b.copies, 0) AS copies_there
    FROM (FROM w WHERE here) a FULL JOIN (FROM w WHERE NOT here) b ON a.digest = b.digest AND a.n_bytes = b.n_bytes AND a.page_id IS NOT DISTINCT FROM b.page_id),
t AS (SELECT page_id AS id FROM m WHERE page_id IS NOT NULL GROUP BY page_id HAVING min(copies - copies_there) < 0 AND max(copies - copies_there) > 0)
SELECT page_id, n_bytes, digest, shard, start, "end", copies, copies_there, CASE WHEN copies = copies_there THEN 'ok' WHEN id IS NOT NULL THEN 'altered' WHEN copies > copies_there THEN 'lost' ELSE 'extra' END AS status
FROM m LEFT JOIN t ON page_id = id
"""
