"""A Merkle manifest of a data set: block trees by DuckDB on the executors, their roots combined by Spark.

Every row is a leaf. Within a group (``lang``) leaves ascend by id, and every two consecutive nodes become one until one is left, the
group's root; the groups' roots make the root of all in the same way. Places come from sampled ranges, so no group is ever in one task.
Leaves are dealt to aligned buckets of ``BUCKET`` places, each a whole subtree; a task holds some buckets at a time as Arrow tables and lets
DuckDB make all their levels, an ordered ``string_agg`` and a ``sha256`` a level, and look up every leaf's siblings. Of a bucket only its root
goes on: Spark folds up to ``BUCKET`` of them into the next tier, as an array, until a group has one, and the tiers' siblings, the outer
proofs, are joined to the buckets.

A leaf's proof is the list of its siblings up to the root; folding a leaf and its proof gives the root again exactly if neither was altered.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lodestone.llm.hot import join_keyed
from lodestone.llm.store import Stored, tasks
from lodestone.operators.relational import ranked

#: Levels of a bucket and its leaves; rows that a task hands to DuckDB at once, and what it may take.
DEPTH = 12
BUCKET, CHUNK, MEMORY = 2**DEPTH, 2**15, "400MB"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(values: list[Column]) -> Column:
    """The digest of a row: each value as the length of its bytes, a colon and itself, or a dash if it is null."""
    part = lambda v: F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return _hash(F.concat(*[part(v.cast("string")) for v in values]))


def _levels(n: Column) -> Column:
    """How often ``n`` nodes are paired until one is left."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def _steps(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _path(siblings: Column, place: Column) -> Column:
    """Siblings with the side they are on: left of a node at an odd place. A node that is alone has a null for one."""
    right = lambda j: F.call_function("shiftright", place, j).bitwiseAND(F.lit(1)) == 1
    return F.transform(siblings, lambda h, j: F.struct(h.alias("h"), right(j).alias("left")))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, start, lambda now, s: _hash(F.when(s["h"].isNull(), now).when(s["left"], F.concat(s["h"], now)).otherwise(F.concat(now, s["h"]))))


def block_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, pos, depth, leaf, ...) in order of cell, with ``siblings`` in their cell's tree and its root ``top``."""
    import duckdb

    def trees(rows: pa.Table) -> pa.Table:
        con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        try:
            rows = rows.append_column("c", rows["cell"].combine_chunks().dictionary_encode().indices)
            con.register("leaves", rows)
            con.execute("CREATE TABLE level0 AS SELECT c, pos, depth, leaf AS h FROM leaves")
            deep = pc.max(rows["depth"]).as_py()
            for j in range(deep):
                con.execute(f"CREATE TABLE level{j + 1} AS SELECT c, pos // 2 AS pos, depth, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM level{j} WHERE depth > {j} GROUP BY c, pos // 2, depth")
            tops = " UNION ALL ".join(f"SELECT c, h FROM level{j} WHERE depth = {j}" for j in range(deep + 1))
            beside = " ".join(f"LEFT JOIN level{j} s{j} ON s{j}.c = r.c AND s{j}.pos = xor(r.pos >> {j}, 1) AND r.depth > {j}" for j in range(deep))
            siblings = f"list_value({', '.join(f's{j}.h' for j in range(deep))})[1:r.depth]" if deep else "[]::VARCHAR[]"
            return con.sql(f"SELECT r.* EXCLUDE (c), {siblings} AS siblings, t.h AS top FROM leaves r JOIN ({tops}) t USING (c) {beside}").to_arrow_table()
        finally:
            con.close()

    def out(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if rows.num_rows:
            made = trees(rows)
            yield from made.cast(rows.schema.append(pa.field("siblings", pa.list_(pa.string()))).append(pa.field("top", pa.string()))).to_batches(max_chunksize=4096)

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= CHUNK:
            now = pa.Table.from_batches(held)
            cut = pc.index(now["cell"], now["cell"][-1]).as_py()  # the last cell may go on
            yield from out(now.slice(0, cut))
            held = now.slice(cut).combine_chunks().to_batches()
    if held:
        yield from out(pa.Table.from_batches(held))


def combine(nodes: DataFrame) -> DataFrame:
    """One tier: ``nodes`` (key, pos, n, h: the pos-th of a key's n) with ``up``, the place in the next tier, the path within this tier and the
    ``top`` it leads to. A group is an array of at most ``BUCKET`` digests."""
    pairs = lambda h: F.transform(_steps(F.floor((F.size(h) + 1) / 2).cast("int")), lambda i: _hash(F.concat(F.get(h, 2 * i), F.coalesce(F.get(h, 2 * i + 1), F.lit("")))))
    place = F.struct(F.pmod("pos", F.lit(BUCKET)).cast("int").alias("place"), "h")
    groups = nodes.groupBy("key", "n", F.floor(F.col("pos") / BUCKET).alias("up")).agg(F.array_sort(F.collect_list(place)).alias("below"))
    depth = F.least(_levels(F.col("n")), F.lit(DEPTH))
    start = F.array(F.transform("below", lambda x: x["h"]))
    levels = F.aggregate(_steps(depth), start, lambda made, _: F.array_append(made, pairs(F.element_at(made, -1))))

    def paths(made):  # bound as a lambda's variable, so the levels are made once a group
        beside = lambda x: F.transform(_steps(depth), lambda j: F.get(F.get(made, j), F.call_function("shiftright", x["place"], j).bitwiseXOR(F.lit(1))))
        top = F.element_at(F.element_at(made, -1), 1)
        return F.transform("below", lambda x: F.struct(x["place"].alias("place"), _path(beside(x), x["place"]).alias("path"), top.alias("top")))

    each = groups.select("key", "n", "up", F.explode(F.element_at(F.transform(F.array(levels), paths), 1)).alias("x"))
    return each.select("key", "n", "up", (F.col("up") * BUCKET + F.col("x.place")).alias("pos"), "x.path", "x.top")


def outer_paths(nodes: DataFrame, most: int, name: str) -> DataFrame:
    """``nodes`` (key, pos, n, h) with the path to their key's root and the root: ``key, pos, path, root``, the tiers joined. ``most`` is the greatest n."""
    tiers, count = [], most
    while not tiers or count > 1:
        tiers.append(Stored(combine(nodes), f"{name}-tier").df)
        last = tiers[-1]
        nodes = last.filter(F.pmod("pos", F.lit(BUCKET)) == 0).select("key", F.col("up").alias("pos"), F.ceil(F.col("n") / BUCKET).cast("long").alias("n"), F.col("top").alias("h"))
        count = -(-count // BUCKET)
    out = tiers[0].select("key", "pos", "up", "path", F.col("top").alias("root"))
    for tier in tiers[1:]:
        upper = tier.select(F.col("key").alias("k"), F.col("pos").alias("a"), F.col("up").alias("u"), F.col("path").alias("p"), "top")
        joined = out.join(upper, (F.col("key") == F.col("k")) & (F.col("up") == F.col("a")))
        out = joined.select("key", "pos", F.col("u").alias("up"), F.concat("path", "p").alias("path"), F.col("top").alias("root"))
    return out.select("key", "pos", "path", "root")


def manifest(rows: DataFrame) -> DataFrame:
    """``rows`` (key text or null, id, leaf, other) with ``subroot``, ``root`` and ``path`` up to it.

    Leaves of a key ascend by id (null first), then by digest; rows that are equal in both take places of their own. Null is the first key. No
    rows give no rows. ``other`` is carried along.
    """
    held = rows.select(F.coalesce(F.concat(F.lit("="), "key"), F.lit("")).alias("key"), "id", "leaf", "other")
    at = ranked(held, [F.col("key"), F.col("id").asc_nulls_first(), F.col("leaf")], "rank")
    keys = Stored(at.groupBy("key").agg(F.min("rank").alias("first"), F.count("*").alias("n")), "manifest-keys").df
    total, most = keys.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    place = F.col("rank") - F.col("first")
    placed = join_keyed(at, keys, "key", "n", total).select(
        F.concat(F.floor(place / BUCKET).cast("string"), "key").alias("cell"),
        "key", "id", "leaf", "other", "n",
        F.floor(place / BUCKET).alias("bucket"),
        F.pmod(place, F.lit(BUCKET)).cast("int").alias("pos"),
        F.least(_levels(F.col("n")), F.lit(DEPTH)).alias("depth"),
    )
    dealt = placed.repartition(tasks(rows.sparkSession), "cell").sortWithinPartitions("cell", "pos")
    schema = StructType([*dealt.schema.fields, StructField("siblings", ArrayType(StringType())), StructField("top", StringType())])
    blocks = Stored(dealt.mapInArrow(block_trees, schema), "manifest-blocks", key="cell").df

    tops = blocks.filter("pos = 0").select("key", F.col("bucket").alias("pos"), F.ceil(F.col("n") / BUCKET).cast("long").alias("n"), F.col("top").alias("h"))
    inner = outer_paths(tops, -(-most // BUCKET), "manifest")
    inner = Stored(inner.select("key", F.col("pos").alias("bucket"), "path", F.col("root").alias("subroot")), "manifest-buckets").df
    groups = ranked(inner.filter("bucket = 0").select("key", F.col("subroot").alias("h")), [F.col("key")], "rank")
    n_groups = groups.count()
    over = outer_paths(groups.select(F.lit("").alias("key"), (F.col("rank") - 1).alias("pos"), F.lit(n_groups).cast("long").alias("n"), "h"), n_groups, "manifest-groups")
    over = groups.join(over.select("pos", F.col("path").alias("over"), "root"), F.col("rank") - 1 == F.col("pos")).select(F.col("key").alias("k"), "over", "root")
    buckets = inner.join(over, F.col("key") == F.col("k")).select(F.concat(F.col("bucket").cast("string"), "key").alias("cell"), F.concat("path", "over").alias("above"), "subroot", "root")
    return blocks.join(buckets, "cell").select("id", "leaf", "other", "subroot", "root", F.concat(_path(F.col("siblings"), F.col("pos")), "above").alias("path"))


def verified_manifest(docs: DataFrame) -> DataFrame:
    """One row per document: its leaf, its group's root, the root, the digest of its proof, and the root that the document as it is found later
    leads to with that proof. Found with one character more are those whose id has a CRC-32 that 7 divides; a null count stays, and a
    document without an id is found as it was. Null values are leaves' dashes, equal rows leaves of their own; no documents give no rows."""
    later = {c: F.col(c) for c in FIELDS} | {"n_chars": (F.col("n_chars").cast("decimal(20,0)") + 1)}
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    found = F.when(tampered, leaf(list(later.values())))
    rows = docs.select(F.col("lang").alias("key"), F.col("doc_id").alias("id"), leaf([F.col(c) for c in FIELDS]).alias("leaf"), found.alias("other"))
    proof = F.array_join(F.transform("path", lambda s: s["h"]), "")  # which leaves nulls out
    out = manifest(rows).withColumn("folded_root", fold(F.coalesce("other", "leaf"), F.col("path")))
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", _hash(proof).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _oracle() -> str:
    part = lambda v: f"coalesce(strlen({v}::VARCHAR)::VARCHAR || ':' || {v}::VARCHAR, '-')"
    digest = lambda **new: f"sha256({' || '.join(part(new.get(c, c)) for c in FIELDS)})"
    crc = "list_reduce(list_transform(range(length(doc_id::VARCHAR)), lambda i: ord(substr(doc_id::VARCHAR, i + 1, 1))::BIGINT), lambda c, b: list_reduce(range(8), lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), 4294967295)"
    up = "sha256(CASE WHEN s.h IS NULL THEN w.now WHEN w.pos % 2 = 1 THEN s.h || w.now ELSE w.now || s.h END), w.proof || coalesce(s.h, '')"
    return f"""
WITH RECURSIVE base AS (SELECT row_number() OVER () AS rid, lang, doc_id, {digest()} AS leaf,
    CASE WHEN n_chars IS NOT NULL AND xor({crc}, 4294967295) % 7 = 0 THEN {digest(n_chars="(n_chars::HUGEINT + 1)")} END AS later FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM base),
up(lang, lvl, pos, n, h) AS (SELECT lang, 0, pos, n, leaf FROM placed
    UNION ALL SELECT lang, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY lang, lvl, n, pos // 2),
sub AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top(lvl, pos, n, h) AS (SELECT 0, pos, n, h FROM sub
    UNION ALL SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, n, pos // 2),
walk(rid, lang, lvl, pos, n, now, proof) AS (SELECT rid, lang, 0, pos, n, coalesce(later, leaf), '' FROM placed
    UNION ALL SELECT w.rid, w.lang, w.lvl + 1, w.pos // 2, (w.n + 1) // 2, {up} FROM walk w LEFT JOIN up s ON s.lang IS NOT DISTINCT FROM w.lang AND s.lvl = w.lvl AND s.pos = xor(w.pos, 1) WHERE w.n > 1),
over_all(rid, lvl, pos, n, now, proof) AS (SELECT w.rid, 0, s.pos, s.n, w.now, w.proof FROM walk w JOIN sub s ON s.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1
    UNION ALL SELECT w.rid, w.lvl + 1, w.pos // 2, (w.n + 1) // 2, {up} FROM over_all w LEFT JOIN top s ON s.lvl = w.lvl AND s.pos = xor(w.pos, 1) WHERE w.n > 1)
SELECT p.doc_id, p.leaf, s.h AS subroot, r.h AS root, sha256(o.proof) AS proof_sha256, o.now AS folded_root, o.now = r.h AS verified
FROM placed p JOIN sub s ON s.lang IS NOT DISTINCT FROM p.lang JOIN (FROM over_all WHERE n = 1) o USING (rid), (SELECT h FROM top WHERE n = 1) r
"""


#: op13 by recursion over whole levels; CRC-32 bit by bit.
ORACLE = _oracle()
