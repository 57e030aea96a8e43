"""Removal of repeated byte strings with suffix arrays.

Every byte covered by a string of ``LENGTH`` bytes that also starts elsewhere goes. Deciding that needs the neighbours of a
suffix in suffix order, so texts are cut for the shards such that no repeat is lost:

* of the ``GRAM``-byte grams in a stretch of ``LENGTH`` bytes the one with the least hash is its mark. It depends on the
  stretch's content alone, so both places of a repeat have the same mark at the same offset; marks that occur once are left
  out, and so are texts without any other;
* neighbouring stretches with one mark make a piece. Equal pieces are one with a count, summed before they travel, so a passage that a
  third of the documents share is one row. A mark with one piece only needs no sort: the piece is repeated as a whole if it
  occurs twice;
* the pieces of the other marks go to shards, which sort their suffixes by induced sorting (see :mod:`induced`) and take
  neighbours with a carried common prefix of ``LENGTH`` or more as repeats. A mark with over ``SPLIT`` different pieces is too much for
  one shard: its pieces are cut into runs of stretches, at fixed distances from the mark. A run goes by the bytes that all its stretches
  have in common, which every place of a repeat has, and equal runs are one with a count, so a run is handled as a piece is, and cut
  into shorter ones if there still are too many of it.

Texts that occur several times are handled once; being copies they go whole if they are long enough.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.induced import sort_suffixes
from lodestone.llm.store import Stored, tasks

LENGTH, GRAM = 200, 100
#: Bytes of pieces a shard should hold, and different pieces of one mark that a shard takes.
SHARD_BYTES, SPLIT = 4 << 20, 512
#: Stretches in a run of a piece whose mark has too many, then of a run that there is too much of; the last are stretches, of which equals only meet.
RUNS = (32, 8, 2, 1)
#: Pieces from which a batch goes out.
STEP = 1 << 12
#: Bytes of texts whose marks are found at once; stretches of a longer text.
GROUP, SEGMENT = 1 << 17, 1 << 20
#: Different pieces of a text that are held before they go out; a piece found again later is one more row.
HELD = 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base & (2**64 - 1)))
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the ``GRAM`` bytes at every place, from prefix sums of a polynomial modulo 2**64."""
    n = len(data)
    size = 1 << max(n, 1).bit_length()
    if size not in _cache:
        _cache.clear()
        base = int(_BASE)
        _cache[size] = _powers(size, base), _powers(size, pow(base, -1, 1 << 64))
    up, down = _cache[size]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)])
    h = (total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def marks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first, last, hash) of the runs of stretches, by their starts, that share a mark; of equal hashes in a stretch the first
    place is the mark. A text alone may have any length: it is read ``SEGMENT`` stretches at a time, where a run may end early."""
    if len(texts) == 1 and len(texts[0]) > SEGMENT + LENGTH:
        cuts = range(0, len(texts[0]) - LENGTH + 1, SEGMENT)
        found = [marks([texts[0][s : s + SEGMENT + LENGTH - 1]]) for s in cuts]
        text, first, last, h = (np.concatenate(x) for x in zip(*((t, a + s, b + s, h) for s, (t, a, b, h) in zip(cuts, found, strict=True)), strict=True))
        return text, first, last, h
    sizes = np.array([len(x) for x in texts], np.int64)
    joined = np.frombuffer(b"".join(texts), np.uint8)
    if len(joined) < LENGTH:
        return (*(np.empty(0, np.int64) for _ in range(3)), np.empty(0, np.uint64))
    h = gram_hashes(joined)
    w = LENGTH - GRAM + 1
    n = len(h)
    # Least element of every window of w: of two overlapping powers of two; ties go to the first place.
    place, span, best = np.arange(n, dtype=np.int32), 1, h
    while span * 2 <= w:
        a, b = best[: len(best) - span], best[span:]
        right = b < a
        place = np.where(right, place[span:], place[: len(a)])
        best = np.where(right, b, a)
        span *= 2
    m, off = n - w + 1, w - span
    a, b = best[:m], best[off : off + m]
    at = np.where(b < a, place[off : off + m], place[:m])
    begin = np.cumsum(sizes) - sizes
    inside = np.zeros(m + 1, np.int8)  # stretches that lie in one text
    long = sizes >= LENGTH
    inside[begin[long]] = 1
    inside[(begin + sizes)[long] - LENGTH + 1] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    new = inside.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~inside[:-1]
    new[begin[long]] = True
    first = np.flatnonzero(new)
    ends = inside.copy()
    ends[:-1] &= new[1:] | ~inside[1:]
    last = np.flatnonzero(ends)
    text = np.searchsorted(begin, first, side="right") - 1
    return text, first - begin[text], last - begin[text], h[at[first]]


def grouped(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first, texts) of neighbouring texts of about ``GROUP`` bytes, or of one longer text."""
    start, held, size = 0, [], 0
    for k, x in enumerate(texts):
        t = x.as_py()
        if held and size + len(t) > GROUP:
            yield start, held
            start, held, size = k, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield start, held


def _text(c: str) -> F.Column:
    return F.coalesce(F.col(f"`{c}`"), F.lit("")).cast("binary")


def marked(docs: DataFrame) -> DataFrame:
    """``docs`` (sha, body) -> sha, marks: a mark that a text has often is listed twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for _, texts in grouped(b.column(1)):
                text, _, _, h = marks(texts)
                order = np.lexsort((h, text))
                text, h = text[order], h[order].view(np.int64)
                same = (text[1:] == text[:-1]) & (h[1:] == h[:-1])
                nth = np.ones(len(h), np.int64)  # a third occurrence tells no more than two
                nth[1:] += same
                nth[2:][same[1:] & same[:-1]] = 3
                text, h = text[nth < 3], h[nth < 3]
                found += np.split(h, np.searchsorted(text, np.arange(1, len(texts))))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            values = pa.array(np.concatenate(found) if found else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["sha", "marks"])

    return docs.mapInArrow(run, "sha binary, marks array<long>")


PIECES = pa.schema([("sha", pa.binary()), ("piece", pa.binary()), ("starts", pa.binary()), ("mark", pa.int64()), ("n", pa.int64()), ("body", pa.binary())])


def pieces(texts: DataFrame) -> DataFrame:
    """``texts`` (sha, body, shared: its repeated marks) -> a row per text and different piece in it: name, starts, mark, count, bytes."""

    def of(sha: bytes, text: bytes, first: np.ndarray, last: np.ndarray, h: np.ndarray, shared: np.ndarray) -> Iterator[tuple]:
        wanted = np.flatnonzero(np.isin(h, shared))
        for lo in range(0, len(wanted), HELD):
            k = wanted[lo : lo + HELD]
            held: dict[bytes, tuple[list, int, bytes]] = {}
            for i, j, mark in zip(first[k].tolist(), last[k].tolist(), h[k].tolist(), strict=True):
                name = xxhash.xxh3_128_digest(body := text[i : j + LENGTH])
                if name in held:
                    held[name][0].append(i)
                else:
                    held[name] = ([i], mark, body)
            for name, (at, mark, body) in held.items():
                yield sha, name, array("i", at).tobytes(), mark, len(at), body

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), PIECES, strict=True)], schema=PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for start, texts in grouped(b.column(1)):
                text, first, last, h = marks(texts)
                cuts, h = np.searchsorted(text, np.arange(len(texts) + 1)), h.view(np.int64)
                for k, body in enumerate(texts):
                    own = slice(cuts[k], cuts[k + 1])
                    for row in of(b.column(0)[start + k].as_py(), body, first[own], last[own], h[own], b.column(2)[start + k].values.to_numpy()):
                        rows.append(row)
                        if len(rows) >= STEP:
                            yield batch(rows)
                            rows = []
            if rows:
                yield batch(rows)

    return texts.mapInArrow(run, "sha binary, piece binary, starts binary, mark long, n long, body binary")


FOUND = "piece binary, first int, last int"


def _found(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * 3
    return pa.table([pa.array(x, k) for x, k in zip(columns, (pa.binary(), pa.int32(), pa.int32()), strict=True)], names=["piece", "first", "last"])


def repeats(t: pa.Table) -> pa.Table:
    """Of one shard of different pieces: runs of stretches, by their starts in the piece, that start at more than one place."""
    bodies = t.column("body").to_pylist()
    sizes = np.array([len(x) for x in bodies], np.int64)
    raw = np.frombuffer(b"\0".join(bodies), np.uint8)
    begin = np.cumsum(sizes + 1) - sizes - 1
    piece = np.repeat(np.arange(len(bodies), dtype=np.int32), sizes + 1)[:-1]
    order, common = sort_suffixes(raw, 256, LENGTH)
    offset = order - begin[piece[order]]
    at = np.flatnonzero(offset <= sizes[piece[order]] - LENGTH)  # suffixes with a full stretch in their piece
    whole, of, offset = order[at], piece[order[at]], offset[at]
    # Between two of them the common prefix is the least on the way.
    same = np.minimum.reduceat(common[: at[-1] + 1], at[:-1] + 1) >= LENGTH if len(at) > 1 else np.empty(0, bool)
    many = (t.column("n").to_numpy() > 1)[of]
    many[1:] |= same
    many[:-1] |= same
    group = np.concatenate([[0], np.cumsum(~same)])
    many = (np.bincount(group, weights=many, minlength=group[-1] + 1) > 0)[group]
    hit = np.sort(whole[many])
    if not len(hit):
        return _found([])
    cut = np.flatnonzero(np.diff(hit) > 1)
    first, last = hit[np.concatenate([[0], cut + 1])], hit[np.concatenate([cut, [len(hit) - 1]])]
    names, of = t.column("piece").to_pylist(), piece[first]
    return _found(list(zip([names[k] for k in of.tolist()], (first - begin[of]).tolist(), (last - begin[of]).tolist(), strict=True)))


RUN = pa.schema([("piece", pa.binary()), ("at", pa.int32()), ("run", pa.binary()), ("mark", pa.int64()), ("phase", pa.int32()), ("n", pa.int64()), ("body", pa.binary())])


def runs(pieces: DataFrame, width: int) -> DataFrame:
    """``pieces`` (piece, mark, phase, n, body) -> a row per run of up to ``width`` stretches: its piece and place there, its name, what it goes
    by, phase, count, bytes. The phase tells how far the first stretch is from the earliest that has the mark; null: not known yet."""

    def of(piece: bytes, mark: int, phase: int | None, n: int, body: bytes) -> Iterator[tuple]:
        if phase is None:
            phase = LENGTH - GRAM - int(np.flatnonzero(gram_hashes(np.frombuffer(body, np.uint8)).view(np.int64) == mark)[0])
        end = phase + len(body) - LENGTH
        for low in range(phase // width * width, end + 1, width):
            high = min(low + width - 1, LENGTH - GRAM)
            common = body[high - phase : low - phase + LENGTH]  # of all stretches from low to high, whichever of them the piece has
            at = max(low, phase) - phase
            own = body[at : min(high, end) - phase + LENGTH]
            key = xxhash.xxh64_intdigest(common, low)
            yield piece, at, xxhash.xxh3_128_digest(own, phase + at), key - (key >> 63 << 64), phase + at, n, own

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), RUN, strict=True)], schema=RUN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [x for row in zip(*(c.to_pylist() for c in b.columns), strict=True) for x in of(*row)]
            if rows:
                yield batch(rows)

    return pieces.mapInArrow(run, "piece binary, at int, run binary, mark long, phase int, n long, body binary")


def cut(texts: DataFrame) -> DataFrame:
    """``texts`` (sha, body, found: starts of pieces with runs of repeated stretches) -> sha, n_removed, n_spans, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for sha, body, found in zip(*b.columns, strict=True):
                sha, body = sha.as_py(), body.as_py()
                edge = np.zeros(len(body) + 1, np.int32)
                found = found.values
                starts = found.field("starts").to_pylist()
                size = [len(x) // 4 for x in starts]
                at = np.frombuffer(b"".join(starts), np.int32)
                np.add.at(edge, at + np.repeat(found.field("first").to_numpy(), size), 1)
                np.add.at(edge, at + np.repeat(found.field("last").to_numpy() + LENGTH, size), -1)
                gone = np.cumsum(edge[:-1]) > 0
                runs = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                kept = np.frombuffer(body, np.uint8)[~gone].tobytes()
                for col, v in zip(out, (sha, len(body) - len(kept), runs, hashlib.sha256(kept).hexdigest()), strict=True):
                    col.append(v)
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["sha", "n_removed", "n_spans", "kept_sha256"])

    return texts.mapInArrow(run, "sha binary, n_removed long, n_spans long, kept_sha256 string")


def repeated_pieces(different: DataFrame, widths: tuple[int, ...] = RUNS) -> DataFrame:
    """``different`` pieces (piece, mark, phase, n, size, body) -> ``piece, first, last``: runs of repeated stretches."""
    spark = different.sparkSession
    of = different.groupBy("mark").agg(F.count("*").alias("pieces"), F.sum("size").alias("bytes"))
    of = Stored(of, "suffix-piece-marks").df
    alone = different.join(of.filter("pieces = 1").select("mark"), "mark", "left_semi").filter("n > 1")
    whole = alone.select("piece", F.lit(0).alias("first"), (F.col("size") - LENGTH).cast("int").alias("last"))
    few = of.filter(F.col("pieces").between(2, SPLIT) if widths else "pieces > 1")
    total = few.agg(F.sum("bytes")).first()[0] or 0
    shards = max(tasks(spark), -(-total // SHARD_BYTES))
    sent = different.join(few.select("mark"), "mark").select("piece", "n", "body", F.pmod("mark", F.lit(shards)).cast("int").alias("shard"))
    found = whole.union(sent.groupBy("shard").applyInArrow(repeats, FOUND))
    many = of.filter(F.col("pieces") > SPLIT).select("mark")
    if widths and not many.isEmpty():
        own = Stored(runs(different.join(many, "mark").select("piece", "mark", "phase", "n", "body"), widths[0]), "suffix-runs").df
        shorter = own.groupBy(F.col("run").alias("piece")).agg(*[F.first(c).alias(c) for c in ("mark", "phase", "body")], F.sum("n").alias("n"))
        shorter = Stored(shorter.withColumn("size", F.length("body").cast("long")), "suffix-different-runs").df
        twice = repeated_pieces(shorter, widths[1:]).withColumnRenamed("piece", "run")
        found = found.union(own.select("run", "piece", "at").join(twice, "run").select("piece", F.col("at") + F.col("first"), F.col("at") + F.col("last")))
    return found


def removed_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, counted, rows): ``texts`` has sha, body, found (see :func:`cut`) of the different texts with a repeat inside or
    to other texts; ``counted`` has sha, n_bytes, copies of all different texts; ``rows`` has id, sha of every row."""
    body = _text(text_col)
    held = docs.select(F.col(f"`{id_col}`").alias("id"), body.alias("body"), F.unhex(F.sha2(body, 256)).alias("sha"))
    counted = held.groupBy("sha").agg(F.count("*").alias("copies"), F.first(F.length("body")).cast("long").alias("n_bytes"))
    counted = Stored(counted, "suffix-texts").df
    found = marked(held.select("sha", "body")).groupBy("sha").agg(F.first("marks").alias("marks"))
    found = Stored(found, "suffix-marks")
    each = found.df.select("sha", F.explode("marks").alias("mark"))
    # 64 bits name a text here: a clash only adds a candidate.
    each = each.select(F.xxhash64("sha").alias("text"), "mark")
    twice = Stored(each.groupBy("mark").agg(F.count("*").alias("n")).filter("n > 1").select("mark"), "suffix-shared-marks").df
    shared = Stored(each.join(twice, "mark").groupBy("text").agg(F.collect_set("mark").alias("shared")), "suffix-shared").df
    # Of equal rows one goes on, picked before they meet.
    wanted = held.select("sha", "body", F.xxhash64("sha").alias("text")).join(shared, "text").groupBy("sha")
    texts = Stored(wanted.agg(F.first("body").alias("body"), F.first("shared").alias("shared")), "suffix-candidates").df
    made = Stored(pieces(texts), "suffix-pieces").df
    different = made.groupBy("piece").agg(F.first("mark").alias("mark"), F.sum("n").alias("n"), F.first("body").alias("body"))
    different = different.withColumn("size", F.length("body").cast("long")).withColumn("phase", F.lit(None).cast("int"))
    different = Stored(different, "suffix-different").df
    repeated = Stored(repeated_pieces(different), "suffix-found").df
    places = made.select("sha", "piece", "starts").join(repeated, "piece")
    spans = places.groupBy("sha").agg(F.collect_list(F.struct("starts", "first", "last")).alias("found"))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.unhex(F.sha2(body, 256)).alias("sha"))
    return texts.select("sha", "body").join(spans, "sha"), counted, rows


EMPTY = hashlib.sha256(b"").hexdigest()


def removals(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, kept_sha256`` for every row.

    Null and empty texts have 0 bytes; rows with equal ids and texts are two documents, so from ``LENGTH`` bytes on both go
    whole; texts shorter than that lose nothing; an empty table gives no row. Other columns are not read.
    """
    texts, counted, rows = removed_spans(docs, id_col=id_col, text_col=text_col)
    after = Stored(counted.join(cut(texts), "sha", "left"), "suffix-cut").df  # a row a text, so that many copies of one join in many tasks
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    out = rows.join(after, "sha")
    return out.select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, EMPTY).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )
