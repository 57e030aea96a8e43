"""Language-model scoring: a Katz back-off model of n-grams with Good-Turing discounts, trained and evaluated in place.

The corpus is encoded once into chunks (a dictionary of word hashes and token numbers), stored in the shared folder. Counts
live in tables partitioned by n-gram. A chunk sends each partition its distinct n-grams with their training counts as one
sorted, compressed block, and the partition answers in the block's order, so neither n-grams nor tokens travel as rows:

1. words: totals and dense ids come back;
2. for each order from two up, n-grams by context, with the probabilities of their last words one order lower: totals, and the back-off weight of contexts that
   met an unseen successor, come back. Contexts too frequent for one partition are spread over all by successor; there are at most
   ``HOT`` a partition of them, so their sums are a bounded table;
3. every token is evaluated from the lowest order up: the discounted n-gram if seen, else the context's weight times the probability one order
   lower; below bigrams the discounted word, or the mass of unknown words. All levels sum to one exactly by construction.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lodestone.llm.store import Stored, tasks

CHUNK_TOKENS = 1 << 21
#: Chunks for which a partition of n-grams is made at least, so that its table stays small however large the corpus.
PART_CHUNKS = 3
#: Counts up to this are discounted by Good-Turing.
K = 5
#: A context with over 1 / (HOT * partitions) of all tokens is spread over all partitions.
HOT = 20
END = b"\n"  # no word holds a line feed
FOLDS, HELD_OUT = 7, 2
_TIGHT, _LOOSE = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(a: np.ndarray) -> bytes:
    """Integers or floats of 4 or 8 bytes, by byte planes, compressed."""
    a = np.ascontiguousarray(a)
    planes = np.empty((a.itemsize, len(a)), np.uint8)
    for k, plane in enumerate(planes):  # one by one: many times as fast as to copy the transposed array
        plane[:] = a.view(np.uint8)[k :: a.itemsize]
    return a.dtype.char.encode() + _TIGHT.compress(planes)


def unpack(b: bytes) -> np.ndarray:
    kind = np.dtype(b[:1].decode())
    planes = np.frombuffer(_LOOSE.decompress(b[1:]), np.uint8).reshape(kind.itemsize, -1)
    out = np.empty(planes.shape[1], kind)
    for k, plane in enumerate(planes):
        out.view(np.uint8)[k :: kind.itemsize] = plane
    return out


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a.astype(np.uint64), prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b), dtype=np.uint64)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def held_out(id_col: str) -> Column:
    """The fold of a document: crc32 of its id as text; a null id hashes as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def encode(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows ``chunk, ids, held, lengths, tokens, dictionary``; every document ends with the end token."""
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), held_out(id_col).alias("held"), F.col(f"`{text_col}`").alias("text"))
    schema = "chunk long, ids array<long>, held array<boolean>, lengths binary, tokens binary, dictionary binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), 0

        def start():
            return [], [], [], defaultdict(count().__next__)

        ids, held, seqs, known = start()
        size = 0

        def flush():
            nonlocal serial
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in known), np.uint64, len(known))
            order = np.argsort(hashes, kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            row = {
                "chunk": [(part << 32) | serial],
                "ids": [ids],
                "held": [held],
                "lengths": [pack(np.array([len(s) for s in seqs], np.int32))],
                "tokens": [pack(place[np.concatenate(seqs)])],
                "dictionary": [pack_sorted(hashes[order])],
            }
            serial += 1
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.binary()), ("tokens", pa.binary()), ("dictionary", pa.binary())]))

        for b in batches:
            for i, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                w = words(t)
                w.append(END)
                ids.append(i)
                held.append(h)
                seqs.append(np.fromiter(map(known.__getitem__, w), np.int32, len(w)))
                size += len(w)
                if size >= CHUNK_TOKENS:
                    yield flush()
                    (ids, held, seqs, known), size = start(), 0
        if ids:
            yield flush()

    return source.mapInArrow(run, schema)


class Chunk:
    def __init__(self, t: pa.Table):
        self.number = t.column("chunk")[0].as_py()
        self.ids, self.held = t.column("ids")[0].as_py(), np.array(t.column("held")[0].as_py(), bool)
        self.lengths, self.tokens = unpack(t.column("lengths")[0].as_py()), unpack(t.column("tokens")[0].as_py())
        self.dictionary = unpack_sorted(t.column("dictionary")[0].as_py())
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.train = ~self.held[self.doc]
        self.end = int(np.searchsorted(self.dictionary, np.uint64(xxhash.xxh64_intdigest(END))))
        starts = np.cumsum(self.lengths) - self.lengths
        self.before = np.roll(self.tokens, 1)
        self.before[starts] = self.end  # a text begins after an end
        self.starts = starts

    def before_that(self) -> np.ndarray:
        out = np.roll(self.before, 1)
        out[self.starts] = self.end
        return out


BLOCK = "p int, chunk long, keys binary, counts binary, other binary"
BLOCKS = pa.schema([("p", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("other", pa.binary())])


def blocks(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, BLOCKS, strict=True)], schema=BLOCKS)


def by_part(parts: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, positions in their order) for every part that occurs."""
    parts = parts.astype(np.uint16) if n <= 1 << 16 else parts  # small numbers are sorted by radix
    order = np.argsort(parts, kind="stable")
    cuts = np.searchsorted(parts[order], np.arange(n + 1))
    for p in range(n):
        if cuts[p + 1] > cuts[p]:
            yield p, order[cuts[p] : cuts[p + 1]]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def word_requests(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                c = Chunk(pa.Table.from_batches([b.slice(k, 1)]))
                counts = np.bincount(c.tokens[c.train], minlength=len(c.dictionary)).astype(np.int32)
                for p, at in by_part((mixed(c.dictionary) % np.uint64(n)).astype(np.int64), n):
                    yield from blocks([(p, c.number, pack_sorted(c.dictionary[at]), pack(counts[at]), b"")]).to_batches()

    return run


def count_of_counts(c: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(c[c > 0], K + 2), minlength=K + 3)[1 : K + 2].astype(np.int64)


def word_table(n: int):
    """Of one partition: answers (ids, totals) to every chunk, and statistics as chunk -1. Unseen words get id -1."""

    def run(t: pa.Table) -> pa.Table:
        p = t.column("p")[0].as_py()
        keys = [unpack_sorted(x.as_py()) for x in t.column("keys")]
        counts = [unpack(x.as_py()) for x in t.column("counts")]
        table, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(where, weights=np.concatenate(counts), minlength=len(table)).astype(np.int64)
        seen = total > 0
        ids = np.where(seen, (np.cumsum(seen) - 1) * n + p, -1)
        stats = np.array([seen.sum(), total.sum(), *count_of_counts(total)], np.int64)
        rows, at = [(p, -1, b"", pack(stats), b"")], 0
        for k, chunk in enumerate(t.column("chunk").to_pylist()):
            own = where[at : at + len(keys[k])]
            at += len(keys[k])
            rows.append((p, chunk, b"", pack(total[own]), pack(ids[own])))
        return blocks(rows)

    return run


def discounts(n: np.ndarray) -> np.ndarray:
    """Factor for counts 0..K+1 (the last for all above K); n[r - 1] is how many types have count r.

    Good-Turing as Katz scales it; where that is not in (0, 1) for some count (too few types), absolute discounting with
    the usual estimate of its constant.
    """
    d = np.ones(K + 2)
    n = n.astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        cut = (K + 1) * n[K] / n[0]
        r = np.arange(1, K + 1)
        gt = ((r + 1) * n[1 : K + 1] / (r * n[:K]) - cut) / (1 - cut)
    if np.all(np.isfinite(gt)) and np.all(gt > 0) and np.all(gt < 1):
        d[1 : K + 1] = gt
    else:
        less = min(max(n[0] / (n[0] + 2 * n[1]), 0.1), 0.9) if n[0] else 0.5
        d[1:] = 1 - less / np.arange(1, K + 2)
    return d


class Words:
    """Word probabilities from totals: discounted, and what the discounts leave for all unknown words together."""

    def __init__(self, stats: np.ndarray):
        self.types, self.total = int(stats[0]), int(stats[1])
        self.factor = discounts(stats[2:])
        self.unknown = 1.0 - kept_mass(stats) / self.total if self.total else 1.0

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.factor[np.minimum(c, K + 1)] * c / max(self.total, 1), self.unknown)


def kept_mass(stats: np.ndarray) -> float:
    """Sum of discounted counts over all types, from total and counts of counts."""
    f = discounts(stats[2:])
    low = stats[2 : 2 + K] * np.arange(1, K + 1)
    return float((low * f[1 : K + 1]).sum() + (stats[1] - low.sum()) * f[K + 1])


def gram_part(context: np.ndarray, word: np.ndarray, hot: np.ndarray, n: int) -> np.ndarray:
    one = mixed(context.astype(np.uint64))
    return ((np.where(hot, mixed(one ^ word.astype(np.uint64)), one)) % np.uint64(n)).astype(np.int64)


def answers(t: pa.Table, c: Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(totals, ids) of a chunk's dictionary from the word partitions' blocks."""
    totals, ids = np.zeros(len(c.dictionary), np.int64), np.full(len(c.dictionary), -1, np.int64)
    got = {p: k for k, p in enumerate(t.column("p").to_pylist())}
    for p, at in by_part((mixed(c.dictionary) % np.uint64(n)).astype(np.int64), n):
        totals[at], ids[at] = unpack(t.column("counts")[got[p]].as_py()), unpack(t.column("other")[got[p]].as_py())
    return totals, ids


LOW = np.uint64(0xFFFFFFFF)


def keyed(level: int, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """(64-bit keys in the order of context and word, contexts by the number that the keys hold; none if they hold the contexts)."""
    if level == 2:
        return (context << np.uint64(32)) | word, None
    contexts, number = np.unique(context, return_inverse=True)
    return (number.astype(np.uint64) << np.uint64(32)) | word, contexts


class Grams:
    """Distinct n-grams of a chunk: contexts and words, each by their ids plus 1 in 32 bits (unknown is 0), a token each occurs at, every token's
    n-gram, partitions. ``followers``: total of the context; ``hot``: too frequent for one partition. ``below``: of every token, the total
    of the n-gram one word shorter."""

    def __init__(self, level: int, c: Chunk, totals: np.ndarray, ids: np.ndarray, n: int, hot_from: int, below: np.ndarray | None):
        if len(ids) and ids.max() >= (1 << 32) - 2:
            raise OverflowError("over 2**32 distinct words")
        w = (ids + 1).astype(np.uint64)
        context = w[c.before]
        if level == 3:
            context |= w[c.before_that()] << np.uint64(32)
        keys, _ = keyed(level, context, w[c.tokens])
        keys, self.first, self.where = np.unique(keys, return_index=True, return_inverse=True)
        self.word, self.context = keys & LOW, context[self.first]
        self.followers = totals[c.before[self.first]]
        if level == 3:  # a text's first word follows the end, and what ends a text is no context
            before = below[np.maximum(self.first - 1, 0)]
            self.followers = np.where(np.isin(self.first, c.starts), self.followers, before)
        self.hot = self.followers > hot_from
        self.part = gram_part(self.context, self.word, self.hot, n)
        self.n = n

    def parts(self) -> Iterator[tuple[int, np.ndarray]]:
        return by_part(self.part, self.n)


def pack_grams(level: int, context: np.ndarray, word: np.ndarray) -> bytes:
    if level == 2:
        return pack_sorted((context << np.uint64(32)) | word)
    each, size = np.unique(context, return_counts=True)
    return join(pack_sorted(each), join(pack(size.astype(np.int32)), pack(word.astype(np.uint32))))


def unpack_grams(level: int, b: bytes) -> tuple[np.ndarray, np.ndarray]:
    if level == 2:
        keys = unpack_sorted(b)
        return keys >> np.uint64(32), keys & LOW
    each, rest = apart(b)
    size, word = apart(rest)
    return np.repeat(unpack_sorted(each), unpack(size)), unpack(word).astype(np.uint64)


def requests(level: int, n: int, hot_from: int, w: Words, models: list[tuple]):
    """n-grams of ``level`` words to their partitions; ``models``: what is fitted of the levels below."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return blocks([])
        c = Chunk(left)
        totals, ids = answers(of_kind(right, 0), c, n)
        below, lower = descend(c, right, totals, ids, n, hot_from, w, models) if models else (None, None)
        g = Grams(level, c, totals, ids, n, hot_from, below)
        counts = np.bincount(g.where[c.train], minlength=len(g.word)).astype(np.int32)
        told = totals[c.tokens[g.first]] if level == 2 else lower[g.first]  # words travel as totals, they are shorter
        rows = []
        for p, at in g.parts():
            frequent = np.unique(g.context[at][g.hot[at]])
            rows.append((p, c.number, pack_grams(level, g.context[at], g.word[at]), pack(counts[at]), join(pack(told[at]), pack_sorted(frequent))))
        return blocks(rows)

    return run


def of_kind(t: pa.Table, kind: int) -> pa.Table:
    return t.filter(pa.array(np.array(t.column("kind").to_pylist()) == kind))


def join(a: bytes, b: bytes) -> bytes:
    return len(a).to_bytes(8, "big") + a + b


def apart(x: bytes) -> tuple[bytes, bytes]:
    n = int.from_bytes(x[:8], "big")
    return x[8 : 8 + n], x[8 + n :]


def backoff(cells: np.ndarray, seen: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weight, scale) of contexts. ``cells``: successors with count 1..K, then the sum of larger counts; ``seen``: sum of
    the word probabilities of all successors seen.

    A context whose counts are all undiscounted would leave nothing; it gives 1 / (total + 1) by scaling its bigrams.
    """
    r = np.arange(1, K + 1)
    total = cells[:, :K] @ r + cells[:, K]
    kept = cells[:, :K] @ (r * factor[1 : K + 1]) + cells[:, K] * factor[K + 1]
    t = np.maximum(total, 1)
    scale = np.where((total > 0) & (kept > t * (1 - 1e-12)), t / (t + 1.0), 1.0)
    return np.where(total > 0, 1 - scale * kept / t, 1.0) / np.maximum(1 - seen, 1e-300), scale


def gram_table(level: int, w: Words):
    """Of one partition, to every chunk: ``counts``, totals in the block's order; ``other``, cells and sums (see
    :func:`backoff`) of the block's contexts in order, zero where the chunk cannot need them. Chunk -1: counts of counts, and
    this partition's share of the cells and sums of frequent contexts, which no block gets."""

    def run(t: pa.Table) -> pa.Table:
        p = t.column("p")[0].as_py()
        grams = [unpack_grams(level, x.as_py()) for x in t.column("keys")]
        counts = np.concatenate([unpack(x.as_py()) for x in t.column("counts")])
        other = [apart(x.as_py()) for x in t.column("other")]
        keys, contexts = keyed(level, *(np.concatenate(x) for x in zip(*grams, strict=True)))
        table, first, where = np.unique(keys, return_index=True, return_inverse=True)
        total = np.bincount(where, weights=counts, minlength=len(table)).astype(np.int64)
        lower = np.concatenate([unpack(a) for a, _ in other])[first]
        lower = np.where(total > 0, w.p(lower) if level == 2 else lower, 0.0)
        frequent = np.unique(np.concatenate([unpack_sorted(b) for _, b in other]))

        context, group = np.unique(table >> np.uint64(32), return_inverse=True)
        context = context if contexts is None else contexts[context]
        seen = np.bincount(group, weights=lower, minlength=len(context))
        cells = np.stack([np.bincount(group[total == r], minlength=len(context)) for r in range(1, K + 1)] + [np.bincount(group, weights=np.where(total > K, total, 0), minlength=len(context)).astype(np.int64)], axis=1).astype(np.int64)
        hot = np.isin(context, frequent)
        rows = [(p, -1, pack_sorted(context[hot]), pack(count_of_counts(total)), join(pack(cells[hot].reshape(-1)), pack(seen[hot])))]
        whole = (cells[:, :K].sum(axis=1) == 0) & (cells[:, K] > 0)
        at = 0
        for k, chunk in enumerate(t.column("chunk").to_pylist()):
            own = where[at : at + len(grams[k][1])]
            at += len(own)
            mine = np.unique(group[own])
            send = (np.isin(mine, group[own[total[own] == 0]]) | whole[mine]) & ~hot[mine]
            rows.append((p, chunk, b"", pack(total[own]), join(pack((cells[mine] * send[:, None]).reshape(-1)), pack(seen[mine] * send))))
        return blocks(rows)

    return run


def descend(c: Chunk, right: pa.Table, totals: np.ndarray, ids: np.ndarray, n: int, hot_from: int, w: Words, models: list[tuple]) -> tuple[np.ndarray | None, np.ndarray]:
    """Of every token of a chunk: the total of its longest n-gram (none for words alone) and its probability by the levels in ``models``."""
    below, p = None, w.p(totals[c.tokens])
    for level, (factor, frequent) in enumerate(models, 2):
        g = Grams(level, c, totals, ids, n, hot_from, below)
        seen = np.zeros(len(g.word), np.int64)
        weight, scale = np.ones(len(seen)), np.ones(len(seen))
        told = of_kind(right, level)
        got = {x: k for k, x in enumerate(told.column("p").to_pylist())}
        for x, at in g.parts():
            seen[at] = unpack(told.column("counts")[got[x]].as_py())
            cells, sums = apart(told.column("other")[got[x]].as_py())
            _, group = np.unique(g.context[at], return_inverse=True)
            each = backoff(unpack(cells).reshape(-1, K + 1), unpack(sums), factor)
            weight[at], scale[at] = each[0][group], each[1][group]
        hot_context, hot_weight, hot_scale = frequent
        if len(hot_context):
            place = np.minimum(np.searchsorted(hot_context, g.context), len(hot_context) - 1)
            is_hot = hot_context[place] == g.context
            weight[is_hot], scale[is_hot] = hot_weight[place[is_hot]], hot_scale[place[is_hot]]
        known = scale * factor[np.minimum(seen, K + 1)] * seen / np.maximum(g.followers, 1)
        p = np.where(seen > 0, known, weight * p[g.first])[g.where]
        below = seen[g.where]
    return below, p


CELLS = [f"c{r}" for r in range(1, K + 2)]
SHARES = "context long, " + ", ".join(f"{c} long" for c in CELLS) + ", seen double"


def frequent_shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per frequent context of a partition's share: cells and sum, to be added up over the partitions."""
    for b in batches:
        for keys, other in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            cells, seen = map(unpack, apart(other))
            columns = [unpack_sorted(keys).view(np.int64), *cells.reshape(-1, K + 1).T, seen]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], names=["context", *CELLS, "seen"])


def fit_and_score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = 2) -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row, in no order. ``order``: words of the longest
    n-grams, two or three.

    Null and empty texts hold the end token alone; rows with one id are scored each; without a training document every
    token is unknown with probability 1; an empty table gives no row. The id must be an integer or null.
    """
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    spark = docs.sparkSession
    kind = docs.select(F.col(f"`{id_col}`")).schema[0].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{id_col} must be an integer column")
    chunks = Stored(encode(docs, id_col, text_col), "katz-chunks")
    n = max(tasks(spark), chunks.df.count() // PART_CHUNKS)
    asked = chunks.df.mapInArrow(word_requests(n), BLOCK)
    word = Stored(asked.groupBy("p").applyInArrow(word_table(n), BLOCK), "katz-words")
    each = [unpack(bytes(r[0])) for r in word.df.filter("chunk = -1").select("counts").collect()]  # one a partition
    stats = np.sum(each, axis=0) if each else np.zeros(K + 3, np.int64)
    w = Words(stats)
    hot_from = max(1, w.total // (HOT * n))
    told = word.df.filter("chunk >= 0").withColumn("kind", F.lit(0))

    models: list[tuple] = []
    for level in range(2, order + 1):
        request = chunks.df.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(requests(level, n, hot_from, w, list(models)), BLOCK)
        answer = Stored(request.groupBy("p").applyInArrow(gram_table(level, w), BLOCK), f"katz-level-{level}")
        own = answer.df.filter("chunk = -1").select("keys", "counts", "other")  # of every partition
        types = [unpack(bytes(r[0])) for r in own.select("counts").collect()]
        factor = discounts(np.sum(types, axis=0) if types else np.zeros(K + 1, np.int64))
        sums = own.mapInArrow(frequent_shares, SHARES).groupBy("context").agg(*[F.sum(c).alias(c) for c in CELLS], F.sum("seen").alias("seen"))
        rows = [tuple(r) for r in sums.collect()]  # at most HOT * n contexts
        at = np.array([r[0] for r in rows], np.int64).view(np.uint64)
        rows = [rows[k] for k in np.argsort(at)]
        models.append((factor, (np.sort(at), *backoff(np.array([r[1:-1] for r in rows], np.int64).reshape(-1, K + 1), np.array([r[-1] for r in rows], float), factor))))
        told = told.union(answer.df.filter("chunk >= 0").withColumn("kind", F.lit(level)))

    out = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = chunks.df.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(evaluate(n, hot_from, w, models), out)
    return scored.select(F.col("id").cast(kind).alias(id_col), *[c.split()[0] for c in out.split(", ")[1:]])


def evaluate(n: int, hot_from: int, w: Words, models: list[tuple]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        c = Chunk(left)
        totals, ids = answers(of_kind(right, 0), c, n)
        _, p = descend(c, right, totals, ids, n, hot_from, w, models)
        docs = len(c.lengths)
        add = lambda x: np.bincount(c.doc, weights=x, minlength=docs)
        base = np.log10((totals + 1) / (w.total + w.types + 1))
        return pa.table(
            {
                "id": pa.array(c.ids, pa.int64()),
                "held_out": pa.array(c.held),
                "n_tokens": pa.array(c.lengths.astype(np.int64)),
                "n_known": pa.array(add((totals > 0)[c.tokens]).astype(np.int64)),
                "train_tokens": pa.array(np.full(docs, w.total)),
                "base_score": pa.array(add(base[c.tokens])),
                "score": pa.array(add(np.log10(p))),
            }
        )

    return run
