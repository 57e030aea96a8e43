"""Line dedup by an exact set-similarity join.

A line is its set of words. Of lines with equal sets all but the first go (order: document id, line, place of the row); of
the first ones, a line goes if an earlier line has Jaccard similarity ``SIMILARITY`` or more. The join orders every line's
words by rarity and keeps the prefix that a similar line must touch (a shorter one for the smaller line of a pair), pairs
lines of compatible sizes that share a prefix word, drops pairs whose positions leave too little overlap, and verifies the
rest word by word. Sets of fewer than ``JOINED`` words are similar to their equals only (3 of 4 words are under 4 in 5), so the
join leaves them out; only lines without a word are left alone.

Words whose frequency passes ``HOT_WORD`` are no keys of their own, for a group of all lines with one would grow with the corpus and its pairs
with the square: similar lines share two words of a prefix that is one word longer, so if the rarest shared one is hot, all are, and
lines meet at the pair of the two rarest.

Rarity is the frequency of a word's hash among 2**20 cells: any total order gives the exact join, this one has a fixed size.
Words travel as 64-bit hashes. The corpus is encoded once into chunks in the shared folder; postings travel as sorted,
compressed blocks from chunks to partitions of words, and so do pairs and the lines to verify them, from chunk to chunk.
The chunks are bucketed by their number and do not travel again. A line goes on one similar earlier line, so each is held against its
closest candidate first, and only lines that this leaves are held against their other candidates. Of a line with over ``OTHERS`` candidates in
a partition the closest alone is noted, for the pairs of a large group of similar lines grow with its square; if lines of that kind are left,
their candidates are formed once more, all of them, from lines that hold a word of a cell in which such a line has a prefix word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lodestone.llm.katz import by_part, mixed, pack, pack_sorted, unpack, unpack_sorted
from lodestone.llm.store import Stored, fresh, tasks

SIMILARITY = (4, 5)
#: Different words of a line that can be similar to one with another set; of one whose parity takes 128 bits.
JOINED, WIDE = 4, 64
CHUNK_WORDS = 1 << 20
#: Bytes of text that are split at a time; a word's bytes from which its hash is XXH64.
SLICE, LONG = 1 << 19, 64
#: Occurrences (of a word's cell) from which a word is a key only together with another.
HOT_WORD = 1 << 14
CELL_BITS, CELL_PARTS = 20, 16
#: Candidates of a line in a partition that are noted before it is known whether the closest settles it.
OTHERS = 32
#: Pairs a task forms at a time.
PAIRS = 1 << 18

CHUNK = "chunk long, ids array<long>, n_lines binary, doc binary, line binary, sizes binary, words binary, dictionary binary"
_T, _U = SIMILARITY
#: The bytes of words, and masks of the first bytes of eight.
_WORDY = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _batch(row: dict, schema: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(row, schema=pa.schema(schema))


def _stirred(x: np.ndarray) -> np.ndarray:
    """A mixing of 64 bits that loses none of them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64 bits of every word, taken eight bytes at a time; those of ``LONG`` bytes or more by XXH64."""
    eights = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    h, at, k = _stirred(sizes.astype(np.uint64)), np.flatnonzero(sizes < LONG), 0
    while len(at):
        h[at] = _stirred(h[at] ^ (eights[starts[at] + k] & _FIRST[np.minimum(sizes[at] - k, 8)]))
        k += 8
        at = at[sizes[at] > k]
    for i in np.flatnonzero(sizes >= LONG).tolist():
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + sizes[i]])
    return h


def _distinct(a: np.ndarray) -> np.ndarray:
    """What ``np.unique`` gives, which is many times slower as it hashes."""
    a = np.sort(a)
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    return a[new]


def _cut(data: np.ndarray, bounds: np.ndarray, lo: int) -> int:
    """Where a slice from ``lo`` ends: with a document within ``SLICE`` bytes, else with a line, else where the line ends."""
    k = int(np.searchsorted(bounds, lo + SLICE, side="right"))
    if bounds[k - 1] > lo:
        return int(bounds[k - 1])
    end, hi = int(bounds[k]), lo + SLICE
    feeds = np.flatnonzero(data[lo:hi] == 10)
    if len(feeds):
        return lo + int(feeds[-1]) + 1
    while hi < end:
        feeds = np.flatnonzero(data[hi : min(hi + SLICE, end)] == 10)
        if len(feeds):
            return hi + int(feeds[0]) + 1
        hi += SLICE
    return end


def line_words(texts: pa.Array) -> Iterator[tuple]:
    """The lines with a word of texts, by slices of whole lines: number of documents begun so far, whether the last one ends; of each line its
    document, number and size; the number of every different word of it, and the hashes of the numbers."""
    texts = texts.fill_null(b"").cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo, fed, before = int(bounds[0]), 0, np.zeros(len(texts), np.int64)  # line feeds up to here, and up to where a document starts
    while lo < bounds[-1]:
        hi = _cut(data, bounds, lo)
        first, last = np.searchsorted(bounds[:-1], [lo, hi])  # documents that start here
        x = data[lo:hi]
        wordy = _WORDY[x]
        edges = bounds[first:last] - lo
        starts, ends = wordy.copy(), wordy.copy()
        starts[1:] &= ~wordy[:-1]
        ends[:-1] &= ~wordy[1:]
        inner = edges[(edges > 0) & (edges < len(x))]  # words do not cross documents
        starts[inner], ends[inner - 1] = wordy[inner], wordy[inner - 1]
        starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        feeds = np.flatnonzero(x == 10)
        before[first:last] = fed + np.searchsorted(feeds, edges)
        doc = np.searchsorted(bounds, starts + lo, side="right") - 1
        line = fed + np.searchsorted(feeds, starts) - before[doc]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])
        hashes, place = np.unique(_hashed(x, starts, ends - starts), return_inverse=True)
        owner, v = np.cumsum(new) - 1, max(len(hashes), 1)
        words = _distinct(owner * v + place)
        owner = words // v
        yield int(last), hi in bounds[last : last + 1], doc[new], line[new], np.bincount(owner), words - owner * v, hashes
        lo, fed = hi, fed + len(feeds)


def encode(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per chunk: document ids and line counts; per line with a word its document, number, size and word numbers."""
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), 0
        fields = [("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), *[(c, pa.binary()) for c in ("n_lines", "doc", "line", "sizes", "words", "dictionary")]]
        ids, held, n_words = [], [], 0

        def flush():
            doc, line, sizes, words, hashes = (np.concatenate(x) for x in zip(*held, strict=True)) if held else [np.empty(0, np.int64)] * 5
            dictionary, place = np.unique(hashes.astype(np.uint64), return_inverse=True)
            row = {"n_lines": np.bincount(doc, minlength=len(ids)), "doc": doc, "line": line, "sizes": sizes, "words": place[words]}
            packed = {k: [pack(v.astype(np.int32))] for k, v in row.items()}
            return _batch({"chunk": [(part << 32) | serial], "ids": [ids], **packed, "dictionary": [pack_sorted(dictionary)]}, fields)

        for b in batches:
            known, taken, base = b.column(0).to_pylist(), 0, len(ids)
            for until, whole, doc, line, sizes, words, hashes in line_words(b.column(1)):
                held.append((doc + base, line, sizes, words + sum(len(x[-1]) for x in held), hashes))
                ids += known[taken:until]
                taken, n_words = until, n_words + len(words)
                if whole and n_words >= CHUNK_WORDS:
                    yield flush()
                    serial, ids, held, n_words, base = serial + 1, [], [], 0, -until
            ids += known[taken:]
        if ids:
            yield flush()

    return source.mapInArrow(run, CHUNK)


class Chunk:
    def __init__(self, t):
        get = lambda c: t.column(c)[0].as_py()
        self.number, self.ids = get("chunk"), get("ids")
        self.doc, self.line, self.sizes, self.words = (unpack(get(c)) for c in ("doc", "line", "sizes", "words"))
        self.dictionary = unpack_sorted(get("dictionary"))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def hashes(self, k: int) -> np.ndarray:
        return self.dictionary[self.words[self.starts[k] : self.starts[k] + self.sizes[k]]]


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    for b in batches:
        for k in range(b.num_rows):
            yield Chunk(b.slice(k, 1))


def cell(hashes: np.ndarray) -> np.ndarray:
    return (mixed(hashes) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _over_cells(rows: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of what ``of`` counts in the cells for each row; the driver gets 2**20 numbers."""
    span = (1 << CELL_BITS) // CELL_PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELL_BITS, np.int64)
        for b in batches:
            for k in range(b.num_rows):
                total += of(b.slice(k, 1))
        if total.any():
            yield _batch({"p": list(range(CELL_PARTS)), "counts": [pack(total[p * span : (p + 1) * span]) for p in range(CELL_PARTS)]}, [("p", pa.int32()), ("counts", pa.binary())])

    def add(t: pa.Table) -> pa.Table:
        return pa.table({"p": t.column("p").slice(0, 1), "counts": pa.array([pack(np.sum([unpack(x.as_py()) for x in t.column("counts")], axis=0))], pa.binary())})

    out = np.zeros(1 << CELL_BITS, np.int64)
    for r in rows.mapInArrow(run, "p int, counts binary").groupBy("p").applyInArrow(add, "p int, counts binary").collect():
        out[r[0] * span : (r[0] + 1) * span] = unpack(bytes(r[1]))
    return out


def cell_counts(chunks: DataFrame) -> np.ndarray:
    """How often the words of each cell occur."""

    def of(t: pa.RecordBatch) -> np.ndarray:
        c = Chunk(t)
        return np.bincount(cell(c.dictionary), weights=np.bincount(c.words, minlength=len(c.dictionary)), minlength=1 << CELL_BITS).astype(np.int64)

    return _over_cells(chunks, of)


def asked_cells(more: DataFrame) -> np.ndarray:
    """Whether a cell holds a prefix word of a line whose candidates are formed once more."""
    return _over_cells(more.select("wanted"), lambda t: np.bincount(unpack(t.column("wanted")[0].as_py()), minlength=1 << CELL_BITS)) > 0


LINES = "h1 long, h2 long, id long, line int, chunk long, k int, doc int"


def line_rows(chunks: DataFrame) -> DataFrame:
    """A row per line with a word: 128 bits of its set, and its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _each(batches):
            n = len(c.sizes)
            if not n:
                continue
            h = mixed(c.dictionary)[c.words]
            h1, h2 = (np.add.reduceat(x, c.starts).view(np.int64) for x in (h, mixed(h ^ np.uint64(0xA5A5A5A5A5A5A5A5))))
            ids = pa.array(c.ids, pa.int64()).take(pa.array(c.doc))
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), ids, pa.array(c.line), pa.array(np.full(n, c.number)), pa.array(np.arange(n, dtype=np.int32)), pa.array(c.doc)], names=[x.split()[0] for x in LINES.split(", ")])

    return chunks.mapInArrow(run, LINES)


POSTED = ("keys", "k", "size", "place", "parity", "upper", "id", "null", "line", "asked")
POSTINGS = "p int, chunk long, " + ", ".join(f"{c} binary" for c in POSTED)


def _ceil(a: np.ndarray, b: int) -> np.ndarray:
    return -(-a // b)


def _prefix(size: np.ndarray) -> np.ndarray:
    return size - _ceil(size.astype(np.int64) * _T, _U) + 1


def _by_rarity(c: Chunk, at: np.ndarray, cells) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of the lines ``at`` in rarity order: the owner's place in ``at``, the word's number, its position."""
    owner, place = _expand(c.starts[at], c.sizes[at])
    known = c.words[place]
    here = np.zeros(len(c.dictionary), bool)
    here[known] = True
    here = np.flatnonzero(here)
    rarity = here[np.argsort(cells.value[cell(c.dictionary[here])] * max(len(here), 1) + np.arange(len(here)))]  # the dictionary is in order
    rank, v = np.empty(len(c.dictionary), np.int64), max(len(here), 1)
    rank[rarity] = np.arange(len(rarity))
    key = np.sort(owner * v + rank[known])
    return owner, rarity[key - owner * v], place - c.starts[at][owner]


def postings(n: int, cells, wanted=None):
    """Prefix words of a chunk's first lines. ``place`` is the word's position in rarity order. With ``wanted`` only words in these cells, and
    ``asked`` tells the lines that are ``more``."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            c = Chunk(left)
            use = np.zeros(len(c.sizes), bool)
            use[np.array(right.column("ks")[0].as_py())] = True
            use &= c.sizes >= JOINED
            of = cell(c.dictionary)
            keyed = wanted.value[of] if wanted else np.ones(len(of), bool)
            if wanted:
                use &= np.logical_or.reduceat(keyed[c.words], c.starts)
            if not use.any():
                return _table(rows, ("p", "chunk", *POSTED), (pa.int32(), pa.int64(), *[pa.binary()] * len(POSTED)))
            lines = np.flatnonzero(use)
            size = c.sizes[lines].astype(np.int64)
            owner, words, place = _by_rarity(c, lines, cells)
            starts = np.cumsum(size) - size
            bit = mixed(c.dictionary) >> np.uint64(57)
            flips = np.uint64(1) << (bit & np.uint64(63))
            parity = np.bitwise_xor.reduceat(flips[words], starts)
            upper = np.bitwise_xor.reduceat(np.where(bit > 63, flips, np.uint64(0))[words], starts)
            prefix = _prefix(size)[owner]
            take = np.flatnonzero(place < prefix)
            take = take[keyed[words[take]]]
            hot = (cells.value[of] > HOT_WORD)[words[take]]
            single, at = take[~hot], take[hot]
            one, step = _expand(at + 1, prefix[at] - place[at])  # with every later word of the longer prefix
            one, step = one[keyed[words[step]]], step[keyed[words[step]]]
            pair = at[one]
            first, second = c.dictionary[words[pair]], c.dictionary[words[step]]
            h = np.concatenate([c.dictionary[words[single]], mixed(first ^ mixed(second))])
            at = np.concatenate([single, pair])
            asked = np.zeros(len(c.sizes), np.int32)
            if wanted and right.column("more")[0].as_py() is not None:
                asked[unpack(right.column("more")[0].as_py())] = 1
            ids, null = np.array([i or 0 for i in c.ids], np.int64), np.array([i is None for i in c.ids], np.int8)
            own, place = owner[at], place[at]
            k, size, parity, upper = lines[own], size[own], parity[own], upper[own]
            for p, at in by_part((mixed(h) % np.uint64(n)).astype(np.int64), n):
                at = at[np.argsort(h[at])]
                doc = c.doc[k[at]]
                small = (x.astype(np.int32) for x in (k[at], size[at], place[at]))
                told = pack(asked[k[at]]) if wanted else b""
                rows.append((p, c.number, pack_sorted(h[at]), *map(pack, small), pack(parity[at]), pack(upper[at][size[at] > WIDE]), pack(ids[doc]), pack(null[doc]), pack(c.line[k[at]]), told))
        return _table(rows, ("p", "chunk", *POSTED), (pa.int32(), pa.int64(), *[pa.binary()] * len(POSTED)))

    return run


PAIRED = ("b", "a_chunk", "a", "best")
PAIRS_OF = "b_chunk long, " + ", ".join(f"{c} binary" for c in PAIRED)


def _order(*keys: np.ndarray) -> np.ndarray:
    """The order by integer keys, the last one first; as many as 63 bits hold are sorted as one number."""
    packed, used = [], 64
    for a in keys:
        least = int(a.min())
        width = (int(a.max()) - least).bit_length()
        if used + width > 63:
            packed, used = [*packed, np.zeros(len(a), np.int64)], 0
        packed[-1] = packed[-1] + ((a - least) << used) if width < 64 else a
        used += width
    return np.lexsort(packed) if len(packed) > 1 else np.argsort(packed[0])


def candidates(t: pa.Table, again: bool = False) -> pa.Table:
    """Pairs of a partition's lines that pass the prefix, length, positional and parity filters, each once a partition: all of a ``b`` with up to
    ``OTHERS`` of them, else the closest. ``again``: all of those that are asked for.

    ``parity`` flips one of 64 bits a word; lines differ in at least as many words as their parities differ in bits. Lines of over
    ``WIDE`` words have 128: the ``upper`` half and, in ``parity``, both halves folded.

    ``a`` is the earlier line, ``b`` the later one, and ``best`` marks the pair of a ``b`` with the closest parities, by 2 if others
    are left out. Lines of a word are
    taken in order of size, so the partners of one are a stretch behind it.
    """
    keys = [unpack_sorted(x.as_py()) for x in t.column("keys")]
    k, size, place, ids, null, line = (np.concatenate([unpack(x.as_py()) for x in t.column(c)]).astype(np.int64) for c in ("k", "size", "place", "id", "null", "line"))
    asked = np.concatenate([unpack(x.as_py()) for x in t.column("asked")]) if again else np.zeros(len(k), np.int32)
    chunks, chunk = np.unique(t.column("chunk").to_numpy(), return_inverse=True)
    chunk = np.repeat(chunk, [len(x) for x in keys])
    parity, some = (np.concatenate([unpack(x.as_py()) for x in t.column(c)]) for c in ("parity", "upper"))
    upper = np.zeros(len(parity), np.uint64)
    upper[size > WIDE] = some
    # Lines in their order: number of each, and what is known of it.
    order = _order(k, chunk, line, ids, -null)
    new = np.ones(len(order), bool)
    new[1:] = (k[order[1:]] != k[order[:-1]]) | (chunk[order[1:]] != chunk[order[:-1]])
    own, one = np.empty(len(order), np.int64), order[new]
    own[order] = np.cumsum(new) - 1
    lines, of, number, wide, asked = len(one), chunks[chunk[one]], k[one], size[one] > WIDE, asked[one] > 0
    upper, parity = upper[one], parity[one]
    lower = parity ^ upper
    _, word = np.unique(np.concatenate(keys), return_inverse=True)
    order = _order(own, size, word)
    word, size, place, own = word[order], size[order], place[order], own[order]
    # Larger partners: same word, later in the order, size at most size * U / T.
    most = int(size.max()) * _U // _T + 2 if len(size) else 1
    at = word * most
    until = np.searchsorted(at + size, at + size * _U // _T, side="right")
    index = place < size - _ceil(size * 2 * _T, _T + _U) + 1  # the smaller line of a pair needs this shorter prefix only
    many = np.where(index, until - np.arange(len(word)) - 1, 0)
    ends = np.cumsum(many)
    left = size - place  # words from this one on

    def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        full = np.bitwise_count(lower[a] ^ lower[b]) + np.bitwise_count(upper[a] ^ upper[b])
        return np.where(wide[a] & wide[b], full, np.bitwise_count(parity[a] ^ parity[b]))

    def passed(small: np.ndarray, large: np.ndarray) -> np.ndarray:
        both = size[small] + size[large]
        need = _ceil(both * _T, _T + _U)
        ok = np.flatnonzero(np.minimum(left[small], left[large]) >= need)
        a, b, most = own[small[ok]], own[large[ok]], (both - 2 * need)[ok]
        ok = np.bitwise_count(parity[a] ^ parity[b]) <= most
        a, b, most = a[ok], b[ok], most[ok]
        ok = apart(a, b) <= most
        pair = _distinct(np.maximum(a, b)[ok] * lines + np.minimum(a, b)[ok])
        return pair[asked[pair // max(lines, 1)]] if again else pair

    none = np.iinfo(np.int64).max
    found, held, start, noted, closest = np.empty(0, np.int64), [], 0, np.zeros(lines, np.int64), np.full(lines, none)
    while start < len(many):
        stop = max(int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, side="right")), start + 1)
        m = many[start:stop]
        small = np.repeat(np.arange(start, stop), m)
        pair = passed(small, small + 1 + np.arange(len(small)) - np.repeat(np.cumsum(m) - m, m))
        if not again:
            late, early = pair // max(lines, 1), pair % max(lines, 1)
            np.minimum.at(closest, late, apart(late, early).astype(np.int64) << 32 | early)
            np.add.at(noted, late, 1)  # a pair of two words twice, which only leaves others for later
            pair = pair[noted[late] <= OTHERS]
        held.append(pair)
        start = stop
        if sum(map(len, held)) > PAIRS or start == len(many):
            found, held = _distinct(np.concatenate([found, *held])), []
            found = found if again else found[noted[found // max(lines, 1)] <= OTHERS]
    late = np.flatnonzero(closest < none)
    pair = _distinct(np.concatenate([found, late * lines + (closest[late] & 0xFFFFFFFF)]))
    late, early = pair // max(lines, 1), pair % max(lines, 1)
    best = np.where((closest[late] & 0xFFFFFFFF) == early, 1 + (noted[late] > OTHERS), 0).astype(np.int8)
    best[closest[late] == none] = 0
    order = np.lexsort((early, late, of[late]))
    late, early, best = late[order], early[order], best[order]
    rows = [(c, pack(number[late[lo:hi]]), pack(of[early[lo:hi]]), pack(number[early[lo:hi]]), pack(best[lo:hi])) for c, lo, hi in _stretches(of[late])]
    return _table(rows, ("b_chunk", *PAIRED), (pa.int64(), *[pa.binary()] * len(PAIRED)))


ROUTED = "a_chunk long, a binary, b_chunk binary, b binary, others binary"


def _routed(t: pa.Table, best: int, gone: np.ndarray) -> pa.Table:
    """The best pairs of a table of pairs, or the others whose ``b`` is not gone yet, by the chunk of ``a``. ``others``: further ones of ``b`` were left out."""
    rows = []
    if t.num_rows:
        b, a_chunk, a, is_best = ([unpack(x.as_py()) for x in t.column(c)] for c in PAIRED)
        b_chunk = np.repeat(t.column("b_chunk").to_numpy(), [len(x) for x in b])
        b, a_chunk, a, is_best = map(np.concatenate, (b, a_chunk, a, is_best))
        take = np.flatnonzero(((is_best > 0) == best) & ~np.isin(b, gone))
        take = take[np.argsort(a_chunk[take], kind="stable")]
        rows = [(chunk, *(pack(x[take[lo:hi]]) for x in (a, b_chunk, b, (is_best > 1).astype(np.int8)))) for chunk, lo, hi in _stretches(a_chunk[take])]
    return _table(rows, ("a_chunk", "a", "b_chunk", "b", "others"), (pa.int64(), *[pa.binary()] * 4))


def best_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from _routed(pa.Table.from_batches([b]), 1, np.empty(0, np.int32)).to_batches()


def other_pairs(left: pa.Table, right: pa.Table) -> pa.Table:
    gone = [unpack(x.as_py()) for x in right.column("gone")] if right.num_rows else []
    return _routed(left, 0, np.concatenate([np.empty(0, np.int32), *gone]))


def _stretches(a: np.ndarray) -> Iterator[tuple]:
    """Value, start and end of the stretches of equal values."""
    starts = np.flatnonzero(np.diff(a, prepend=a[:1] - 1)) if len(a) else a
    yield from zip(a[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(a)], strict=False)


def _table(rows: list[tuple], names: tuple, kinds: tuple) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.table([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=list(names))


def _expand(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and place of every element of the stretches."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) + (starts - (np.cumsum(sizes) - sizes))[owner]


PACKED = ("sizes", "words", "dictionary", "which", "b", "others")
SHIPPED = "b_chunk long, " + ", ".join(f"{c} binary" for c in PACKED)


def ship(left: pa.Table, right: pa.Table) -> pa.Table:
    """For every chunk that holds lines ``b``, one row with the lines ``a`` to hold against them: words and the pairs."""
    rows = []
    if left.num_rows and right.num_rows:
        c = Chunk(left)
        a, to, b, others = (np.concatenate([unpack(x.as_py()) for x in right.column(n)]) for n in ("a", "b_chunk", "b", "others"))
        order = np.lexsort((others, b, a, to))[::-1]  # of equal pairs the one with others first
        a, to, b, others = a[order], to[order], b[order], others[order]
        new = (np.diff(a, prepend=-1) != 0) | (np.diff(b, prepend=-1) != 0) | (np.diff(to, prepend=to[:1] - 1) != 0)
        a, to, b, others = a[new], to[new], b[new], others[new]
        for chunk, lo, hi in _stretches(to):
            k, which = np.unique(a[lo:hi], return_inverse=True)
            _, at = _expand(c.starts[k], c.sizes[k])
            known, words = np.unique(c.words[at], return_inverse=True)
            rows.append((chunk, pack(c.sizes[k]), pack(words.astype(np.int32)), pack_sorted(c.dictionary[known]), pack(which.astype(np.int32)), pack(b[lo:hi].astype(np.int32)), pack(others[lo:hi])))
    return _table(rows, ("b_chunk", *PACKED), (pa.int64(), *[pa.binary()] * len(PACKED)))


GONE = "chunk long, doc int, line int"
#: Pairs verified at a time.
VERIFIED = 1 << 15


def _similar(c: Chunk, right: pa.Table) -> np.ndarray:
    """The lines ``b`` of the chunk that are similar to an earlier line they are told of."""
    out, v = [np.empty(0, np.int32)], max(len(c.dictionary), 1)
    for r in range(right.num_rows):
        if right.column("words")[r].as_py() is None:
            continue
        t = {x: unpack(right.column(x)[r].as_py()) for x in PACKED if x != "dictionary"}
        told = unpack_sorted(right.column("dictionary")[r].as_py())
        at = np.minimum(np.searchsorted(c.dictionary, told), v - 1)
        here = np.where(c.dictionary[at] == told, at, -1)  # the shipped words by the numbers they have here
        starts = np.cumsum(t["sizes"]) - t["sizes"]
        for lo in range(0, len(t["b"]), VERIFIED):
            a, b = t["which"][lo : lo + VERIFIED], t["b"][lo : lo + VERIFIED]
            one, place = _expand(starts[a], t["sizes"][a])
            word = here[t["words"][place]]
            two, other = _expand(c.starts[b], c.sizes[b])
            both = np.intersect1d((one * v + word)[word >= 0], two * v + c.words[other], assume_unique=True)
            shared = np.bincount(both // v, minlength=len(b))
            out.append(b[shared * _U >= (t["sizes"][a].astype(np.int64) + c.sizes[b] - shared) * _T])
    return np.unique(np.concatenate(out))


FOUND = "chunk long, gone binary, more binary, wanted binary"


def verify(cells):
    """Lines that are gone; ``more``, those that are not though candidates of theirs were left out, and the cells of words in their longer prefixes."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            gone = _similar(c := Chunk(left), right)
            b, others = (np.concatenate([unpack(x.as_py()) for x in right.column(n)]) for n in ("b", "others"))
            more = np.setdiff1d(b[others > 0], gone)
            told = [None, None]
            if len(more):
                owner, words, place = _by_rarity(c, more, cells)
                told = [pack(more.astype(np.int32)), pack(np.unique(cell(c.dictionary[words[place <= _prefix(c.sizes[more])[owner]]])))]
            rows = [(c.number, pack(gone.astype(np.int32)), *told)] if len(gone) or len(more) else []
        return _table(rows, ("chunk", "gone", "more", "wanted"), (pa.int64(), *[pa.binary()] * 3))

    return run


def removed(left: pa.Table, right: pa.Table) -> pa.Table:
    """Lines to remove: those found before, those similar to a line told now, and those that are not a set's first."""
    rows = np.empty((0, 3), np.int64)
    if left.num_rows:
        c = Chunk(left)
        gone = np.ones(len(c.sizes), bool)
        for ks in right.column("ks").to_pylist():
            if ks is not None:
                gone[np.array(ks)] = False
        for x in right.column("gone").to_pylist():
            if x is not None:
                gone[unpack(x)] = True
        gone[_similar(c, right)] = True
        rows = np.stack([np.full(int(gone.sum()), c.number), c.doc[gone], c.line[gone]], axis=1)
    return pa.table({"chunk": pa.array(rows[:, 0]), "doc": pa.array(rows[:, 1].astype(np.int32)), "line": pa.array(rows[:, 2].astype(np.int32))})


DOCS = "chunk long, doc int, id long, n_lines int"


def doc_rows(chunks: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, ids, n_lines in zip(*(x.to_pylist() for x in b.columns), strict=True):
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), pa.array(np.arange(n, dtype=np.int32)), pa.array(ids, pa.int64()), pa.array(unpack(n_lines))], names=["chunk", "doc", "id", "n_lines"])

    return chunks.select("chunk", "ids", "n_lines").mapInArrow(run, DOCS)


def removed_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_lines, n_removed, removed`` for every row: lines with a word, lines to remove, their numbers from 0 in
    order (splitting at line feeds).

    Null and empty texts have no lines; rows with one id are told apart by their place in the input, null ids come first;
    of repeated rows the first keeps its lines; an empty table gives no row. The id must be an integer.
    """
    spark = docs.sparkSession
    n = tasks(spark)
    kind = docs.select(F.col(f"`{id_col}`")).schema[0].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{id_col} must be an integer column")
    chunks = Stored(encode(docs, id_col, text_col), "lines-chunks", key="chunk").df
    firsts = line_rows(chunks).groupBy("h1", "h2").agg(F.min(F.struct("id", "line", "chunk", "k")).alias("f"))
    firsts = Stored(firsts.groupBy(F.col("f.chunk").alias("chunk")).agg(F.collect_list("f.k").alias("ks")), "lines-firsts").df

    cells = spark.sparkContext.broadcast(cell_counts(chunks))
    posted = chunks.groupBy("chunk").cogroup(firsts.groupBy("chunk")).applyInArrow(postings(n, cells), POSTINGS)
    pairs = Stored(posted.groupBy("p").applyInArrow(lambda t: candidates(t), PAIRS_OF), "lines-pairs").df
    send = lambda routed: chunks.groupBy("chunk").cogroup(routed.groupBy("a_chunk")).applyInArrow(ship, SHIPPED)
    best = send(pairs.mapInArrow(best_pairs, ROUTED))
    found = Stored(chunks.groupBy("chunk").cogroup(best.groupBy("b_chunk")).applyInArrow(verify(cells), FOUND), "lines-found").df
    more, found = found.filter("more IS NOT NULL").select("chunk", "more", "wanted"), found.select("chunk", "gone")
    if not more.isEmpty():
        wanted = spark.sparkContext.broadcast(asked_cells(more))
        posted = chunks.groupBy("chunk").cogroup(firsts.join(more.drop("wanted"), "chunk", "left").groupBy("chunk")).applyInArrow(postings(n, cells, wanted), POSTINGS)
        pairs = pairs.union(Stored(posted.groupBy("p").applyInArrow(lambda t: candidates(t, again=True), PAIRS_OF), "lines-more-pairs").df)
    told = send(pairs.groupBy("b_chunk").cogroup(found.groupBy("chunk")).applyInArrow(other_pairs, ROUTED))
    for known in (firsts, found):
        told = told.unionByName(known.withColumnRenamed("chunk", "b_chunk"), allowMissingColumns=True)
    gone = chunks.groupBy("chunk").cogroup(told.groupBy("b_chunk")).applyInArrow(removed, GONE)
    gone = gone.groupBy("chunk", "doc").agg(F.sort_array(F.collect_set("line")).alias("removed"))
    out = doc_rows(chunks).join(gone, ["chunk", "doc"], "left")
    lines = F.coalesce("removed", F.array().cast("array<int>"))
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("n_lines").cast("long").alias("n_lines"), F.size(lines).cast("long").alias("n_removed"), lines.alias("removed"))


def dedup_lines(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` without removed lines, same columns. A document that lost all its lines with a word goes; texts from which
    nothing is removed, null and empty ones included, come back unchanged.

    Rows are numbered in a stored copy; the number orders documents and is what the result is joined by, so rows with
    equal or null ids stay apart. "Earlier" therefore means earlier in the input.
    """
    row = fresh(docs, "line_row")
    held = Stored(docs.withColumn(row, F.monotonically_increasing_id()), "lines-docs").df
    order = fresh(held, "line_order")
    told = removed_lines(held.select(F.col(row), F.col(f"`{text_col}`").alias("text")), id_col=row, text_col="text")
    told = told.filter("n_removed > 0").select(F.col(row).alias(order), F.col("n_lines").alias(order + "_n"), F.col("removed").alias(order + "_gone"))
    joined = held.join(told, F.col(row) == F.col(order), "left")
    kept = F.filter(F.split(F.col(f"`{text_col}`"), "\n"), lambda x, k: ~F.array_contains(F.col(order + "_gone"), k))
    text = F.when(F.col(order).isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(kept, "\n"))
    joined = joined.filter(F.col(order).isNull() | (F.size(order + "_gone") < F.col(order + "_n"))).withColumn(text_col, text)
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns])
