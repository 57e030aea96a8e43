"""Benchmark decontamination: BM25 with block-max WAND over an inverted index of test items, then overlap checks.

The items form the index, every passage of every training text is a query. Impacts are BM25 contributions divided by the
item's score against itself, so 1 means "all of the item's words" and one threshold serves all items. A passage is first
held against the bound that its rarer words allow (an item's common words reach only part of the threshold, the rest must
come from its rarer ones); for passages that remain, block-max WAND retrieves every item above the threshold. A retrieved item
counts as leaked if enough 5-word shingles of its question part and of its answer part occur in the passage; or if nearly all
of the whole item's do, or all its words but for one place (an answer may be a word or two long, and one changed or glued word
must not clear a passage that holds the rest). Words are compared without punctuation at their ends.

Items are indexed in blocks of bounded bytes, one pass over the texts a block, so the benchmark may have any size. What BM25 needs of
all items (how many hold a word, how long they are on average) is counted over all of them first, so scores do not depend on the blocks.
"""

from __future__ import annotations

import bisect
import math
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_type

from lodestone.llm.store import Stored

K1, B = 1.2, 0.75
#: Share of an item's own score from which it is retrieved; share of shingles that must occur in the passage.
THRESHOLD, OVERLAP = 0.6, 0.8
SHINGLE = 5
#: Share of the whole item's shingles that is enough whatever its parts reach.
WHOLE = 0.9
#: Words of the item and of the passage at the one place where they may differ: changed, glued, split, lost, added.
EDITS = ((1, 1), (2, 1), (1, 2), (1, 0), (0, 1))
ASCII_MARKS = string.punctuation.encode()
_MARK = rb"(?:\xc2[\xa1\xa7\xab\xb6\xb7\xbb\xbf]|\xe2\x80[\x90-\xbf]|\xe2\x81[\x80-\x9e]|\xe3\x80[\x81-\x9f]|[!-/:-@\[-`{-~])+"
MARKS = re.compile(rb"\A" + _MARK + rb"|" + _MARK + rb"\Z")
#: An item's commonest words count as common up to this share of the threshold; the rest are looked up for every passage.
COMMON = 0.35
POSTINGS_BLOCK = 16
#: Bytes of item text in one index.
INDEX_BYTES = 4 << 20
WINDOW = 128


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def bare(w: list[bytes]) -> list[bytes]:
    """The words without punctuation at their ends; a word of nothing else stays as it is."""
    out = [x.strip(ASCII_MARKS) for x in w]
    for k, x in enumerate(out):
        if not x:
            out[k] = w[k]
        elif x[0] > 127 or x[-1] > 127:
            out[k] = MARKS.sub(b"", x) or w[k]
    return out


def shingles(w: list[bytes]) -> set[tuple[bytes, ...]]:
    """Of five words; a shorter part is one shingle of all its words, an empty one has none."""
    return {tuple(w[k : k + SHINGLE]) for k in range(max(len(w) - SHINGLE + 1, 1))} if w else set()


def parts(w: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """(question, answer): the answer is what follows the last word but one that ends a sentence; with one sentence only,
    the last quarter of the words."""
    ends = [k + 1 for k, x in enumerate(w[:-1]) if x[-1:] in b".?!:"]
    cut = ends[-1] if ends else len(w) - len(w) // 4
    return w[:cut], w[cut:]


class Index:
    """``items``: (id, text), of a block. Items without a word cannot leak and are left out. ``of_all``: number of items with a word in
    all blocks, their words, and how many hold each of this block's words; without it the block is all there is."""

    def __init__(self, items: list[tuple[object, str]], threshold: float = THRESHOLD, of_all: tuple[int, int, dict[bytes, int]] | None = None):
        self.threshold = threshold
        raw_items = [(i, w) for i, t in items if (w := words(t))]
        self.items = [(i, bare(w)) for i, w in raw_items]
        n = len(self.items)
        tf = [Counter(w) for _, w in self.items]
        count, total, df = of_all or (n, sum(len(w) for _, w in self.items), Counter(t for c in tf for t in c))
        mean = total / max(count, 1)
        idf = {t: math.log(1 + (count - d + 0.5) / (d + 0.5)) for t, d in df.items()}
        self.terms = {t: k for k, t in enumerate(sorted(df))}
        postings: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        rare: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        self.common = np.zeros(n)
        for j, c in enumerate(tf):
            length = K1 * (1 - B + B * len(self.items[j][1]) / mean)
            raw = {t: idf[t] * f * (K1 + 1) / (f + length) for t, f in c.items()}
            own = sum(raw.values())
            for t, x in sorted(raw.items(), key=lambda y: (y[1], y[0])):
                postings[self.terms[t]].append((j, x / own))
                if self.common[j] + x / own < threshold * COMMON:
                    self.common[j] += x / own
                else:
                    rare[self.terms[t]].append((j, x / own))
        self.docs = [[j for j, _ in p] for p in postings]
        self.impacts = [[x for _, x in p] for p in postings]
        self.most = [max(x) for x in self.impacts]
        self.block_last = [[d[min(k + POSTINGS_BLOCK, len(d)) - 1] for k in range(0, len(d), POSTINGS_BLOCK)] for d in self.docs]
        self.block_most = [[max(x[k : k + POSTINGS_BLOCK]) for k in range(0, len(x), POSTINGS_BLOCK)] for x in self.impacts]
        self.rare_start = np.cumsum([0, *map(len, rare)])
        self.rare_item = np.array([j for p in rare for j, _ in p], np.int64)
        self.rare_impact = np.array([x for p in rare for _, x in p])
        self.sides = [tuple(shingles(bare(x)) for x in parts(w)) for _, w in raw_items]
        self.window = max(WINDOW, 2 + 2 * max((len(w) for _, w in self.items), default=0))

    def retrieve(self, terms: list[int]) -> list[tuple[int, float]]:
        """Block-max WAND: every (item, score) with score >= threshold for the distinct ``terms`` of a passage."""
        need = self.threshold - 1e-12
        docs, impacts = self.docs, self.impacts
        cursors = sorted([docs[t][0], t, 0] for t in terms)
        found = []
        while cursors:
            bound, pivot = 0.0, -1
            for k, (_, t, _) in enumerate(cursors):
                bound += self.most[t]
                if bound >= need:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block_bound, until = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else math.inf
            for _, t, at in cursors[: pivot + 1]:
                last = self.block_last[t]
                b = bisect.bisect_left(last, item, at // POSTINGS_BLOCK)
                if b < len(last):
                    block_bound += self.block_most[t][b]
                    until = min(until, last[b] + 1)
            if block_bound >= need:
                if cursors[0][0] == item:
                    score = 0.0
                    for c in cursors[: pivot + 1]:
                        score += impacts[c[1]][c[2]]
                    if score >= need:
                        found.append((item, score))
                    target = item + 1
                else:
                    target = item
            else:
                target = max(until, item + 1)
            moved = []
            for c in cursors[: pivot + 1]:
                if c[0] < target:
                    d = docs[c[1]]
                    c[2] = bisect.bisect_left(d, target, c[2])
                    if c[2] >= len(d):
                        continue
                    c[0] = d[c[2]]
                moved.append(c)
            cursors = sorted(moved + cursors[pivot + 1 :])
        return found

    def windows(self, n: int) -> list[int]:
        """Starts of passages: any item lies whole in one of them."""
        step = self.window // 2
        return list(range(0, max(n - step, 1), step))

    def leaks(self, texts: list[str | None]) -> list[tuple[int, int, float, float, float, int]]:
        """(text, item, score, question overlap, answer overlap, first word of the passage): the best passage of every
        text and item that passes the checks."""
        known = self.terms.get
        docs = [bare(words(t)) for t in texts]
        starts = [(d, s) for d, w in enumerate(docs) for s in self.windows(len(w))]
        ids = [np.fromiter((known(x, -1) for x in w), np.int64, len(w)) for w in docs]
        rows, place = [], []
        for k, (d, s) in enumerate(starts):
            part = ids[d][s : s + self.window]
            part = part[part >= 0]
            rows.append(part)
            place.append(np.full(len(part), k))
        if not rows:
            return []
        m = len(self.terms)
        pairs = np.unique(np.concatenate(place) * m + np.concatenate(rows))  # distinct terms of each passage
        passage, term = pairs // m, pairs % m
        size = self.rare_start[term + 1] - self.rare_start[term]
        at = np.repeat(self.rare_start[term] - np.cumsum(size) + size, size) + np.arange(size.sum())
        n = len(self.items)
        key, where = np.unique(np.repeat(passage, size) * n + self.rare_item[at], return_inverse=True)
        reach = np.bincount(where, weights=self.rare_impact[at], minlength=len(key)) + self.common[key % n]
        best: dict[tuple[int, int], tuple] = {}
        cuts = np.searchsorted(passage, np.arange(len(starts) + 1))
        for k in np.unique(key[reach >= self.threshold - 1e-12] // n).tolist():
            d, s = starts[k]
            for j, score in self.retrieve(term[cuts[k] : cuts[k + 1]].tolist()):
                text = docs[d][s : s + self.window]
                have = shingles_in(text, self.sides[j])
                if (min(have) >= OVERLAP or holds(text, self.items[j][1])) and (score, -s) > best.get((d, j), (-1.0, 0))[:2]:
                    best[d, j] = (score, -s, *have)
        return [(d, self.items[j][0], score, q, a, -s) for (d, j), (score, s, q, a) in sorted(best.items())]


def shingles_in(passage: list[bytes], sides: tuple[set, set]) -> tuple[float, float]:
    """Shares of the question's and the answer's shingles that occur in the passage; an empty part counts as present."""
    out = []
    for want in sides:
        by_size: dict[int, set] = {}
        for size in {len(x) for x in want}:
            by_size[size] = {tuple(passage[k : k + size]) for k in range(len(passage) - size + 1)}
        out.append(sum(x in by_size[len(x)] for x in want) / len(want) if want else 1.0)
    return out[0], out[1]


def holds(passage: list[bytes], item: list[bytes]) -> bool:
    """Whether the passage has ``WHOLE`` of the item's shingles, or the item with one edit; a word of fewer than five is too
    much to miss."""
    want = shingles(item)
    share, _ = shingles_in(passage, (want, set()))
    if share >= WHOLE:
        return True
    if len(item) < SHINGLE or round((1 - share) * len(want)) > SHINGLE + 1:
        return False
    for s in range(len(passage)):
        i = 0
        while i < len(item) and s + i < len(passage) and item[i] == passage[s + i]:
            i += 1
        for a, b in EDITS:
            rest = item[i + a :]
            if passage[s + i + b : s + i + b + len(rest)] == rest:
                return True
    return False


Block = tuple[list[tuple[object, str]], tuple[int, int, dict[bytes, int]] | None]


def item_words(items: DataFrame) -> DataFrame:
    """``items`` (i, t) -> (term, holders, words): a row per different word of an item, and one without a term per item with a word, with its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms: list[bytes | None] = []
            lengths: list[int] = []
            for t in b.column(1).to_pylist():
                if w := words(t):
                    different = set(bare(w))
                    terms += [None, *different]
                    lengths += [len(w)] + [0] * len(different)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()), pa.array(lengths, pa.int64())], names=["term", "words"])

    rows = items.mapInArrow(run, "term binary, words long")
    return rows.groupBy("term").agg(F.count("*").alias("holders"), F.sum("words").alias("words"))


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[Block]:
    """The items in blocks of about ``INDEX_BYTES``, dealt by hash of the text, each with what :class:`Index` needs of all; equal items
    count once. Ids are labels of any type, null too. The driver holds a block and the counts of the block's words, no more."""
    one = items.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t")).filter("t IS NOT NULL").distinct()
    order = lambda r: (r[0] is not None, r[0] or 0, r[1]) if isinstance(r[0], int | None) else (True, str(r[0]), r[1])
    size = one.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-size // INDEX_BYTES)
    if n == 1:
        yield sorted(((r[0], r[1]) for r in one.collect()), key=order), None
        return
    if n:
        counts = Stored(item_words(one), "leak-terms").df
        whole = counts.filter("term IS NULL").select("holders", "words").first() or (0, 0)
    for k in range(n):
        block = one.filter(F.pmod(F.xxhash64("t"), F.lit(n)) == k)
        own = counts.join(item_words(block).select("term"), "term", "left_semi").select("term", "holders")
        yield sorted(((r[0], r[1]) for r in block.collect()), key=order), (whole[0], whole[1], {bytes(r[0]): r[1] for r in own.collect()})


def leaked_passages(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``id_col, item_id, score, question_overlap, answer_overlap, first_word``: one row per row of ``docs`` and item leaked.

    Null and empty texts leak nothing, nor do items with such a text; items with a null id leak like others and are reported with it, ids keep
    their type; repeated rows are reported each; no items or no documents give no rows. Other columns are not read; ``id_col`` must not have the name of another column of the result.
    """
    spark = docs.sparkSession
    names = [id_col, "item_id", "score", "question_overlap", "answer_overlap", "first_word"]
    if id_col.lower() in names[1:]:
        raise ValueError(f"id_col {id_col} is a column of the result; rename it")
    source = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    schema = source.select("doc").schema.add("item_id", items.select(F.col(f"`{item_id}`")).schema[0].dataType).add("score", "double").add("question_overlap", "double").add("answer_overlap", "double").add("first_word", "long")
    label = to_arrow_type(schema["item_id"].dataType)
    found = None
    for block in item_blocks(items, item_id, item_text):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value[0], of_all=shared.value[1])
            for b in batches:
                for k in range(0, b.num_rows, 256):
                    part = b.slice(k, 256)
                    rows = index.leaks(part.column(1).to_pylist())
                    columns = list(zip(*rows, strict=True)) or [[]] * 6
                    ids = part.column(0).take(pa.array(columns[0], pa.int64()))
                    kinds = [label, pa.float64(), pa.float64(), pa.float64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(columns[1:], kinds, strict=True)]], names=schema.names)

        part = source.mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    return (found if found is not None else spark.createDataFrame([], schema)).toDF(*names)


def drop_leaked(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item leaked, columns unchanged. Filters in one pass a block; see
    :func:`leaked_passages` for nulls, empty texts and empty tables."""
    spark, names = docs.sparkSession, docs.columns
    place = names.index(text_col)
    kept = docs.toDF(*[f"c{k}" for k in range(len(names))])  # Arrow functions take no names with dots
    schema = kept.schema
    for block in item_blocks(items, item_id, item_text):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value[0], of_all=shared.value[1])
            for b in batches:
                for k in range(0, b.num_rows, 256):
                    part = b.slice(k, 256)
                    bad = {r[0] for r in index.leaks(part.column(place).to_pylist())}
                    yield part.filter(pa.array([x not in bad for x in range(part.num_rows)]))

        kept = kept.mapInArrow(run, schema)
    return kept.toDF(*names)
