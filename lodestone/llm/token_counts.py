"""Token counts through a compiled finite-state transducer.

Byte-pair encoding has a property that makes it finite-state: a token sequence is the encoding of its bytes exactly if
every two neighbours are (no merge that would have happened earlier crosses their border). So while reading bytes it is
enough to know, for each start of a token that may still be open, the place reached in the trie of tokens and the token
that ended there. That set is a state; the next byte leads to one next state, and the change in the number of tokens is
written on the transition. States are compiled when first reached, up to a number, and beyond it stepped
through without being kept.

Long texts are cut into chunks anywhere. A border between a non-blank and a blank always ends a token, so a chunk acts on
whatever state it is entered in as (head, count, tail): open bytes before its first such border, tokens of the closed
middle, open bytes after its last. These maps compose associatively and are combined by a prefix scan.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Unicode white space, as the pattern's \s means it.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = 1 << 16
MAX_STATES, MAX_MEMO = 100_000, 1_200_000


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable Latin-1 stands for itself, the rest for 256, 257, ..."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Transducer:
    """Bytes of one pre-token -> number of tokens. ``merges``: pairs of byte strings in rank order."""

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        self.split: dict[bytes, tuple[bytes, bytes]] = {}
        self.born: dict[bytes, int] = {bytes([b]): -1 for b in range(256)}
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for r, (a, b) in enumerate(merges):
            self.rank.setdefault((a, b), r)
            if a + b not in self.born:
                self.born[a + b], self.split[a + b] = r, (a, b)
        self.trie: list[dict[int, int]] = [{}]
        self.token: list[bytes | None] = [None]
        for t in self.born:
            at = 0
            for c in t:
                to = self.trie[at].get(c)
                if to is None:
                    to = self.trie[at][c] = len(self.trie)
                    self.trie.append({})
                    self.token.append(None)
                at = to
            self.token[at] = t
        self.pairs: dict[tuple[bytes | None, bytes], bool] = {}
        self.alone: dict[bytes, bool] = {}
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple] = [((0, None, 0),)]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        self.next: list[dict[int, tuple[int, int]]] = [{}]

    def edge(self, t: bytes, right: bool) -> list[tuple[bytes, int, float]]:
        """Tokens that touch one side of t while t is built: (token, rank it is born at, rank it is used up at)."""
        out, used = [], float("inf")
        while True:
            out.append((t, self.born[t], used))
            if t not in self.split:
                return out
            used, t = self.born[t], self.split[t][1 if right else 0]

    def apart(self, a: bytes | None, b: bytes) -> bool:
        """Whether a, b stay two tokens (no a: whether b stays one): no merge joins what touches their border while both still touch it.

        Merges run by rank and, within one rank, from the left; so at equal ranks the left token is used up before the
        border's merge and the right one after it.
        """
        known = self.pairs.get((a, b))
        if known is None:
            known = self.whole(b) and (a is None or not any(
                (r := self.rank.get((x, y))) is not None and bx < r < ux and by < r <= uy for x, bx, ux in self.edge(a, True) for y, by, uy in self.edge(b, False)
            ))
            if len(self.pairs) > MAX_MEMO // 2:
                self.pairs.clear()
            self.pairs[a, b] = known
        return known

    def whole(self, t: bytes) -> bool:
        """Whether t encodes to itself: its two parts do, and their border is never crossed earlier."""
        known = self.alone.get(t)
        if known is None:
            if t not in self.split:
                known = True
            else:
                a, b = self.split[t]
                own = self.born[t]
                known = self.whole(a) and self.whole(b) and not any(
                    (r := self.rank.get((x, y))) is not None and r < own and bx < r < ux and by < r <= uy for x, bx, ux in self.edge(a, True) for y, by, uy in self.edge(b, False)
                )
            self.alone[t] = known
        return known

    def advance(self, opened: tuple, byte: int) -> tuple[tuple, int]:
        """(next state, tokens more than before). A state lists open starts as (trie node, token ended there, tokens
        there less tokens now), longest first."""
        still, best, more, pairs, trie, token = [], None, 0, self.pairs, self.trie, self.token
        for node, last, less in opened:
            to = trie[node].get(byte)
            if to is None:
                continue
            if trie[to]:
                still.append((to, last, less))
            if best is None and (t := token[to]) is not None:
                known = pairs.get((last, t))
                if known or known is None and self.apart(last, t):
                    best, more = t, less + 1
        return (*[(n, last, less - more) for n, last, less in still], (0, best, 0)), more

    def count(self, data: bytes) -> int:
        """Follow compiled transitions; compile missing ones while there is room, else go on without compiling."""
        state, total, arcs, number = 0, 0, self.next, self.number
        for k, c in enumerate(data):
            found = arcs[state].get(c)
            if found is None:
                key, more = self.advance(self.states[state], c)
                to = number.get(key)
                if to is None:
                    if len(arcs) >= MAX_STATES:
                        total += more
                        for c in data[k + 1 :]:
                            key, more = self.advance(key, c)
                            total += more
                        return total
                    to = number[key] = len(arcs)
                    self.states.append(key)
                    arcs.append({})
                found = arcs[state][c] = (to, more)
            state = found[0]
            total += found[1]
        return total


class ChunkMap(NamedTuple):
    """What a chunk does: ``head`` is open to the left, ``tail`` to the right; without a border all is ``head``."""

    head: str
    count: int
    tail: str | None


class Counter:
    """Tokens of whole texts for one byte-level vocabulary file (its JSON text)."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        model, before = d["model"], d["pre_tokenizer"]
        if model["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or d["normalizer"] or model.get("ignore_merges"):
            raise ValueError("a byte-level BPE vocabulary without normalizer or prefix space is needed")
        alphabet = byte_alphabet()
        raw = lambda s: bytes(map(alphabet.__getitem__, s))
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.machine = Transducer([(raw(a), raw(b)) for a, b in pairs])
        special = sorted((t["content"] for t in d["added_tokens"]), key=len, reverse=True)
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in d["added_tokens"]):
            raise ValueError("special tokens that take in their surroundings are not handled")
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.longest = max(map(len, special), default=0)
        self.pieces = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.runs = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
        self.border = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")
        self.memo: dict[str, int] = {}
        self.after_blank: dict[str, int] = {}

    def run(self, text: str) -> int:
        """Of blanks followed by non-blanks, at most one of each kind: no token reaches over its ends."""
        n = self.memo.get(text)
        if n is None:
            n = sum(self.machine.count(p.encode("utf-8", "surrogatepass")) for p in self.pieces.findall(text))
            if len(text) <= 16:
                if len(self.memo) >= MAX_MEMO // 20:
                    self.memo.clear()
                self.memo[text] = n
        return n

    def plain(self, text: str) -> int:
        """Tokens of a text that holds no special token. Without double blanks every single blank starts a new token."""
        first, *rest = text.split(" ")
        counts = list(map(self.after_blank.get, rest))
        if first[-1:] in SPACE and first:
            return sum(map(self.run, self.runs.findall(text)))
        if None in counts:
            for k, n in enumerate(counts):
                if n is None:
                    r = rest[k]
                    if not r or r[0] in SPACE or r[-1] in SPACE:  # blanks side by side: runs of them matter
                        return sum(map(self.run, self.runs.findall(text)))
                    counts[k] = self._after(r)
        return sum(counts) + sum(map(self.run, self.runs.findall(first)))

    def _after(self, piece: str) -> int:
        if piece.isalpha():
            n = self.machine.count((" " + piece).encode("utf-8", "surrogatepass"))
        elif piece[-1] in ",." and piece[:-1].isalpha():
            n = self.after_blank.get(piece[:-1]) or self._after(piece[:-1])
            n += 1
        else:
            n = sum(map(self.run, self.runs.findall(" " + piece)))
        if len(piece) <= 64:
            if len(self.after_blank) >= MAX_MEMO:
                self.after_blank.clear()
            self.after_blank[piece] = n
        return n

    def chunk_map(self, chunk: str) -> ChunkMap:
        first = self.border.search(chunk)
        if not first:
            return ChunkMap(chunk, 0, None)
        last = len(chunk)
        while not (chunk[last - 1 : last].strip(SPACE) and chunk[last : last + 1] and not chunk[last : last + 1].strip(SPACE)):
            last -= 1
        return ChunkMap(chunk[: first.start()], self.plain(chunk[first.start() : last]), chunk[last:])

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """First a, then b. What was open between them closes where b has a border."""
        if a.tail is None and b.tail is None:
            return self.chunk_map(a.head + b.head)
        if a.tail is None:
            left = self.chunk_map(a.head + b.head + " ")  # b's border closes it
            return ChunkMap(left.head, left.count + (self.plain(left.tail[:-1]) if left.tail else 0) + b.count, b.tail)
        if b.tail is None:
            right = self.chunk_map(a.tail + b.head)
            if right.tail is None:
                return ChunkMap(a.head, a.count, right.head)
            return ChunkMap(a.head, a.count + self.plain(right.head) + right.count, right.tail)
        return ChunkMap(a.head, a.count + self.plain(a.tail + b.head) + b.count, b.tail)

    def reduce(self, maps: list[ChunkMap]) -> ChunkMap:
        """All maps composed: the last element of their prefix scan, which is all that counting needs, by the scan's up-sweep."""
        while len(maps) > 1:
            pairs = [self.compose(a, b) for a, b in zip(maps[::2], maps[1::2], strict=False)]
            maps = pairs + maps[2 * len(pairs) :]
        return maps[0]

    def tokens(self, text: str | None) -> int:
        if not text:
            return 0
        parts = self.special.split(text) if self.special else [text]
        total = len(parts) - 1
        for p in parts:
            if len(p) <= CHUNK:
                total += self.plain(p)
            else:
                m = self.reduce([self.chunk_map(p[k : k + CHUNK]) for k in range(0, len(p), CHUNK)])
                total += self.plain(m.head) + m.count + (self.plain(m.tail) if m.tail else 0)
        return total


_made: dict[str, Counter] = {}


def counter(spec: str) -> Counter:
    """One compiled counter a worker process."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _made:
        _made.clear()
        _made[key] = Counter(spec)
    return _made[key]


def token_counts(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` for every row, in no order; other columns are not read.

    ``vocabulary``: path of the vocabulary file on the driver; its text is broadcast (a file's size, whatever the corpus).
    Null and empty texts count 0; special tokens' strings inside a text count as one token each.
    """
    names = ["n_bytes", "n_tokens", "over_limit"]
    if id_col.lower() in names:
        raise ValueError(f"id_col {id_col} is a column of the result; rename it")
    with open(vocabulary, encoding="utf-8") as f:
        text = f.read()
    spec = docs.sparkSession.sparkContext.broadcast(text)
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = source.select("id").schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")

    def result(ids: pa.Array, n_bytes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array(n_bytes), pa.array(n), pa.array(n > limit)], names=schema.names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(spec.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            n_bytes = np.array([len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts], np.int64)
            yield result(b.column(0), n_bytes, np.array([count.tokens(t) for t in texts], np.int64))

    # Long texts are counted in chunks, by many tasks; those with special tokens, which a cut could split, are not.
    cut = F.length("text") > CHUNK
    for x in special_strings(text):
        cut &= ~F.contains("text", F.lit(x))
    cut = F.coalesce(cut, F.lit(False))
    short = source.filter(~cut).mapInArrow(whole, schema)
    kind = source.schema["id"].dataType.simpleString()
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / CHUNK).cast("int")), lambda i: F.substring("text", i * CHUNK + 1, F.lit(CHUNK)))
    long = source.filter(cut).withColumn("row", F.monotonically_increasing_id())
    long = long.select("id", "row", F.octet_length("text").cast("long").alias("n_bytes"), F.posexplode(pieces).alias("place", "piece"))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(spec.value)
        for b in batches:
            maps = [count.chunk_map(x) for x in b.column(4).to_pylist()]
            made = [pa.array([m.head for m in maps], pa.string()), pa.array([m.count for m in maps], pa.int64()), pa.array([m.tail for m in maps], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *made], names=["id", "row", "n_bytes", "place", "head", "count", "tail"])

    def composed(t: pa.Table) -> pa.Table:
        count = counter(spec.value)
        rows = t.sort_by("place").to_pylist()
        m = count.reduce([ChunkMap(r["head"], r["count"], r["tail"]) for r in rows])
        n = count.plain(m.head) + m.count + (count.plain(m.tail) if m.tail else 0)
        return pa.Table.from_batches([result(t.column("id").slice(0, 1).combine_chunks(), np.array([rows[0]["n_bytes"]], np.int64), np.array([n], np.int64))])

    maps = long.mapInArrow(mapped, f"id {kind}, row long, n_bytes long, place int, head string, count long, tail string")
    return short.union(maps.groupBy("row").applyInArrow(composed, schema)).toDF(id_col, *names)


def special_strings(spec: str) -> list[str]:
    """The strings of a vocabulary's special tokens."""
    return [x["content"] for x in json.loads(spec).get("added_tokens", [])]
