"""Suffix sorting by recursive induction, with common-prefix values carried along.

Suffixes are classed S (less than the next suffix) or L. Once the leftmost S suffixes (S*) are in order, one sweep over the
first characters from small to large induces all L suffixes and one back induces all S suffixes: reading a sorted suffix puts
the suffix one character longer behind what its bucket holds. The S* suffixes are ordered by sorting the text of the names of
their substrings the same way, recursively; that text is at most half as long. The recursion ends where all names differ, or most do and
what is equal differs soon after.

A waiting suffix is a tuple of its place and the rank of the suffix that put it there. From the ranks of two neighbours in a
bucket follows their common prefix: one more than the least common prefix between their sources (a range minimum over what
the sweep has read). Names carry the common prefixes of their substrings, so the recursion's values convert to characters.

Buckets are queues: filled in order, read once, and so together a priority queue by (character, arrival). Characters are read in
stretches of about the square root of the text's length of suffixes, so large alphabets (names) take few steps; what a stretch puts into
itself limits how far it can be read at once. Tables of over ``MEMORY`` entries are files in Spark's scratch folders, mapped and without a name,
so they end with the task like Spark's own spill.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: Entries of a table that are held in memory; larger ones are mapped files.
MEMORY = 1 << 24


def _table(shape: int | tuple[int, int], kind: type) -> np.ndarray:
    scratch = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]  # Spark sets it for its Python workers
    if np.prod(shape) <= MEMORY or not scratch:
        return np.empty(shape, kind)
    with tempfile.TemporaryFile(dir=scratch) as f:  # the mapping outlives the name and the handle
        return np.asarray(np.memmap(f, kind, "w+", shape=shape))


class Minima:
    """Range minima over a sequence that grows at its end: level k holds the least of the last 2**k values."""

    def __init__(self, n: int):
        self.size = 0
        self.levels = _table((max(n, 1).bit_length(), n), np.uint8)

    def extend(self, values: np.ndarray) -> None:
        s, e = self.size, self.size + len(values)
        self.levels[0, s:e] = values
        for k in range(1, e.bit_length()):
            h = 1 << (k - 1)
            below, m = self.levels[k - 1], max(s, h)
            self.levels[k, s:m] = below[s:m]
            if m < e:
                np.minimum(below[m:e], below[m - h : e - h], out=self.levels[k, m:e])
        self.size = e

    def between(self, after: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Least value of places after < place <= upto."""
        k = np.frexp((upto - after).astype(np.float64))[1] - 1
        return np.minimum(self.levels[k, upto], self.levels[k, after + (1 << k.astype(np.int64))])


def classes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(True for S suffixes, length of the run of equal characters from each place, up to 255). The end is less than
    everything, so the last suffix is L."""
    n = len(text)
    ends = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)
    size = np.diff(ends, prepend=-1)
    rises = np.zeros(len(ends), bool)
    rises[:-1] = text[ends[:-1] + 1] > text[ends[:-1]]
    run = np.minimum(np.repeat(ends, size) - np.arange(n) + 1, 255).astype(np.uint8)
    return np.repeat(rises, size), run


class Sweep:
    """One sweep: reads ``fixed`` suffixes (in reading order, with the common prefix of each with the one before it if both
    start alike) and what they induce.

    ``key``: the characters, in reading order; ``wanted``: places of the class that is induced; ``seed``: a place that the
    end of the text induces before all others. ``pos`` and ``common`` hold the induced suffixes in the order read.
    """

    def __init__(self, key: np.ndarray, wanted: np.ndarray, run: np.ndarray, sigma: int, fixed: np.ndarray, common: np.ndarray | None, seed: int | None, cap: int):
        self.key, self.wanted, self.run, self.cap = key, wanted, run, cap
        counts = np.bincount(key[wanted], minlength=sigma)
        total = int(counts.sum())
        ends = np.cumsum(counts)
        step = max(int((2 * total) ** 0.5), 1)
        if sigma > 256:
            self.stretch = (np.maximum(ends - 1, 0) // step).astype(np.int64)  # not falling, so stretches are ranges of characters
            self.stretch = np.unique(self.stretch, return_inverse=True)[1].astype(np.uint16 if total < 1 << 30 else np.int32)
        else:
            self.stretch = np.arange(sigma, dtype=np.uint16)
        m = int(self.stretch[-1]) + 1
        sizes = np.bincount(self.stretch, weights=counts, minlength=m).astype(np.int64)
        self.start = np.cumsum(sizes) - sizes
        self.fill = self.start.copy()
        self.place, self.source = _table(max(total, 1), np.int32), _table(max(total, 1), np.int32)
        self.pos, self.got = _table(total, np.int32), 0
        self.carries = common is not None
        self.common = _table(total, np.uint8) if self.carries else None
        if self.carries:
            self.minima = Minima(total + len(fixed) + 1)
            self.minima.extend(np.zeros(1, np.uint8))
        self.read = 1
        self.last_source, self.last_place = np.full(sigma, -1, np.int64), np.full(sigma, -1, np.int64)
        fixed_key = key[fixed]
        first = np.ones(len(fixed), bool)
        first[1:] = fixed_key[1:] != fixed_key[:-1]
        cuts = np.searchsorted(self.stretch[fixed_key], np.arange(m + 1))
        if seed is not None:
            at = self.stretch[key[seed]]
            self.place[self.start[at]], self.source[self.start[at]] = seed, 0
            self.fill[at] += 1
        for b in range(m):
            lo, hi = int(self.start[b]), int(self.fill[b])
            f = slice(int(cuts[b]), int(cuts[b + 1]))
            self._stretch(b, self.place[lo:hi], self.source[lo:hi], fixed[f], first[f], common[f] if self.carries else None)
        del self.place, self.source, self.last_source, self.last_place
        if self.carries:
            del self.minima

    def _inside(self, b: int, pos: np.ndarray) -> np.ndarray:
        """The characters of what suffixes put into the stretch they are in; of the others, one past all."""
        c = self.key[pos - 1].astype(np.int64)  # the place before the first is the last, which is in no wanted place's stead
        c[~self.wanted[pos - 1] | (self.stretch[c] != b) | (pos == 0)] = len(self.stretch)
        return c

    def _stretch(self, b: int, pos: np.ndarray, source: np.ndarray, fixed: np.ndarray, first: np.ndarray, common: np.ndarray | None) -> None:
        key = self.key[pos]
        turn = np.argsort(key, kind="stable")
        pos, source, key = pos[turn].astype(np.int64), source[turn].astype(np.int64), key[turn]
        fixed_key = self.key[fixed]
        inside, inside_fixed = self._inside(b, pos), self._inside(b, fixed)
        while len(pos) or len(fixed):
            limit = min(inside.min(initial=len(self.stretch)), inside_fixed.min(initial=len(self.stretch)))
            # What goes to a character comes behind the suffixes that wait there, before the fixed ones.
            i, f = int(np.searchsorted(key, limit, side="right")), int(np.searchsorted(fixed_key, limit, side="left"))
            new, rank = self._read(b, pos[:i], source[:i], key[:i], fixed[:f], fixed_key[:f], first[:f], common[:f] if self.carries else None)
            pos, source, key, inside = pos[i:], source[i:], key[i:], inside[i:]
            if len(new):
                added = self.key[new]
                if len(pos):
                    pos, source, key = np.concatenate([pos, new]), np.concatenate([source, rank]), np.concatenate([key, added])
                    inside = np.concatenate([inside, self._inside(b, new)])
                else:
                    pos, source, key, inside = new, rank, added, self._inside(b, new)
                if key[0] != key[-1] or key.min() != key.max():
                    turn = np.argsort(key, kind="stable")
                    pos, source, key, inside = pos[turn], source[turn], key[turn], inside[turn]
            if f:
                fixed, fixed_key, first, inside_fixed = fixed[f:], fixed_key[f:], first[f:], inside_fixed[f:]
                if self.carries:
                    common = common[f:]

    def _read(self, b, pos, source, key, fixed, fixed_key, first, common) -> tuple[np.ndarray, np.ndarray]:
        """Reads waiting and fixed suffixes, merged by character, and puts what they induce. Returns what stays in the stretch."""
        n = len(pos)
        if not n:
            whole, place = fixed, None
        elif not len(fixed):
            whole, place = pos, None
        else:
            place = np.searchsorted(fixed_key, key, side="left") + np.arange(n)  # of the waiting ones among all
            whole = np.empty(n + len(fixed), np.int64)
            is_fixed = np.ones(len(whole), bool)
            is_fixed[place] = False
            whole[place], whole[is_fixed] = pos, fixed
        if n:
            out = slice(self.got, self.got + n)
            self.pos[out] = pos
            self.got += n
        if self.carries:
            if n:
                before = np.empty(n, np.int64)
                before[1:] = source[:-1]
                new = np.ones(n, bool)
                new[1:] = key[1:] != key[:-1]
                before[new] = self.last_source[key[new]]
                mine = np.zeros(n, np.uint8)
                has = np.flatnonzero(before >= 0)
                mine[has] = np.minimum(self.minima.between(before[has], source[has]).astype(np.int64) + 1, self.cap)
                self.common[out] = mine
                end = np.append(new[1:], True)
                self.last_source[key[end]], self.last_place[key[end]] = source[end], pos[end]
            if len(fixed):
                theirs = common.copy()
                theirs[first] = 0
                at = np.flatnonzero(first & (self.last_place[fixed_key] >= 0))  # the runs decide between the classes
                theirs[at] = np.minimum(np.minimum(self.run[self.last_place[fixed_key[at]]], self.run[fixed[at]]), self.cap)
            if place is None:
                self.minima.extend(mine if n else theirs)
            else:
                values = np.empty(len(whole), np.uint8)
                values[place], values[is_fixed] = mine, theirs
                self.minima.extend(values)
        p = whole - 1
        keep = np.flatnonzero(self.wanted[p] & (whole > 0))
        p, rank = p[keep], keep + self.read
        self.read += len(whole)
        to = self.stretch[self.key[p]]
        stay = to == b
        if not stay.all():
            go = np.flatnonzero(~stay)
            turn = go[np.argsort(to[go], kind="stable")]
            to = to[turn]
            new = np.ones(len(to), bool)
            new[1:] = to[1:] != to[:-1]
            heads = np.flatnonzero(new)
            sizes = np.diff(heads, append=len(to))
            slot = np.repeat(self.fill[to[heads]] - heads, sizes) + np.arange(len(to))
            self.place[slot], self.source[slot] = p[turn], rank[turn]
            self.fill[to[heads]] += sizes
        return p[stay], rank[stay]


def _both_sweeps(text: np.ndarray, s: np.ndarray, run: np.ndarray, sigma: int, star: np.ndarray, common: np.ndarray | None, cap: int) -> tuple[Sweep, Sweep]:
    """Induces L suffixes from S* suffixes grouped by first character, then S suffixes from L suffixes."""
    large = Sweep(text, ~s, run, sigma, star, common, len(text) - 1, cap)
    back = None
    if common is not None:
        back = np.zeros(len(large.pos), np.uint8)
        back[1:] = large.common[1:][::-1]  # of each with the next larger one
    down = (sigma - 1 - text.astype(np.int64)).astype(text.dtype)
    small = Sweep(down, s, run, sigma, large.pos[::-1].astype(np.int64), back, None, cap)
    return large, small


def sort_suffixes(text: np.ndarray, sigma: int, cap: int = 255) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): start places of all suffixes of a text of numbers below ``sigma`` in order, and the common prefix of each
    with the one before it, up to ``cap`` (at most 255). A suffix comes before its extensions."""
    n = len(text)
    if n < 2:
        return np.arange(n), np.zeros(n, np.uint8)
    s, run = classes(text)
    star = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    common = np.zeros(len(star), np.uint8)
    if len(star) > 1:
        star, common = _stars(text, s, run, sigma, star, cap)
    large, small = _both_sweeps(text, s, run, sigma, star, common, cap)

    up, up_common = small.pos[::-1].astype(np.int64), np.zeros(len(small.pos), np.uint8)
    up_common[1:] = small.common[1:][::-1]  # of each with the next smaller one
    lc, sc = text[large.pos], text[up]
    place = np.arange(len(up)) + np.searchsorted(lc, sc, side="right")
    order, out = np.empty(n, np.int64), np.empty(n, np.uint8)
    is_large = np.ones(n, bool)
    is_large[place] = False
    order[place], order[is_large] = up, large.pos
    first = np.ones(len(up), bool)
    first[1:] = sc[1:] != sc[:-1]
    at = np.flatnonzero(first)
    before = np.searchsorted(lc, sc[at], side="right") - 1
    near = (before >= 0) & (lc[np.maximum(before, 0)] == sc[at]) if len(lc) else np.zeros(len(at), bool)
    up_common[at] = 0
    up_common[at[near]] = np.minimum(np.minimum(run[large.pos[before[near]]], run[up[at[near]]]), cap)
    out[place], out[is_large] = up_common, large.common
    return order, out


def _stars(text: np.ndarray, s: np.ndarray, run: np.ndarray, sigma: int, star: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """S* places in the order of their suffixes, with common prefixes."""
    n, m = len(text), len(star)
    # Named with their classes, an L character before an S one. Substrings reach to the next S* place, that one included; the last to the end.
    size = np.append(star[1:] + 1, n) - star
    typed = text.astype(np.int64) * 2 + s + 1
    place, name = _names(typed, 2 * sigma + 1, star, size)
    shared = _shared(typed, star[place], size[place])
    names = int(name[place[-1]]) + 1
    same = name[place[1:]] == name[place[:-1]]
    if names == m:
        order, common = place, np.zeros(m, np.uint8)
    else:
        order, common = _few_ties(name, names, cap) or sort_suffixes(name, names, cap)
    # A common prefix of names is one of characters up to where the names differ, and on as far as the different ones agree.
    least = Minima(names)
    least.extend(np.concatenate([[0], np.minimum(shared[~same], cap)]).astype(np.uint8))
    a, b, k = order[:-1], order[1:], common[1:].astype(np.int64)
    starts = np.append(star, n)
    x, y = starts[np.minimum(a + k, m)], starts[np.minimum(b + k, m)]
    value = x - star[a]
    both = np.flatnonzero((k < cap) & (x < n) & (y < n))
    one, two = name[(a + k)[both]].astype(np.int64), name[(b + k)[both]].astype(np.int64)
    agree = least.between(np.minimum(one, two), np.maximum(one, two)).astype(np.int64)
    u, v = x[both] + agree, y[both] + agree
    inside = np.flatnonzero((u < n) & (v < n))
    alike = inside[text[u[inside]] == text[v[inside]]]  # one character, different classes: the runs decide
    agree[alike] += np.minimum(run[u[alike]], run[v[alike]])
    value[both] += agree
    value[k >= cap] = cap
    out = np.zeros(m, np.uint8)
    out[1:] = np.minimum(value, cap)
    return star[order], out


#: Distinct characters, as one in so many, from which a text's suffixes are compared directly, and the comparisons a suffix that
#: may take on average.
TIES, WORK = 3, 8


def _few_ties(text: np.ndarray, sigma: int, cap: int) -> tuple[np.ndarray, np.ndarray] | None:
    """:func:`sort_suffixes` of a text of mostly different characters; none if it is not, or some stay equal for long."""
    n = len(text)
    if sigma * TIES < n:
        return None
    typed, starts = text.astype(np.int64) + 1, np.arange(n)
    got = _names(typed, sigma, starts, n - starts, WORK * n)
    return got and (got[0], np.concatenate([[0], _shared(typed, got[0], n - got[0], cap)]).astype(np.uint8))


def _names(typed: np.ndarray, most: int, star: np.ndarray, size: np.ndarray, work: float = np.inf) -> tuple[np.ndarray, np.ndarray] | None:
    """(order, name) of the substrings at ``star``, of characters over 0 and up to ``most``. Sorted by as many as fit in 64 bits at a
    time, further ones only where those before are equal; none if that takes over ``work``
    comparisons."""
    bits = most.bit_length()
    per = 64 // bits
    padded = np.append(typed, np.zeros(per, np.int64)).astype(np.uint64)
    rank, live, done = np.zeros(len(star), np.int64), np.arange(len(star)), 0
    while len(live):
        work -= len(live)
        if work < 0:
            return None
        word = np.zeros(len(live), np.uint64)
        for k in range(done, done + per):
            at = np.minimum(star[live] + k, len(typed))
            word = (word << np.uint64(bits)) | np.where(k < size[live], padded[at], np.uint64(0))
        turn = np.argsort(word) if done == 0 else np.lexsort((word, rank[live]))
        live, word = live[turn], word[turn]
        group = rank[live]
        new = np.ones(len(live), bool)
        new[1:] = (word[1:] != word[:-1]) | (group[1:] != group[:-1])
        heads = np.flatnonzero(new)
        old = np.ones(len(live), bool)
        old[1:] = group[1:] != group[:-1]
        begins = np.flatnonzero(old)
        first = np.repeat(begins, np.diff(begins, append=len(live)))
        sizes = np.diff(heads, append=len(live))
        rank[live] = group + np.repeat(heads, sizes) - first
        done += per
        live = live[np.repeat(sizes > 1, sizes)]
        live = live[size[live] > done]
    order = np.argsort(rank, kind="stable")
    ranked = rank[order]
    return order, np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])]).astype(np.int32)[np.argsort(order)]


def _shared(typed: np.ndarray, places: np.ndarray, size: np.ndarray, cap: int | None = None) -> np.ndarray:
    """How many characters neighbouring substrings share, up to ``cap``."""
    a, b, most = places[:-1], places[1:], np.minimum(size[:-1], size[1:])
    if cap is not None:
        most = np.minimum(most, cap)
    out = most.copy()
    live, k = np.arange(len(a)), 0
    while len(live):
        live = live[most[live] > k]
        ok = typed[a[live] + k] == typed[b[live] + k]
        out[live[~ok]] = k
        live, k = live[ok], k + 1
    return out
