"""Periodic runs in the words of a document (operator 13), by the linear tandem-repeat method of Gusfield and Stoye.

1. Only stretches can hold a run of the asked exponent in which every three words occur three times or more in the
   document (`stretches`, exact: a run of exponent 4 repeats each of its three-word windows that often). The stretches
   of a batch of documents are laid end to end, each ended by a letter of its own, and the method runs on that string.
2. Names of all blocks of 1, 2, 4, ... letters give the suffix array, the LCP table and any longest common extension.
   The LCP table with its range minima stands for the suffix tree: a locus is an interval of suffixes and a depth.
3. LZ blocks: at each of their ends, two extensions per period give the squares that cover the leftmost occurrence of
   every square of the string.
4. From those squares, walks by suffix links (the interval of suffix i goes to that of suffix i + 1, then one letter is
   appended) mark the loci of the squares' rotations: the whole vocabulary of squares with primitive roots.
5. The suffixes of each locus are the occurrences; those of equal period at neighbouring places merge into runs."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.bpe import groups
from corvane.llm.common import lean_worker
from corvane.llm.words import mix


class Suffixes:
    """Suffix array, LCP intervals and longest common extensions of a string of whole numbers."""

    def __init__(self, s: np.ndarray):
        self.s, self.n = s, len(s)
        name = np.unique(s, return_inverse=True)[1].astype(np.int64)
        self.names = [name.astype(np.int32)]
        step = 1
        while int(name.max(initial=0)) + 1 < self.n:
            after = np.zeros(self.n, np.int64)
            after[:-step] = name[step:] + 1
            name = np.unique(name * (self.n + 1) + after, return_inverse=True)[1]
            self.names.append(name.astype(np.int32))
            step *= 2
        self.rank = self.names[-1]
        self.order = np.empty(self.n, np.int64)
        self.order[self.rank] = np.arange(self.n)
        self.lcp = np.zeros(self.n, np.int32)  # of a suffix with the one before it in order
        self.lcp[1:] = self.forward(self.order[:-1], self.order[1:])
        self.least = [self.lcp]
        while (1 << len(self.least)) <= self.n:
            a, half = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(a[:-half], a[half:]))

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many letters from a and from b on are equal (a != b)."""
        a, b, first = a.astype(np.int64), b.astype(np.int64), a.astype(np.int64)
        for j in range(len(self.names) - 1, -1, -1):
            ok = np.maximum(a, b) < self.n
            ok[ok] = self.names[j][a[ok]] == self.names[j][b[ok]]
            a, b = a + (ok << j), b + (ok << j)
        return a - first

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many letters up to a and up to b, read backwards, are equal (a != b)."""
        a, b, first = a.astype(np.int64), b.astype(np.int64), a.astype(np.int64)
        for j in range(len(self.names) - 1, -1, -1):
            size = 1 << j
            ok = np.minimum(a, b) >= size - 1
            ok[ok] = self.names[j][a[ok] - size + 1] == self.names[j][b[ok] - size + 1]
            a, b = a - (ok << j), b - (ok << j)
        return first - a

    def locus(self, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval [lo, hi] of suffixes that begin with the `depth` letters at `at`."""
        lo = self.rank[at].astype(np.int64)
        hi = lo.copy()
        for j in range(len(self.least) - 1, -1, -1):
            size, least = 1 << j, self.least[j]
            ok = lo - size >= 0
            ok[ok] = least[lo[ok] - size + 1] >= depth[ok]
            lo -= ok << j
            ok = hi + size < self.n
            ok[ok] = least[hi[ok] + 1] >= depth[ok]
            hi += ok << j
        return lo, hi

    def child(self, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """A place where the interval's letters are followed by the letter, or -1: suffixes of an interval are in the
        order of the letter that follows."""
        low, high = lo.copy(), hi + 1
        while (low < high).any():
            mid = (low + high) >> 1
            at = self.order[np.minimum(mid, self.n - 1)] + depth
            smaller = np.where(at < self.n, self.s[np.minimum(at, self.n - 1)], np.iinfo(np.int64).min) < letter
            go = low < high
            low, high = np.where(go & smaller, mid + 1, low), np.where(go & ~smaller, mid, high)
        first = self.order[np.minimum(low, self.n - 1)]
        at = first + depth
        return np.where((low <= hi) & (at < self.n) & (self.s[np.minimum(at, self.n - 1)] == letter), first, -1)


def blocks(t: Suffixes) -> np.ndarray:
    """Starts of the LZ blocks, and the end: each block is the longest that also occurs from an earlier place on, or one letter."""
    order, before, after, stack = t.order.tolist(), [-1] * t.n, [-1] * t.n, []
    for x in order:
        while stack and stack[-1] > x:
            after[stack.pop()] = x
        if stack:
            before[x] = stack[-1]
        stack.append(x)
    longest = np.zeros(t.n, np.int64)
    for near in (before, after):
        near = np.array(near)
        has = np.flatnonzero(near >= 0)
        longest[has] = np.maximum(longest[has], t.forward(near[has], has))
    size, at, out = np.maximum(longest, 1).tolist(), 0, []
    while at < t.n:
        out.append(at)
        at += size[at]
    return np.array([*out, t.n], np.int64)


def covering_squares(t: Suffixes, chunk: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start, period) of squares whose rightward rotations cover the leftmost occurrence of each square."""
    edge = blocks(t)
    size = np.diff(edge)
    after = np.append(size[1:], 0)
    # (a place where two extensions meet, period, how far right the square may start): at a block's end, whose left
    # half lies in the block, and at a block's start, whose centre lies in the block.
    for meet, shift, most in ((edge[1:], -1, size), (edge[:-1], 1, size + after)):
        ends = np.cumsum(most)
        for base in range(0, int(ends[-1]), chunk):
            flat = np.arange(base, min(base + chunk, int(ends[-1])))
            b = np.searchsorted(ends, flat, side="right")
            k = flat - (ends[b] - most[b]) + 1
            x, y = meet[b], meet[b] + shift * k
            left = np.minimum(x, y)
            ok = (np.maximum(x, y) < t.n) & (left >= 0)
            x, y, k, b, left = x[ok], y[ok], k[ok], b[ok], left[ok]
            right = t.forward(x, y)
            back = t.backward(x - 1, y - 1)
            start = np.maximum(left - back, left - k)
            ok = (right > 0) & (right + back >= k) & ((shift < 0) | (start + k <= edge[b + 1]))
            yield start[ok], k[ok]


def primitive(t: Suffixes, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which squares have a root that isn't a power: no prime part of the period is a period too."""
    out = np.ones(len(start), bool)
    rest, factor = period.copy(), 2
    while (rest > 1).any():
        live = rest > 1
        low = np.flatnonzero(live & (rest % factor == 0))
        if len(low):
            d = period[low] // factor
            out[low] &= t.forward(start[low], start[low] + d) < period[low]
            while (rest[low] % factor == 0).any():
                rest[low] = np.where(rest[low] % factor == 0, rest[low] // factor, rest[low])
        factor += 1
        prime = np.flatnonzero((rest > 1) & (factor * factor > rest))
        d = period[prime] // rest[prime]
        out[prime] &= t.forward(start[prime], start[prime] + d) < period[prime]
        rest[prime] = 1
    return out


def spread(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, value): first[i], first[i] + 1, ... of each i, size[i] of them."""
    which = np.repeat(np.arange(len(size)), size)
    return which, first[which] + np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)


def vocabulary(t: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lo, hi, period): the loci of all distinct squares with primitive roots.

    A walk goes through the rotations of a square as far as its run reaches, and on by a suffix link and the next
    letter where the rotation stands elsewhere in the string; it ends at a rotation that is marked already."""
    marked: set[int] = set()
    walked: set[tuple[int, int]] = set()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    todo = [np.concatenate(x) for x in zip(*covering_squares(t))] if t.n else [np.zeros(0, np.int64)] * 2
    while len(todo[0]):
        at, k = todo
        first = at - t.backward(at - 1, at + k - 1)
        length = t.forward(first, first + k) + k
        new = []
        for i, w in enumerate(zip(first.tolist(), k.tolist())):
            if w not in walked:
                walked.add(w)
                new.append(i)
        first, k, length = first[new], k[new], length[new]
        ok = primitive(t, first, k)
        first, k, length = first[ok], k[ok], length[ok]
        turns = np.minimum(k, length - 2 * k + 1)
        which, place = spread(first, turns)
        lo, hi = t.locus(place, 2 * k[which])
        fresh = []
        for i, key in enumerate((lo * (2 * t.n) + k[which]).tolist()):
            if key not in marked:
                marked.add(key)
                fresh.append(i)
        found.append((lo[fresh], hi[fresh], k[which][fresh]))
        # Runs that don't hold all rotations: the last one's suffix link, then its own first letter.
        cut = turns < k
        last, k = (first + turns - 1)[cut], k[cut]
        lo, hi = t.locus(last + 1, 2 * k - 1)
        nxt = t.child(lo, hi, 2 * k - 1, t.s[last])
        todo = [nxt[nxt >= 0], k[nxt >= 0]]
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))


def runs(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all maximal runs of a string, those of at least two periods, by their least period."""
    if len(s) < 2:
        return (np.zeros(0, np.int64),) * 3
    t = Suffixes(np.asarray(s, np.int64))
    lo, hi, k = vocabulary(t)
    which, x = spread(lo, hi - lo + 1)
    at, k = t.order[x], k[which]
    by = np.lexsort([at, k])
    at, k = at[by], k[by]
    head = np.ones(len(at), bool)
    head[1:] = (k[1:] != k[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    return at[first], at[last] - at[first] + 2 * k[first], k[first]


def stretches(doc: np.ndarray, code: np.ndarray) -> np.ndarray:
    """For each word whether it lies in three words in a row that occur three times in the document, counted again
    within what is left until nothing changes. A run of four periods (six words or more) lies in one such stretch."""
    left = np.ones(len(code), bool)
    while True:
        three = np.zeros(len(code), bool)
        three[:-2] = left[:-2] & left[1:-1] & left[2:] & (doc[:-2] == doc[2:])
        at = np.flatnonzero(three)
        key = mix(mix(mix(code[at].astype(np.uint64) + np.uint64(1)) + code[at + 1].astype(np.uint64)) + code[at + 2].astype(np.uint64))
        key = mix(key ^ mix(doc[at].astype(np.uint64) + np.uint64(77)))
        _, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
        at = at[n[inverse] >= 3]
        now = np.zeros(len(code), bool)
        now[at] = now[at + 1] = now[at + 2] = True
        if now.sum() == left.sum():
            return now
        left = now


class Words:
    """Numbers of words, the same within a batch."""

    def __init__(self):
        self.number: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        number = self.number
        for w in set(words).difference(number):
            number[w] = len(number)
        return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def repeated(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document, made periodic from a on for a tenth of the ids; as they are without an id."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def runs_of_documents(texts: list[list[bytes]], least: int = 6, times: int = 4) -> list[list[tuple[int, int, int]]]:
    """For each document the runs (start, length, period) of at least `least` words and `times` (4 or more) periods, by start, then period."""
    if times < 4 or least < 6:
        raise ValueError("runs of fewer than six words or four periods may lie outside the stretches")
    number = Words()
    sizes = np.array([len(w) for w in texts], np.int64)
    code = np.concatenate([number(w) for w in texts]) if texts else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if len(code) < least:
        return out
    first = np.cumsum(sizes) - sizes
    inside = stretches(doc, code)
    at = np.flatnonzero(inside)
    if not len(at):
        return out
    # Stretches end to end, each ended by a letter of its own.
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])
    part = np.cumsum(new) - 1
    place = np.arange(len(at)) + part
    s = -1 - np.arange(len(at) + part[-1] + 1)
    s[place] = code[at]
    source = np.zeros(len(s), np.int64)
    source[place] = at
    start, length, period = runs(s)
    ok = length >= np.maximum(least, times * period)
    start, length, period = source[start[ok]], length[ok], period[ok]
    by = np.lexsort([period, start])
    of = doc[start[by]]
    for d, i, n, q in zip(of.tolist(), (start[by] - first[of]).tolist(), length[by].tolist(), period[by].tolist()):
        out[d].append((i, n, q))
    return out


def kept_words(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not found:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for i, n, q in found:
        change[i + q] += 1
        change[i + n] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, repeat: bool = False, keep_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_runs, the run of the greatest exponent (start, length, period, floor of a
    thousand times the exponent; nulls without runs), runs_sha256 of all runs, collapsed_sha256 of the words that stay
    when each run keeps its first period, and if asked those words (collapsed) and the runs. One pass, no shuffle; a
    worker holds the words of about two million letters, or of one text.

    repeat: a tenth of the documents, by the crc32 of their id, are made periodic first.

    Defined results: null, empty and blank texts have no words and no runs (the hashes are those of nothing); rows
    without an id are never made periodic; repeated rows are treated each; an empty table gives no rows; other columns
    are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            for k, texts in groups(b.column(1).to_pylist()):
                words = [t.encode().split() for t in texts]
                if repeat:
                    words = [repeated(w, i) for w, i in zip(words, ids[k : k + len(texts)])]
                found = runs_of_documents(words)
                best = [max(f, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if f else (None,) * 3 for f in found]
                left = [b" ".join(kept_words(w, f)) for w, f in zip(words, found)]
                of_runs = [hashlib.sha256("".join(["%d,%d,%d\n" % r for r in f]).encode()).hexdigest() for f in found]
                cols = [b.column(0).slice(k, len(texts)), pa.array([len(f) for f in found], pa.int64()), *(pa.array([r[i] for r in best], pa.int64()) for i in range(3))]
                cols += [pa.array([None if r[0] is None else 1000 * r[1] // r[2] for r in best], pa.int64()), pa.array(of_runs), pa.array([hashlib.sha256(x).hexdigest() for x in left])]
                names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
                if keep_text:
                    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
                    cols += [pa.array([x.decode() for x in left]), pa.array([[dict(zip(("start", "length", "period"), r)) for r in f] for f in found], kind)]
                    names += ["collapsed", "runs"]
                yield pa.RecordBatch.from_arrays(cols, names=names)
        lean_worker()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.mapInArrow(run, SCHEMA + ", collapsed string, runs array<struct<start:long,length:long,period:long>>" * keep_text)
