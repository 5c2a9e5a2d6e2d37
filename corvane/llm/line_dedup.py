"""Line deduplication by an exact set-similarity join (operator 4).

A line's tokens are its distinct words (ASCII lower case, split at ASCII white space). A line goes if an earlier line,
by (doc_id, line number), has a Jaccard similarity of `num / den` or more with it; empty lines stay.

1. Lines of equal token sets are one class, named by a cryptographic hash of their words, so that no two different sets
   share a name. Each task keeps the text of a class's first line it sees and goes on with that line only. A line that
   comes after a line of its class which the task has seen goes whatever else holds, and needs no look at its class.
2. The same pass counts the distinct words of those lines in 2**bits hash buckets. The counts give one order of all
   tokens, rare ones first; it only has to be the same everywhere, so shared buckets cost selectivity and never a link.
3. Prefix filter: a line of n tokens lists itself under its n - ceil(t n) + 1 rarest; tokens of count 1 list nothing.
   Entries travel packed, some hundred in a row. Within a token's list, sorted by length, a pair stays if it passes the
   length filter (n_x >= t n_y), the positional filter (what is left after the token can reach the needed overlap) and
   the bitmap filter (128-bit parities of the sets differ in no more bits than the sets may differ in tokens). A token
   whose count is large has its list dealt over tiles.
4. One earlier similar line is enough for a line to go. So a pair belongs to its later line, and a list gives each line
   its likeliest pair only (least apart, then earliest) and says whether there are others. n near-equal lines make n
   rows, not n * n. Over all lists a line keeps its likeliest pair, which is verified on the words of both.
5. Lines that this hasn't decided and that had other pairs get all their pairs of those lists. A list in which a line
   has several pairs was written with the entries that have a pair, so texts aren't gone through again. Every list gets
   the text of each of its lines once, and pairs are verified in it. So no link that decides about a line is missed.
6. A class that is linked with a class of an earlier first line loses all its lines, others all but their first.

The order of lines inside a list is a hint, of 32 bits: the document's, then the line's, of the line that the task saw
first. Documents that it can't tell apart hold each other's pairs; a lost line stays open unless its hint agrees with
its class's first line.

What is broadcast has a fixed size: the counts (2**bits) and bit sets of wanted classes (2**set_bits each)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import Tables, keep_in_bits, slots
from corvane.llm.words import LOWER, SPACE, bounds, buffers, hashes, mix, slices

NEWLINE = 10
#: What line_rows returns: lines, and rows of counts, in which all but the last two columns are null.
LINES = "row long, doc_id long, line int, n int, ca long, cb long, hint long, again boolean, n_lines int, text string, block int, counts binary"
#: What a task knows of a line: no words; its class's first line that the task sees; after or before those seen.
EMPTY, FRESH, AGAIN, EARLIER = range(4)
#: Counts travel in blocks of 2**BLOCK_BITS buckets.
BLOCK_BITS = 12
#: The key of a list entry is one long: 32 bits of the list (the first of them set in lists that are dealt over tiles), 20 of the line's size, 12 of the token's place. A place that
#: doesn't fit is given as less, which lets more pairs stay; a line whose size doesn't fit passes every filter.
SIZE_BITS, PLACE_BITS = 20, 12
HUGE = (1 << SIZE_BITS) - 1
TILED = np.uint64(1 << 63)
#: What an entry holds: its key, its line's class, parities of the line's tokens (128 bits), the line's hint.
ENTRY = np.dtype([("k", "<i8"), ("sa", "<i8"), ("image_a", "<u8"), ("image_b", "<u8"), ("hint", "<u4")])
#: Stands for a null id, which orders last.
LAST = (1 << 63) - 1


def lines_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text of each line, its number there, where it starts, where it ends, where words start and end, each word's line)."""
    cuts = np.flatnonzero(data == NEWLINE)
    before = np.searchsorted(cuts, off)
    size = before[1:] - before[:-1] + 1
    doc = np.repeat(np.arange(len(size)), size)
    first = np.concatenate([[0], np.cumsum(size)])
    number = np.arange(len(doc)) - first[doc]
    inner = number > 0
    start, end = off[doc], np.empty(len(doc), np.int64)
    start[inner] = cuts + 1
    last = number == size[doc] - 1
    end[last], end[~last] = off[1:], cuts
    s, e = bounds(data, np.append(start, len(data)), SPACE)
    return doc, number, start, end, s, e, text_of(start, s)


def text_of(start: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Which of the texts that start at `start` each word is in, by where words start."""
    return np.repeat(np.arange(len(start)), np.diff(np.searchsorted(s, start), append=len(s)))


def distinct_words(h: np.ndarray, line: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Which words are the distinct ones of each line, by line, then rarity, then hash. Words are told apart by their hash."""
    order = by_line(h, rarity, line)
    x, at = h[order], line[order]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != x[:-1]) | (at[1:] != at[:-1])
    return order[keep]


def joined_words(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(the words in lower case, a space after each; where each word's part ends)."""
    size = e - s + 1
    ends = np.cumsum(size)
    if not len(ends):
        return b"", ends
    low = np.append(LOWER[data], np.uint8(0x20))
    kind = np.int32 if max(len(low), ends[-1]) < 1 << 30 else np.int64
    out = low[np.arange(ends[-1], dtype=kind) + np.repeat((s - (ends - size)).astype(kind), size)]
    out[ends - 1] = 0x20
    return out.tobytes(), ends


def count_tokens(counted: DataFrame, bits: int) -> np.ndarray:
    """Lines per hash bucket of a word, from the blocks that tasks have counted: 2**bits numbers reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, n in zip(b.column(0).to_pylist(), b.column(1)):
                part = np.frombuffer(n.as_buffer(), np.int32)
                sums[block] = sums.get(block, np.zeros(len(part), np.int64)) + part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(x, np.iinfo(np.int32).max).astype(np.int32).tobytes() for x in sums.values()], pa.binary())], names=["block", "counts"])

    got = counted.filter("block is not null").select("block", "counts").repartition(slots(counted.sparkSession), "block").mapInArrow(add, "block int, counts binary").toArrow()
    out = np.zeros((1 << max(bits - BLOCK_BITS, 0), 1 << min(bits, BLOCK_BITS)), np.int32)
    for block, n in zip(got["block"].to_pylist(), got["counts"].to_pylist()):
        out[block] = np.frombuffer(n, np.int32)
    return out.reshape(-1)


def needed(nx, ny, num: int, den: int):
    """The least overlap with which sets of these sizes are similar: ceil(num (nx + ny) / (num + den))."""
    return -(-num * (nx + ny) // (num + den))


def by_line(h: np.ndarray, rarity: np.ndarray, line: np.ndarray) -> np.ndarray:
    """The order by line, then rarity (below 256), then hash."""
    if len(line) and line[-1] < 1 << 20:
        key = (line.astype(np.uint64) << np.uint64(44)) | (rarity << np.uint64(36)) | (h >> np.uint64(28))
        order = np.argsort(key)
        k, x = key[order], h[order]
        if not ((k[1:] == k[:-1]) & (x[1:] != x[:-1])).any():
            return order
    return np.lexsort((h, rarity, line))


def rarity_of(count: np.ndarray) -> np.ndarray:
    """Steps of a quarter of a power of two."""
    return np.minimum(np.log2(np.maximum(count, 1)) * 4, 255).astype(np.uint64)


def listings(h: np.ndarray, count: np.ndarray, n: np.ndarray, place: np.ndarray, sa: np.ndarray, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """(which token occurrence, its entry's key), once for each list it goes to. A token of count c > tile has
    ceil(c / tile) blocks of lines, and each pair of blocks meets in a list of its own."""
    blocks = np.maximum(-(-count // tile), 1)
    again = np.repeat(np.arange(len(h)), blocks)
    name = h[again] & ~TILED
    if len(again) > len(h):
        other = np.arange(len(again)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        mine = (mix(sa.view(np.uint64) + np.uint64(5)) % blocks.astype(np.uint64)).astype(np.int64)[again]
        pair = (np.minimum(mine, other) << 24) | np.maximum(mine, other)
        name = np.where(blocks[again] > 1, mix(name + mix(pair.astype(np.uint64) + np.uint64(1))) | TILED, name)
    key = (name & ~np.uint64(0xFFFFFFFF)) | (np.minimum(n, HUGE).astype(np.uint64) << np.uint64(PLACE_BITS))[again] | np.minimum(place, (1 << PLACE_BITS) - 1).astype(np.uint64)[again]
    return again, key.view(np.int64)


@dataclass(frozen=True)
class Hint:
    """32 bits that order lines: a document's part, (doc_id >> shift) - base, above line_bits of the line's number.
    The part never orders two documents wrongly, but can be the same for both. Null ids (LAST) have the greatest."""

    shift: int
    base: int
    line_bits: int

    @property
    def last(self) -> int:
        return (1 << (32 - self.line_bits)) - 1

    def of(self, doc_id: np.ndarray, line: np.ndarray) -> np.ndarray:
        part = np.where(doc_id == LAST, self.last, (np.where(doc_id == LAST, self.base << self.shift, doc_id) >> self.shift) - self.base)
        return (part << self.line_bits) | np.minimum(line, (1 << self.line_bits) - 1)

    def part(self, doc_id: Column) -> Column:
        return F.when(doc_id == LAST, F.lit(self.last)).otherwise(F.shiftright(doc_id, self.shift) - F.lit(self.base))


def hint_of(docs: DataFrame) -> Hint:
    lo, hi = docs.filter(F.col("doc_id") < LAST).agg(F.min("doc_id"), F.max("doc_id")).first()
    lo, hi = lo or 0, hi or 0
    shift = max(((hi - lo) + 2).bit_length() - 31, 0)
    base = lo >> shift
    return Hint(shift, base, 32 - ((hi >> shift) - base + 1).bit_length())


def some_lines(data: np.ndarray, start: np.ndarray, end: np.ndarray, given: np.ndarray) -> pa.Array:
    """The texts of the given lines, null for others."""
    size = np.where(given, end - start, 0)
    off = np.concatenate([[0], np.cumsum(size)])
    keep = np.repeat(given, np.diff(start, append=len(data)))
    cuts = end[end < len(data)]
    keep[cuts[data[cuts] == NEWLINE]] = False
    valid = pa.array(given).buffers()[1]
    return pa.Array.from_buffers(pa.string(), len(given), [valid, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data[keep])])


def line_rows(docs: DataFrame, hint: Hint, bits: int, seen_most: int = 200_000) -> DataFrame:
    """One row per line with its class (ca, cb), and with its text if it is the first of its class that the task sees;
    `again` says that the task has seen a line of its class that comes before it. Line 0 has the number of lines. Each
    task ends with rows of its counts of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple[int, int]] = {}
        total = np.zeros(1 << bits, np.int32)
        for whole in batches:
            for b in slices(whole, 2, 2_000_000):
                data, off = buffers(b.column(2))
                doc, number, start, end, s, e, line = lines_of(data, off)
                h = hashes(data, s, e)
                own = distinct_words(h, line, np.zeros(len(s), np.uint64))
                n = np.bincount(line[own], minlength=len(doc))
                words, at = joined_words(data, s[own], e[own])
                ends = np.concatenate([[0], at])[np.cumsum(n)].tolist()
                ids = b.column(1).fill_null(LAST).to_numpy()
                places = list(zip(ids.tolist(), b.column(0).to_pylist()))
                digests, state, lo = [], bytearray(), 0
                for z, d in zip(ends, doc.tolist()):
                    name = blake2b(words[lo:z], digest_size=16).digest()
                    digests.append(name)
                    if z == lo:
                        state.append(EMPTY)
                    else:
                        place, before = places[d], seen.get(name)
                        if before is not None and before <= place:  # lines of a row come in their order
                            state.append(AGAIN)
                        else:
                            state.append(FRESH if before is None else EARLIER)
                            seen[name] = place
                    lo = z
                if len(seen) > seen_most:
                    seen.clear()
                ca, cb = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2).T
                mine, state = pa.array(doc), np.frombuffer(bytes(state), np.uint8)
                fresh = state == FRESH
                total += np.bincount((h[own][fresh[line[own]]] >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.int32)
                n_lines = np.bincount(doc, minlength=len(b)).astype(np.int32)[doc]
                cols = [*(b.column(c).take(mine) for c in (0, 1)), pa.array(number.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(ca), pa.array(cb), pa.array(hint.of(ids[doc], number)), pa.array(state == AGAIN), pa.array(n_lines, mask=number > 0), some_lines(data, start, end, fresh)]
                yield given(cols, len(doc))
        blocks = total.reshape(-1, 1 << min(bits, BLOCK_BITS))
        used = np.flatnonzero(blocks.any(axis=1))
        if len(used):
            yield given([*[None] * 10, pa.array(used.astype(np.int32)), pa.array([x.tobytes() for x in blocks[used]], pa.binary())], len(used))

    names = [c.split()[0] for c in LINES.split(", ")]
    types = [{"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in LINES.split(", ")]

    def given(cols: list, rows: int) -> pa.RecordBatch:
        cols = cols + [None] * (len(names) - len(cols))
        return pa.RecordBatch.from_arrays([pa.nulls(rows, t) if c is None else c for c, t in zip(cols, types)], names=names)

    return docs.select("row", "doc_id", "t").mapInArrow(run, LINES)


def bucket_of(lists: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(lists.astype(np.int64).view(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def packed_entries(lines: DataFrame, counts, bits: int, num: int, den: int, tile: int, held_most: int = 500_000) -> DataFrame:
    """(bucket, entries): the list entries of the lines that have a text, all entries of a list in one bucket, packed."""
    buckets = 16 * slots(lines.sparkSession)

    def pack(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        x = np.concatenate(held) if held else np.zeros(0, ENTRY)
        if not len(x):
            return
        bucket = bucket_of(x["k"] >> 32, buckets)
        order = np.argsort(bucket)
        x, bucket = x[order], bucket[order]
        at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        ends = np.append(at[1:], len(x)).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array([x[a:z].tobytes() for a, z in zip(at.tolist(), ends)], pa.binary())], names=["bucket", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare, held, size = counts.value, [], 0
        for whole in batches:
            for b in slices(whole, 2, 2_000_000):
                data, off = buffers(b.column(2))
                s, e = bounds(data, off, SPACE)
                h, line = hashes(data, s, e), text_of(off[:-1], s)
                count = rare[(h >> np.uint64(64 - bits)).astype(np.int64)].astype(np.int64)
                own = distinct_words(h, line, rarity_of(count))
                h, line, count = h[own], line[own], count[own]
                sa, hint = b.column(0).to_numpy(), b.column(1).to_numpy()
                n = np.bincount(line, minlength=len(b))
                first = np.concatenate([[0], np.cumsum(n)])
                spot = mix(h + np.uint64(3)) >> np.uint64(57)
                bit = np.uint64(1) << (spot & np.uint64(63))
                images = np.zeros((2, len(b)), np.uint64)
                full = np.flatnonzero(n)
                if len(full):
                    for image, half in zip(images, (spot < 64, spot > 63)):
                        image[full] = np.bitwise_xor.reduceat(np.where(half, bit, np.uint64(0)), first[full])
                place = np.arange(len(h)) - first[line]
                prefix = n - (num * n + den - 1) // den + 1
                listed = np.flatnonzero((place < prefix[line]) & (count > 1))
                own = line[listed]
                again, keys = listings(h[listed], count[listed], n[own], place[listed], sa[own], tile)
                own = own[again]
                x = np.empty(len(keys), ENTRY)
                x["k"], x["sa"], x["image_a"], x["image_b"], x["hint"] = keys, sa[own], images[0][own], images[1][own], hint[own]
                held.append(x)
                size += len(x)
                if size > held_most:
                    yield from pack(held)
                    held, size = [], 0
        yield from pack(held)

    return lines.filter("text is not null").select("ca", "hint", "text").mapInArrow(run, "bucket int, entries binary")


def pairs_in_lists(x: np.ndarray, num: int, den: int, line_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (z, x, apart) of entries of whole lists, sorted by key (so by list, then size), that pass the filters, z not
    earlier than x. Neighbours at distance 1, 2, ... are compared all at once; in a part no z and x comes twice."""
    n = ((x["k"] >> PLACE_BITS) & HUGE).astype(np.int32)
    left = n - (x["k"] & ((1 << PLACE_BITS) - 1)).astype(np.int32)
    name = (x["k"] >> 32).astype(np.int32)
    part, image_a, image_b, sa = (np.ascontiguousarray(c) for c in (x["hint"] >> np.uint32(line_bits), x["image_a"], x["image_b"], x["sa"]))
    i, d = np.arange(len(x)), 1
    while True:
        i = i[: np.searchsorted(i, len(x) - d)]
        j = i + d
        nj = n[j]
        ok = (name[i] == name[j]) & ((den * n[i].astype(np.int64) >= num * nj.astype(np.int64)) | (nj == HUGE))
        i, j = i[ok], j[ok]
        if not len(i):
            return
        ni, nj = n[i].astype(np.int64), n[j].astype(np.int64)
        need = needed(ni, nj, num, den)
        ok = np.flatnonzero((np.minimum(left[i], left[j]) >= need) | (nj == HUGE))
        a, b, nj = i[ok], j[ok], nj[ok]
        apart = np.bitwise_count(image_a[a] ^ image_a[b]) + np.bitwise_count(image_b[a] ^ image_b[b])
        ok = ((apart <= ni[ok] + nj - 2 * need[ok]) | (nj == HUGE)) & (sa[a] != sa[b])
        a, b, apart = a[ok], b[ok], apart[ok].astype(np.int64)
        if len(a):
            later, both = part[b] >= part[a], part[a] >= part[b]
            yield b[later], a[later], apart[later]
            yield a[both], b[both], apart[both]
        d += 1


def likeliest(x: np.ndarray, num: int, den: int, line_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(z, its likeliest x, how likely, whether z has others) for each entry that has a pair: the one least apart, then
    earliest; and the entries of any pair."""
    best, at, times, paired = np.full(len(x), LAST, np.int64), np.zeros(len(x), np.int64), np.zeros(len(x), np.int32), np.zeros(len(x), bool)
    for z, y, apart in pairs_in_lists(x, num, den, line_bits):
        score = (apart << 32) | x["hint"][y].astype(np.int64)
        times[z] += 1
        paired[z] = paired[y] = True
        ok = score < best[z]
        best[z[ok]], at[z[ok]] = score[ok], y[ok]
    z = np.flatnonzero(times)
    return z, at[z], best[z], times[z] > 1, np.flatnonzero(paired)


def one_each(x: np.ndarray) -> np.ndarray:
    """One entry of each class in a list, of those that tasks have listed, with the least hint; x and the result are sorted
    by key. Only entries that share a key are looked at."""
    same = x["k"][1:] == x["k"][:-1]
    at = np.flatnonzero(np.append(same, False) | np.insert(same, 0, False))
    y = x[at]
    y = y[np.lexsort((y["hint"], y["image_a"], y["sa"], y["k"]))]
    new = np.ones(len(x), bool)
    new[at[1:]] = (y["k"][1:] != y["k"][:-1]) | (y["sa"][1:] != y["sa"][:-1]) | (y["image_a"][1:] != y["image_a"][:-1])
    x[at] = y
    return x[new]


def in_buckets(entries: DataFrame, solve, kind: str) -> DataFrame:
    """solve(entries of a bucket, sorted by key, one per list and class) for each bucket, which comes whole to one task."""
    dealt = entries.repartition(slots(entries.sparkSession), "bucket").sortWithinPartitions("bucket")

    def whole(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        if held:
            x = np.frombuffer(b"".join(held), ENTRY)
            x = x[np.argsort(x["k"])]
            yield from solve(x if (x["k"][1:] != x["k"][:-1]).all() else one_each(x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for b in batches:
            for bucket, part in zip(b.column(0).to_pylist(), b.column(1)):
                if bucket != now:
                    yield from whole(held)
                    held, now = [], bucket
                held.append(part.as_py())
        yield from whole(held)

    return dealt.mapInArrow(run, kind)


def first_choices(entries: DataFrame, num: int, den: int, line_bits: int, row_most: int = 512) -> DataFrame:
    """(z, x, score, others, hint, list) of each line that has a pair in a list, and its likeliest pair there; and, of
    lists in which a line has others, (list, bucket, entries): the entries of pairs, at most row_most in a row."""
    buckets = 16 * slots(entries.sparkSession)
    none = {"z": pa.int64(), "x": pa.int64(), "score": pa.int64(), "others": pa.bool_(), "hint": pa.int64(), "list": pa.int32(), "bucket": pa.int32(), "entries": pa.binary()}

    def given(rows: int, **cols: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([cols[c] if c in cols else pa.nulls(rows, t) for c, t in none.items()], names=list(none))

    def solve(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        z, y, score, others, paired = likeliest(x, num, den, line_bits)
        lists = (x["k"] >> 32).astype(np.int32)
        yield given(len(z), z=pa.array(x["sa"][z]), x=pa.array(x["sa"][y]), score=pa.array(score), others=pa.array(others), hint=pa.array(x["hint"][z].astype(np.int64)), list=pa.array(lists[z]))
        m = paired[np.isin(lists[paired], lists[z[others]])]
        if len(m):
            mine = lists[m]
            at = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
            nth = np.arange(len(m)) - np.repeat(at, np.diff(at, append=len(m)))
            at = np.flatnonzero(nth % row_most == 0)
            rows = [x[m[a:c]].tobytes() for a, c in zip(at.tolist(), np.append(at[1:], len(m)).tolist())]
            yield given(len(at), list=pa.array(mine[at]), bucket=pa.array(bucket_of(mine[at], buckets)), entries=pa.array(rows, pa.binary()))

    return in_buckets(entries, solve, "z long, x long, score long, others boolean, hint long, list int, bucket int, entries binary")


def all_choices(found: DataFrame, asked: DataFrame, num: int, den: int, line_bits: int, held_most: int = 500_000) -> DataFrame:
    """(x, y, k): all pairs of the asked (list, z, x, others), each in the least list that it was found in, of which k is
    one of 16 parts, so that a long list isn't one task's. A z without others in a list has the pair (z, x) only."""
    buckets = 16 * slots(found.sparkSession)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Questions as entries without a size."""
        for b in batches:
            x = np.zeros(len(b), ENTRY)
            x["k"], x["sa"] = b.column(0).to_numpy().astype(np.int64) << 32, b.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(x["k"] >> 32, buckets)), pa.array([r.tobytes() for r in x], pa.binary())], names=["bucket", "entries"])

    def solve(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        question = (x["k"] & 0xFFFFFFFF) == 0
        wanted = set(zip((x["k"][question] >> 32).tolist(), x["sa"][question].tolist()))
        x = x[~question]
        asked_here = np.fromiter(((k, s) in wanted for k, s in zip((x["k"] >> 32).tolist(), x["sa"].tolist())), bool, len(x))
        held, size = [], 0

        def given() -> pa.RecordBatch:
            z, y = (np.concatenate(c) for c in zip(*held))
            a, b, k = np.minimum(x["sa"][z], x["sa"][y]), np.maximum(x["sa"][z], x["sa"][y]), x["k"][z] >> 32
            order = np.lexsort((k, b, a))
            a, b, k = a[order], b[order], k[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            return pa.RecordBatch.from_arrays([pa.array(c[new]) for c in (a, b, k)], names=["x", "y", "k"])

        for z, y, _ in pairs_in_lists(x, num, den, line_bits):
            mine = asked_here[z]
            held.append((z[mine], y[mine]))
            size += len(held[-1][0])
            if size > held_most:
                yield given()
                held, size = [], 0
        if held:
            yield given()

    many = asked.filter("others").select("list", "z").distinct()
    entries = found.filter("entries is not null").select("list", "bucket", "entries").join(many.select("list").distinct(), "list", "left_semi").select("bucket", "entries")
    pairs = in_buckets(entries.union(many.mapInArrow(ask, "bucket int, entries binary")), solve, "x long, y long, k long")
    only = asked.filter("not others").select(F.least("z", "x").alias("x"), F.greatest("z", "x").alias("y"), F.col("list").cast("long").alias("k"))
    return pairs.union(only).groupBy("x", "y").agg(F.min("k").alias("k")).withColumn("k", F.shiftleft("k", 4) + F.expr("pmod(xxhash64(x), 16)"))


def classes_of(lines: DataFrame, wanted: DataFrame, bits: int) -> DataFrame:
    """(sa, sb, d, r, l, text): first line and a text of each class whose sa is among wanted's (v). A bit set of fixed size
    drops most others before the shuffle."""
    order = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("d"), F.col("row").alias("r"), F.col("line").alias("l"))
    near = keep_in_bits(lines.filter("n > 0 and not again").select(F.col("ca").alias("sa"), F.col("cb").alias("sb"), order.alias("at"), "text"), "sa", wanted.select(F.col("v").alias("sa")), bits)
    one = near.groupBy("sa", "sb").agg(F.min("at").alias("at"), F.max("text").alias("text"))
    return one.select("sa", "sb", "at.d", "at.r", "at.l", "text")


def similar(a: str, b: str, num: int, den: int) -> bool:
    s, t = set(a.encode().lower().split()), set(b.encode().lower().split())
    both = len(s & t)
    return bool(both) and den * both >= num * (len(s) + len(t) - both)


def lost_by_pair(best: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The (sa, sb) of classes that a verified pair of best (z, x) shows to have an earlier similar class."""
    cols = ["sa", "sb", "d", "r", "l", "text"]
    z = best.select("z", "x").join(classes.select(*(F.col(c).alias(f"z_{c}") for c in cols)), F.col("z") == F.col("z_sa"))
    both = z.join(classes.select(*(F.col(c).alias(f"x_{c}") for c in cols)), F.col("x") == F.col("x_sa"))
    z_later = F.struct("z_d", "z_r", "z_l") > F.struct(F.col("x_d").alias("z_d"), F.col("x_r").alias("z_r"), F.col("x_l").alias("z_l"))
    loser = [F.when(z_later, F.col(f"z_{c}")).otherwise(F.col(f"x_{c}")).alias(c) for c in ("sa", "sb")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [i for i, (s, t) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())) if similar(s, t, num, den)]
            yield b.select([0, 1]).take(pa.array(ok, pa.int64()))

    return both.select(*loser, "z_text", "x_text").mapInArrow(run, "sa long, sb long").distinct()


def lost_in_lists(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The (sa, sb) of classes that have a similar class with an earlier first line. Every pair (x, y, k) is verified on
    the words of both lines, in the list named by its k; a list gets each of its lines' texts once."""
    members = pairs.select("k", F.col("x").alias("sa")).union(pairs.select("k", F.col("y").alias("sa"))).distinct()
    none = [F.lit(None).cast(t).alias(c) for c, t in (("sb", "long"), ("d", "long"), ("r", "long"), ("l", "int"), ("text", "string"))]
    given = members.join(classes, "sa").select("k", F.lit(None).cast("long").alias("y"), "sa", "sb", "d", "r", "l", "text")
    asked = pairs.select("k", "y", F.col("x").alias("sa"), *none)
    rows = given.union(asked).repartition(slots(pairs.sparkSession), "k").sortWithinPartitions(F.col("k"), F.col("y").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, have, word_of = None, {}, {}
        for b in batches:
            lost = set()
            for k, y, sa, sb, d, r, l, text in zip(*(c.to_pylist() for c in b.columns)):
                if k != now:
                    now, have, word_of = k, {}, {}
                if y is None:
                    words = frozenset(word_of.setdefault(w, len(word_of)) for w in text.encode().lower().split())
                    have.setdefault(sa, []).append((words, (d, r, l), sb))
                    continue
                for s, at_s, sb_s in have[sa]:
                    for t, at_t, sb_t in have[y]:
                        both = len(s & t)
                        if both and den * both >= num * (len(s) + len(t) - both):
                            lost.add((sa, sb_s) if at_s > at_t else (y, sb_t))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in lost], pa.int64()) for c in (0, 1)], names=["sa", "sb"])

    return rows.mapInArrow(run, "sa long, sb long").distinct()


def lost_classes(rows: DataFrame, hint: Hint, tables: Tables, num: int, den: int, bits: int, set_bits: int, tile: int) -> DataFrame:
    """(sa, sb): the classes that lose all their lines."""
    counts, lines = rows.sparkSession.sparkContext.broadcast(count_tokens(rows, bits)), rows.filter("row is not null")
    chosen = tables.write(first_choices(packed_entries(lines, counts, bits, num, den, tile), num, den, hint.line_bits), "found")
    found = chosen.filter("z is not null").drop("bucket", "entries")
    one = found.groupBy("z").agg(F.min(F.struct("score", "x")).alias("b"), F.max("others").alias("others"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.min("hint").alias("hint"))
    best = tables.write(one.select("z", F.col("b.x").alias("x"), (F.col("others") | (F.col("lo") != F.col("hi"))).alias("open"), "hint"), "best")
    classes = tables.write(classes_of(lines, best.select(F.col("z").alias("v")).union(best.select("x")), set_bits), "near")
    losers = tables.write(lost_by_pair(best, classes, num, den).withColumn("lost", F.lit(True)), "losers")
    agrees = F.shiftright("hint", hint.line_bits) == hint.part(F.col("d"))
    still = best.filter("open").join(classes.select(F.col("sa").alias("z"), "sb", "d"), "z").join(losers.withColumnRenamed("sa", "z"), ["z", "sb"], "left").filter(F.col("lost").isNull() | ~agrees)
    # A list in which the line's only pair is the one just verified holds nothing else for it.
    asked = found.join(still.select("z", F.col("x").alias("tried")).distinct(), "z").filter("others or x <> tried").select("list", "z", "x", "others")
    asked = tables.write(asked, "asked")
    tables.release("best", "near")
    if asked.isEmpty():
        tables.release("found", "asked")
        return losers
    pairs = tables.write(all_choices(chosen, asked, num, den, hint.line_bits), "pairs")
    tables.release("found", "asked")
    classes = tables.write(classes_of(lines, pairs.select(F.col("x").alias("v")).union(pairs.select("y")), set_bits), "near")
    more = tables.write(lost_in_lists(pairs, classes, num, den).withColumn("lost", F.lit(True)), "losers")
    tables.release("pairs", "near")
    return losers.union(more).distinct()


def removed_lines(docs: DataFrame, num: int = 80, den: int = 100, bits: int = 20, set_bits: int = 24, tile: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed, removed (numbers of the lines that go, from 0): one row per row of docs.

    Defined results: lines are parted by newline only, so null and empty texts have one empty line, which stays; null
    ids order last; equal ids are ordered by their place in the input; repeated rows each get a row, and the later
    one loses its lines; an empty table gives no rows; other columns are ignored."""
    tables = Tables(docs.sparkSession, "lines")
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    hint = hint_of(base)
    rows = tables.write(line_rows(base, hint, bits), "rows", **{"compression": "zstd", "parquet.enable.dictionary": "false"})
    lost = lost_classes(rows, hint, tables, num, den, bits, set_bits, tile)
    # Lines that come after one of their class which their task has seen are gone; the others of a class are few: one a task, and more where a task's lines don't come in their order.
    rank = F.row_number().over(Window.partitionBy("ca", "cb").orderBy("d", "row", "line"))
    ranked = rows.filter("n > 0 and not again").select("ca", "cb", F.coalesce("doc_id", F.lit(LAST)).alias("d"), "row", "line").withColumn("rank", rank)
    later = ranked.join(lost.select(F.col("sa").alias("ca"), F.col("sb").alias("cb"), "lost"), ["ca", "cb"], "left").filter("rank > 1 or lost").select("row", "line")
    gone = later.union(rows.filter("again").select("row", "line"))
    per_row = gone.groupBy("row").agg(F.sort_array(F.collect_list("line")).alias("removed"))
    sizes = rows.filter("line = 0").select("row", "doc_id", F.col("n_lines").cast("long").alias("n_lines"))
    out = sizes.join(per_row, "row", "left")
    return out.select("doc_id", "n_lines", F.greatest(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def drop_lines(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without their removed lines; ids must be unique."""
    keep = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1), lambda x, i: ~F.array_contains("removed", i))
    joined = docs.join(removed.select(F.col("doc_id").alias(id_col), "removed"), id_col)
    return joined.withColumn(text_col, F.array_join(keep, "\n")).drop("removed")
