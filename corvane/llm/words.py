"""Word hashes of whole Arrow batches of texts, without a Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything but ASCII letters, digits and bytes of other alphabets.
NOT_ALNUM = np.array([not (x >= 128 or chr(x).isalnum()) for x in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: A block's lowest 0 to 8 bytes.
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
_LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer (fixed values)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    off = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def bounds(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end; no word crosses a text's end."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~sep[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before, after = np.empty_like(word), np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    after[-1], after[:-1] = False, word[1:]
    return np.flatnonzero(word & (~before | first[:-1])), np.flatnonzero(word & (~after | first[1:])) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 1 << 21) -> np.ndarray:
    """64-bit hash of each word of lower-cased bytes: its length, then its blocks of eight bytes, each mixed in before
    the next. Not linear in the bytes, so words don't collide by their structure. Works on about `most` bytes at a time."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + most, side="right")))
        a, z = int(starts[lo]), int(ends[lo:hi].max())
        text = np.zeros(z - a + 8, np.uint8)
        text[: z - a] = LOWER[data[a:z]]
        block_at = np.ndarray((z - a + 1,), "<u8", text, 0, (1,))
        at, left = starts[lo:hi] - a, ends[lo:hi] - starts[lo:hi]
        h = mix(left.astype(np.uint64) + _ODD)
        for k in np.flatnonzero(left > _LONG).tolist():
            h[k] = xxhash.xxh3_64_intdigest(text[at[k] : at[k] + left[k]].tobytes())
        live = np.flatnonzero(left <= _LONG)
        at, left = at[live], left[live]
        while len(live):
            block = block_at[at] & _LOW[np.minimum(left, 8)]
            h[live] = mix((h[live] ^ block) * _ODD + np.uint64(1))
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
        out[lo:hi] = h
        lo = hi
    return mix(out)


def word_hashes(texts: pa.Array, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of the batch, for each text the first of its words; one more entry ends the last text)."""
    data, offsets = buffers(texts)
    s, e = bounds(data, offsets, sep)
    return hashes(data, s, e), np.searchsorted(s, offsets)


def slices(batch: pa.RecordBatch, column: int, most: int = 4_000_000):
    """Parts of a batch of about `most` bytes of text."""
    texts = batch.column(column)
    if not len(texts):
        return
    _, off = buffers(texts)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of one text's k-word shingles, as a sorted set; of the whole sequence if it has fewer words."""
    n = len(h)
    if not n:
        return h
    m = min(k, n)
    x = np.zeros(n - m + 1, np.uint64)
    for j in range(m):
        x = mix(x * np.uint64(3) + h[j : n - m + 1 + j] + np.uint64(j + 1))
    x.sort()
    return x if len(x) < 2 else x[np.concatenate([[True], x[1:] != x[:-1]])]
