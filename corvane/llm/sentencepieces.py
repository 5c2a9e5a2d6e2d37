"""SentencePiece (BPE model) encoding and decoding by suffix-array matching (operator 7).

A text is normalised as the model says (identity, spaces become U+2581, one is put in front) and cut before each run
of U+2581: no piece crosses such a cut. Of the chunks of a batch that the worker hasn't met, the distinct ones are
laid end to end and indexed by a suffix array, as deep as the longest piece. Each piece's occurrences are the range
of suffixes that begin with it, found by two binary searches. The occurrences are edges (position, length -> piece),
sorted by position. Then chunks relax together: in each round, every chunk merges its leftmost adjacent pair whose
joined edge has the best score, until no edge joins two neighbours. Characters that no piece holds become byte pieces.

Decoding joins the pieces' strings and undoes the normalisation."""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.bpe import groups

SPACE = "▁"
NONE = np.int64(1 << 40)


def fields(message: bytes) -> list[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields, numbers and byte strings."""
    out, at = [], 0

    def number() -> int:
        nonlocal at
        x = shift = 0
        while True:
            b = message[at]
            at += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while at < len(message):
        tag = number()
        size = {0: None, 1: 8, 5: 4}.get(tag & 7, -1)
        if size is None:
            out.append((tag >> 3, number()))
            continue
        size = number() if size < 0 else size
        out.append((tag >> 3, message[at : at + size]))
        at += size
    return out


def check_model(proto: bytes) -> None:
    """ValueError unless the model is a BPE model (trainer field 3 is 2) with the identity normaliser (field 1, its name)
    that adds a space in front (3, if not 0) and keeps spaces (4, 0)."""
    parts = dict(x for x in fields(proto) if x[0] in (2, 3))
    trainer, norm = (dict(fields(parts.get(k, b""))) for k in (2, 3))
    if trainer.get(3, 1) != 2:
        raise ValueError("not a BPE model")
    if norm.get(1, b"") != b"identity" or not norm.get(3, 1) or norm.get(4, 1):
        raise ValueError("the model's normaliser changes texts")


class Pieces:
    """encode(texts) -> ids as little-endian u32 bytes; decode(ids) -> text. At most `words` chunks are kept."""

    def __init__(self, model: str, words: int = 300_000, long_chunk: int = 64):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        check_model(sp.serialized_model_proto())
        self.words, self.long, self.cache = words, long_chunk, {"": b""}
        n = sp.vocab_size()
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_id = [0] * 256
        pieces: list[tuple[str, int, float]] = []
        for i in range(n):
            s = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(s[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(s[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                pieces.append((s, i, sp.get_score(i)))
                self.bytes_of[i] = s.encode().replace(SPACE.encode(), b" ")
        if any(SPACE in s.lstrip(SPACE) for s, _, _ in pieces):
            raise ValueError("a piece crosses a word boundary")
        if max(len(s) for s, _, _ in pieces) > 62:
            raise ValueError("a piece of more than 62 letters")
        self.depth = -(-max(len(s) for s, _, _ in pieces) // 4) * 4
        self.letters = {c: k + 1 for k, c in enumerate(sorted({c for s, _, _ in pieces for c in s}))}
        top = max(map(ord, self.letters)) + 1
        self.code = np.zeros(top, np.uint16)
        self.single = {s: i for s, i, _ in pieces if len(s) == 1}
        for c, k in self.letters.items():
            self.code[ord(c)] = k
        order = sorted(pieces, key=lambda p: -p[2])  # stable: equal scores share a rank
        rank, last = -1, None
        self.rank: dict[int, int] = {}
        for _, i, score in order:
            rank += score != last
            last = score
            self.rank[i] = rank
        many = [(s, i) for s, i, _ in pieces if len(s) > 1]
        self.piece_len = np.array([len(s) for s, _ in many])
        self.piece_id = np.array([i for _, i in many])
        self.piece_rank = np.array([self.rank[i] for i in self.piece_id], np.int64)
        low, high = np.zeros((len(many), self.depth), ">u2"), np.full((len(many), self.depth), 0xFFFF, ">u2")
        for k, (s, _) in enumerate(many):
            low[k, : len(s)] = high[k, : len(s)] = [self.letters[c] for c in s]
        self.low, self.high = (np.frombuffer(x.tobytes(), f"S{2 * self.depth}") for x in (low, high))
        alone = "" if "\n" in self.letters else "\n"
        self.chunk = re.compile(rf"{SPACE}*[^{SPACE}{alone}]+|\n|{SPACE}+" if alone else rf"{SPACE}*[^{SPACE}]+|{SPACE}+")

    # -- index, search, relax

    def edges(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """flat: letters with a 0 after each chunk. Sorted (position << 6 | length) of all occurrences, and which piece each is."""
        n, d = len(flat), self.depth
        padded = np.concatenate([flat, np.zeros(d, np.uint16)])
        wide = np.lib.stride_tricks.sliding_window_view(padded, d)[:n].astype(">u2")
        ends = np.flatnonzero(flat == 0)
        left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # nothing is seen past a chunk's end
        wide[np.arange(d)[None, :] >= left[:, None]] = 0
        words = np.ascontiguousarray(wide).view(">u8").astype(np.uint64)
        suffixes = np.lexsort([words[:, k] for k in range(words.shape[1] - 1, -1, -1)])
        sorted_keys = np.frombuffer(np.ascontiguousarray(wide[suffixes]).tobytes(), f"S{2 * d}")
        lo, hi = np.searchsorted(sorted_keys, self.low, side="left"), np.searchsorted(sorted_keys, self.high, side="right")
        size = np.maximum(hi - lo, 0)
        which = np.repeat(np.arange(len(size)), size)
        at = suffixes[np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
        key = (at.astype(np.int64) << 6) | self.piece_len[which]
        by_position = np.argsort(key, kind="stable")
        return key[by_position], which[by_position]

    def relax(self, chunks: list[str]) -> list[bytes]:
        chars = np.frombuffer("\0".join([*chunks, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
        sizes = np.array([len(c) for c in chunks])
        starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        flat = np.where(chars < len(self.code), self.code[np.minimum(chars, len(self.code) - 1)], 0).astype(np.uint16)
        # A character of no piece is a break like a chunk's end; both are 0.
        keys, which = self.edges(flat) if len(flat) else (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def find(start: np.ndarray, end: np.ndarray) -> np.ndarray:
            if not len(keys):
                return np.full(len(start), -1)
            want = (start << 6) | np.minimum(end - start, 63)
            i = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            return np.where(keys[i] == want, i, -1)

        def score(start: np.ndarray, end: np.ndarray) -> np.ndarray:
            i = find(start, end)
            return np.where(i >= 0, self.piece_rank[which[i]] if len(which) else NONE, NONE)

        chunk_of = np.repeat(np.arange(len(chunks)), sizes)
        s = np.arange(len(chunk_of)) + chunk_of  # one separator before each later chunk
        e = s + 1
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        late = np.flatnonzero(sizes > self.long)
        if len(late):
            on = sizes[chunk_of] <= self.long
            for c in late.tolist():
                done.append(self.heap(int(starts[c]), int(sizes[c]), c, find, which))
            chunk_of, s, e = chunk_of[on], s[on], e[on]

        def pair_scores(idx: np.ndarray) -> np.ndarray:
            """Scores of symbol idx with the next one."""
            out = np.full(len(idx), NONE)
            ok = idx + 1 < len(s)
            ok[ok] = chunk_of[idx[ok]] == chunk_of[idx[ok] + 1]
            out[ok] = score(s[idx[ok]], e[idx[ok] + 1])
            return out

        pair = pair_scores(np.arange(len(s)))
        while len(s):
            first = np.flatnonzero(np.concatenate([[True], chunk_of[1:] != chunk_of[:-1]]))
            best = np.minimum.reduceat(pair, first)
            group = np.cumsum(np.concatenate([[0], (chunk_of[1:] != chunk_of[:-1]).astype(np.int64)]))
            over = best[group] == NONE
            if over.any():
                done.append((chunk_of[over], s[over], e[over]))
                chunk_of, s, e, pair = chunk_of[~over], s[~over], e[~over], pair[~over]
                continue
            hit = np.flatnonzero(pair == best[group])
            hit = hit[np.concatenate([[True], group[hit][1:] != group[hit][:-1]])]
            e[hit] = e[hit + 1]
            keep = np.ones(len(s), bool)
            keep[hit + 1] = False
            new = np.cumsum(keep) - 1
            hit = new[hit]
            chunk_of, s, e, pair = chunk_of[keep], s[keep], e[keep], pair[keep]
            near = np.zeros(len(s), bool)
            near[hit] = near[hit[hit > 0] - 1] = True
            again = np.flatnonzero(near)
            pair[again] = pair_scores(again)
        chunk_of, s, e = (np.concatenate([d[k] for d in done]) if done else np.zeros(0, np.int64) for k in range(3))
        order = np.lexsort([s, chunk_of])
        chunk_of, s, e = chunk_of[order], s[order], e[order]
        many = e - s > 1
        ids = np.full(len(s), -1, np.int64)
        ids[many] = self.piece_id[which[find(s[many], e[many])]] if many.any() else ids[many]
        lone = np.flatnonzero(~many)
        of_char = {int(c): self.single.get(chr(c), -1) for c in np.unique(chars[s[lone]]).tolist()}
        ids[lone] = [of_char[c] for c in chars[s[lone]].tolist()]
        cut = np.searchsorted(chunk_of, np.arange(len(chunks) + 1)).tolist()
        known = ids.astype("<u4").tobytes()
        bad = set(chunk_of[ids < 0].tolist())
        out = []
        for c in range(len(chunks)):
            if c in bad:
                row: list[int] = []
                for k in range(cut[c], cut[c + 1]):
                    row += [int(ids[k])] if ids[k] >= 0 else [self.byte_id[b] for b in chr(chars[s[k]]).encode("utf-8", "replace")]
                out.append(np.array(row, "<u4").tobytes())
            else:
                out.append(known[4 * cut[c] : 4 * cut[c + 1]])
        return out

    def heap(self, start: int, size: int, c: int, find, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One very long chunk, by an agenda of pairs."""
        end, prev = {start + k: start + k + 1 for k in range(size)}, {start + k: start + k - 1 for k in range(size)}
        last = start + size

        def look(a: np.ndarray, b: np.ndarray) -> list[int]:
            i = find(a, b)
            return np.where(i >= 0, self.piece_rank[which[i]], -1).tolist() if len(which) else [-1] * len(a)

        a = np.arange(start, last - 1)
        agenda = [(r, p, p + 1, p + 2) for p, r in zip(a.tolist(), look(a, a + 2)) if r >= 0]
        heapq.heapify(agenda)
        while agenda:
            _, p, mid, z = heapq.heappop(agenda)
            if end.get(p) != mid or end.get(mid) != z:
                continue
            end[p] = z
            del end[mid]
            if z < last:
                prev[z] = p
            for x, y in ((prev[p], z), (p, end.get(z, 0))):
                if x >= start and y > 0 and x in end and end[x] < y:
                    r = look(np.array([x]), np.array([y]))[0]
                    if r >= 0:
                        heapq.heappush(agenda, (r, x, end[x], y))
        s = np.array(sorted(end), np.int64)
        return np.full(len(s), c), s, np.array([end[x] for x in s.tolist()], np.int64)

    # -- whole texts

    def normalise(self, text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [self.chunk.findall(self.normalise(t)) for t in texts]
        every, have = set().union(*parts), self.cache
        new = {w for w in every if w not in have}
        if new:
            if len(self.cache) + len(new) > self.words:
                self.cache = {w: v for w, v in self.cache.items() if len(w) <= 6} if len(self.cache) < 4 * self.words else {}
                new = {w for w in every if w not in self.cache}
            todo, at = list(new), 0
            while at < len(todo):  # about a million letters are indexed at once
                z, size = at, 0
                while z < len(todo) and (z == at or size + len(todo[z]) < 1_000_000):
                    size += len(todo[z]) + 1
                    z += 1
                self.cache.update(zip(todo[at:z], self.relax(todo[at:z])))
                at = z
        get = self.cache.__getitem__
        return [b"".join(map(get, p)) for p in parts]

    def decode(self, ids: bytes) -> str:
        get = self.bytes_of.__getitem__
        return b"".join(map(get, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")[1:]


@lru_cache(maxsize=2)
def shared_pieces(model: str) -> Pieces:
    """The Python worker's own: what one task has learnt serves the next."""
    return Pieces(model)


def encode_documents(docs: DataFrame, model: str, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (little-endian u32 ids), decoded_crc32 (UTF-8 of the decoded text), round_trip
    (it equals the text, U+2581 read as space), and the ids if asked. One row per row of docs, in one pass.

    Defined results: null text counts as empty and has no pieces; null ids stay; repeated rows are encoded each; an
    empty table gives no rows; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared_pieces(model)
        for b in batches:
            for k, texts in groups(b.column(1).to_pylist(), 4_000_000):
                ids = p.encode(texts)
                back = [p.decode(x) for x in ids]
                cols = [b.column(0).slice(k, len(texts)), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.encode()) for x in back], pa.int64()), pa.array([x == t.replace(SPACE, " ") for x, t in zip(back, texts)])]
                names = ["doc_id", "n_pieces", "ids_crc32", "decoded_crc32", "round_trip"]
                if keep_ids:
                    cols.append(pa.array([np.frombuffer(x, "<u4").tolist() for x in ids], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, decoded_crc32 long, round_trip boolean" + ", ids array<long>" * keep_ids)
