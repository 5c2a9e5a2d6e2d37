"""Alignment of two tokenizers over a corpus (operator 11): a byte-level BPE (A) and a SentencePiece BPE (B).

1. A text with a space in front is cut before each run of white space that starts with a space (or a newline, if no
   piece holds one): both tokenizers end a token there, so the chunks between cuts are aligned apart from each other,
   each distinct one once per worker.
2. Byte lengths of the tokens of many chunks give the ends by a cumulative sum; ends common to both sides
   (`intersect1d`) cut the tokens into groups (`searchsorted`), and each A token is repeated for each B token whose
   bytes overlap its own: the links.
3. Each task counts in how many documents an id pair is linked; the sums meet in two stages, the first by pair and
   salt, so a pair that all documents hold costs a task no more than others.
4. A second pass gives each document the counts of its links. The most frequent pairs, as many as `few` holds, are
   broadcast (the counts above some power of two); links of rarer pairs meet their counts in a join."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.bpe import groups
from corvane.llm.common import Tables, env_single_thread, lean_worker

SPACE = "▁"
_PLAIN = re.compile(r" ?\S+")


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the others in order from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}


class Aligner:
    """Token ids, groups and links of chunks. At most about `words` chunks are kept, the most used ones."""

    def __init__(self, path_a: str, path_b: str, words: int = 1_000_000):
        env_single_thread()
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True  # in a text their strings are plain
        rule = json.loads(self.a.to_str())
        if rule["normalizer"] or rule["pre_tokenizer"]["type"] != "ByteLevel" or rule["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("the first tokenizer must be a byte-level BPE without normaliser and prefix")
        letter = byte_letters()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for w, i in vocab.items():
            self.bytes_a[i] = bytes(letter[c] for c in w) if all(c in letter for c in w) else w.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece crosses a word boundary")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.shift = max(1, (len(pieces) - 1).bit_length())  # a pair is a << shift | b
        self.lone = self.b.piece_to_id(SPACE)
        self.newline = not any("\n" in p for p in pieces)
        gap = r"[^\S \n]" if self.newline else r"[^\S ]"
        self.chunk = re.compile(rf"\s*\S+(?:{gap}\s*\S*)*|\s+")
        self.end_id = self.a.encode("\n", add_special_tokens=False).ids
        self.words = words
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.text: list[bytes] = []
        self.size = np.zeros((0, 4), np.int32)  # n_a, n_b, n_groups, n_links
        self.first, self.pairs = np.zeros(1, np.int64), np.zeros(0, np.int64)
        self.whole, self.used = np.zeros(0, bool), np.zeros(0, np.int32)
        self.sums: tuple[object, np.ndarray] | None = None

    def shrink(self) -> None:
        """Keep the half that was used most."""
        keep = np.sort(np.argsort(-self.used, kind="stable")[: self.words // 2])
        names = list(self.index)
        self.index = {names[i]: k for k, i in enumerate(keep.tolist())}
        self.text = [self.text[i] for i in keep.tolist()]
        self.pairs, self.first = self.pairs_of(keep)
        self.size, self.whole, self.used = self.size[keep], self.whole[keep], self.used[keep] // 2
        self.sums = None

    def cut(self, text: str) -> list[str]:
        return self.chunk.findall(" " + text) if text else []

    def ids_a(self, chunks: list[str], plain: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks, how many each has). The first `plain` are of one word: they are joined by newlines, which
        are tokens of their own there, and cut apart again."""
        flat, sizes = [], []
        for k in range(0, plain, 20_000):
            some = chunks[k : min(k + 20_000, plain)]
            ids = np.array(self.a.encode("\n".join(some), add_special_tokens=False).ids, np.int64)
            own = ids != self.end_id[0]
            n = np.diff(np.flatnonzero(~own), prepend=-1, append=len(ids)) - 1
            if len(n) != len(some):
                each = [e.ids for e in self.a.encode_batch_fast(some, add_special_tokens=False)]
                ids, own, n = np.array([*chain.from_iterable(each)], np.int64), slice(None), np.array([len(x) for x in each])
            flat.append(ids[own])
            sizes.append(n)
        each = [e.ids for e in self.a.encode_batch_fast(chunks[plain:], add_special_tokens=False)]
        flat.append(np.array([*chain.from_iterable(each)], np.int64))
        sizes.append(np.array([len(x) for x in each], np.int64))
        return np.concatenate(flat), np.concatenate(sizes)

    def ids_b(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library puts a space in front of each: the chunk's own, or one to take away before a newline."""
        each = self.b.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        for k, c in enumerate(chunks):
            if c[0] != " ":
                each[k] = each[k][1:]
            elif len(c) == 1:
                each[k] = [self.lone]
        return np.array([*chain.from_iterable(each)], np.int64), np.array([len(x) for x in each], np.int64)

    def given_back(self, chunks: list[str], ids: np.ndarray, n: np.ndarray, of_id: list[bytes], size: np.ndarray) -> np.ndarray:
        """Which chunks are the joined bytes of their tokens: all at once, and each apart where that fails."""
        raw = [c.encode() for c in chunks]
        flat, end = ids.tolist(), np.cumsum(n)
        total = np.concatenate([[0], np.cumsum(size[ids])])
        if b"".join(map(of_id.__getitem__, flat)) == b"".join(raw) and (np.diff(total[end], prepend=0) == np.fromiter(map(len, raw), np.int64, len(raw))).all():
            return np.ones(len(chunks), bool)
        return np.array([b"".join(map(of_id.__getitem__, flat[j - k : j])) == r for j, k, r in zip(end.tolist(), n.tolist(), raw)], bool)

    def learn(self, new: list[str]) -> None:
        plain = [c for c in new if _PLAIN.fullmatch(c)] if len(self.end_id) == 1 else []
        chunks = plain + list(set(new).difference(plain))
        a, n_a = self.ids_a(chunks, len(plain))
        b, n_b = self.ids_b(chunks)
        whole = self.given_back(chunks, a, n_a, self.bytes_a, self.len_a) & self.given_back(chunks, b, n_b, self.bytes_b, self.len_b)
        if not whole.all():
            a, b, n_a, n_b = a[np.repeat(whole, n_a)], b[np.repeat(whole, n_b)], n_a[whole], n_b[whole]
        good = np.flatnonzero(whole)
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        low = np.searchsorted(end_b, end_a - self.len_a[a], side="right")
        many = np.searchsorted(end_b, end_a, side="left") - low + 1
        link_a = np.repeat(np.arange(len(a)), many)
        link_b = np.arange(len(link_a)) - np.repeat(np.cumsum(many) - many, many) + low[link_a]
        size = np.zeros((len(chunks), 4), np.int32)
        last_a = np.cumsum(n_a)
        last_group = group_a[last_a - 1] + 1 if len(good) else np.zeros(0, np.int64)
        size[good] = np.stack([n_a, n_b, np.diff(last_group, prepend=0), np.add.reduceat(many, last_a - n_a) if len(good) else n_a], axis=1)
        cut_a, cut_b = (np.searchsorted(g, np.arange(len(common) + 1)).tolist() for g in (group_a, group_b))
        name_a, name_b = ([*map(str, x.tolist())] for x in (a, b))
        texts = [f"{','.join(name_a[i:j])}|{','.join(name_b[x:y])}" for i, j, x, y in zip(cut_a, cut_a[1:], cut_b, cut_b[1:])]
        of_chunk, at = [b""] * len(chunks), 0
        for k, z in zip(good.tolist(), last_group.tolist()):
            of_chunk[k] = ";".join(texts[at:z]).encode()
            at = z
        base = len(self.index)
        self.index.update(zip(chunks, range(base, base + len(chunks))))
        self.text += of_chunk
        self.size = np.concatenate([self.size, size])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(size[:, 3], dtype=np.int64)])
        self.pairs = np.concatenate([self.pairs, a[link_a] << self.shift | b[link_b]])
        self.whole = np.concatenate([self.whole, whole])
        self.used = np.concatenate([self.used, np.zeros(len(chunks), np.int32)])

    def chunks_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(chunk numbers of all texts, the text of each, which texts have tokens)."""
        parts = [self.cut(t) for t in texts]
        if len(self.index) > self.words:
            self.shrink()
        new = [c for c in set().union(*parts) if c not in self.index]
        if new:
            self.learn(new)
        n = np.array([len(p) for p in parts], np.int64)
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(parts)), np.int64, int(n.sum()))
        self.used += np.bincount(at, minlength=len(self.used)).astype(np.int32)
        of = np.repeat(np.arange(len(texts)), n)
        ok = (n > 0) & (np.bincount(of[~self.whole[at]], minlength=len(texts)) == 0)
        has = ok[of]
        return at[has], of[has], ok

    def pairs_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of these chunks and where each chunk's start, with the end."""
        n = self.size[at, 3]
        ends = np.concatenate([[0], np.cumsum(n)])
        return self.pairs[np.arange(ends[-1]) + np.repeat(self.first[at] - ends[:-1], n)], ends

    def known_sums(self, table: tuple[np.ndarray, np.ndarray, np.ndarray], key: object, some: int = 100_000) -> np.ndarray:
        """(n_best, count_sum, links of pairs outside the table) of each chunk; those since the last call are looked up."""
        if not (self.sums and self.sums[0] == key):
            self.sums = (key, np.zeros((0, 3), np.int64))
        pairs, count, best = table
        out = [self.sums[1]]
        for k in range(len(out[0]), len(self.size), some):
            ends = self.first[k : k + some + 1]
            own = self.pairs[ends[0] : ends[-1]]
            at = np.minimum(np.searchsorted(pairs, own), max(len(pairs) - 1, 0))
            inside = pairs[at] == own if len(pairs) else np.zeros(len(own), bool)
            run = [np.concatenate([[0], np.cumsum(x)]) for x in ((np.where(inside, best[at], 0), np.where(inside, count[at], 0), ~inside) if len(pairs) else (inside, inside, ~inside))]
            out.append(np.stack([x[ends[1:] - ends[0]] - x[ends[:-1] - ends[0]] for x in run], axis=1))
        self.sums = (key, np.concatenate(out))
        return self.sums[1]


@lru_cache(maxsize=1)
def shared_aligner(path_a: str, path_b: str) -> Aligner:
    """The Python worker's own: what one task has learnt serves the next, and the second pass."""
    return Aligner(path_a, path_b)


def pair_counts(rows: DataFrame, path_a: str, path_b: str, salts: int = 16, held: int = 2_000_000) -> DataFrame:
    """(a, b, n): in how many rows the id pair is linked. rows: (doc_id, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, salt = shared_aligner(path_a, path_b), TaskContext.get().partitionId() % salts
        some: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            p, n = (np.concatenate([s[i] for s in some]) if some else np.zeros(0, np.int64) for i in (0, 1))
            p, inverse = np.unique(p, return_inverse=True)
            return p, np.bincount(inverse, weights=n, minlength=len(p)).astype(np.int64)

        def batch() -> pa.RecordBatch:
            p, n = merged()
            return pa.RecordBatch.from_arrays([pa.array(p >> x.shift), pa.array(p & ((1 << x.shift) - 1)), pa.array(np.full(len(p), salt)), pa.array(n)], names=["a", "b", "salt", "n"])

        for b in batches:
            for _, texts in groups(b.column(1).to_pylist()):
                at, of, _ = x.chunks_of(texts)
                each = np.unique(of * len(x.index) + at)  # a document's distinct chunks, then its distinct pairs
                of, at = each // max(len(x.index), 1), each % max(len(x.index), 1)
                pairs, ends = x.pairs_of(at)
                of = np.repeat(of, np.diff(ends))
                by = np.lexsort([of, pairs]) if len(texts) >= 1 << (62 - 2 * x.shift) else np.argsort(pairs * len(texts) + of)
                pairs, of = pairs[by], of[by]
                first = np.ones(len(pairs), bool)
                first[1:] = (pairs[1:] != pairs[:-1]) | (of[1:] != of[:-1])
                some.append(np.unique(pairs[first], return_counts=True))
                if sum(len(p) for p, _ in some) > held:
                    some = [merged()]
                    if len(some[0][0]) > held // 2:
                        yield batch()
                        some = []
        if some:
            yield batch()

    seen = rows.mapInArrow(run, "a long, b long, salt long, n long")
    return seen.groupBy("a", "b", "salt").agg(F.sum("n").alias("n")).groupBy("a", "b").agg(F.sum("n").alias("n"))


def total(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the parts that end there."""
    run = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.diff(run[ends], prepend=0)


def most_frequent(counts: DataFrame, few: int) -> int:
    """The least power of two such that at most `few` pairs have that count or a greater one."""
    left = few
    for r in counts.groupBy(F.floor(F.log2("n")).alias("e")).agg(F.count("*").alias("k")).orderBy(F.desc("e")).collect():  # 63 rows at most
        left -= r["k"]
        if left < 0:
            return 1 << (r["e"] + 1)
    return 0


COLUMNS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
RARE = "array<struct<a:long,b:long,k:long>>"


def align_documents(docs: DataFrame, path_a: str, path_b: str, few: int = 2_000_000, keep_groups: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair count is the highest of
    their A id), count_sum (of the pair counts over the links), groups_sha256, and if asked the groups as text. Texts
    aren't shuffled; a worker holds two million letters of texts, or one text, and its known chunks.

    Defined results: null and empty texts, and texts that either tokenizer doesn't give back byte for byte, have no
    tokens: zeros and an empty string; null ids stay; each of repeated rows counts as a document; an empty table gives
    no rows; other columns are ignored."""
    tables = Tables(docs.sparkSession, "alignment")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    counts = tables.write(pair_counts(rows, path_a, path_b), "counts")
    top = counts.groupBy("a").agg(F.max("n").alias("most"))
    counts = tables.write(counts.join(top, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")
    least = most_frequent(counts, few)
    known = counts.filter(F.col("n") >= least).toArrow()  # `few` rows at most
    columns = [known[c].to_numpy() for c in ("a", "b", "n", "best")]
    shared = docs.sparkSession.sparkContext.broadcast(columns)
    key = tables.paths["pairs"][-1]
    schema = COLUMNS + f", rare {RARE}" * (least > 0) + ", groups string" * keep_groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = shared_aligner(path_a, path_b)
        a, b, n, best = shared.value
        pairs = a << x.shift | b
        by = np.argsort(pairs)
        table = pairs[by], n[by], best[by]
        names = [c.split(" ")[0] for c in COLUMNS.split(", ")]
        for batch in batches:
            for k, texts in groups(batch.column(1).to_pylist()):
                at, of, ok = x.chunks_of(texts)
                sums = x.known_sums(table, key)
                cols = [np.zeros(len(texts), np.int64) for _ in range(6)]
                ends = np.cumsum(np.bincount(of, minlength=len(texts)))
                if len(at):
                    cols = [total(y[at, i], ends) for y, i in ((x.size, 0), (x.size, 1), (x.size, 2), (x.size, 3), (sums, 0), (sums, 1))]
                flat, get = at.tolist(), x.text.__getitem__
                joined = [b";".join(map(get, flat[i:j])) for i, j in zip([0, *ends[:-1].tolist()], ends.tolist())]
                out = [batch.column(0).slice(k, len(texts)), *map(pa.array, cols), pa.array([hashlib.sha256(s).hexdigest() if good else "" for s, good in zip(joined, ok.tolist())])]
                if least:
                    some = np.flatnonzero(sums[at, 2] > 0)
                    p, e = x.pairs_of(at[some])
                    away = np.searchsorted(table[0], p)
                    away = p != table[0][np.minimum(away, len(table[0]) - 1)] if len(table[0]) else np.ones(len(p), bool)
                    d, p = np.repeat(of[some], np.diff(e))[away], p[away]
                    lists: list[list[dict]] = [[] for _ in texts]
                    for i in np.split(np.lexsort([p, d]), np.flatnonzero(np.diff(np.sort(d))) + 1) if len(d) else []:
                        q, c = np.unique(p[i], return_counts=True)
                        lists[int(d[i[0]])] = [dict(a=v >> x.shift, b=v & ((1 << x.shift) - 1), k=m) for v, m in zip(q.tolist(), c.tolist())]
                    out.append(pa.array(lists, pa.list_(pa.struct([(c, pa.int64()) for c in "abk"]))))
                if keep_groups:
                    out.append(pa.array([s.decode() for s in joined]))
                yield pa.RecordBatch.from_arrays(out, names=[*names, *["rare"] * (least > 0), *["groups"] * keep_groups])
        lean_worker()

    found = rows.mapInArrow(run, schema)
    if not least:
        return found
    found = tables.write(found.withColumn("row", F.monotonically_increasing_id()), "documents")
    rest = found.select("row", F.inline("rare")).join(counts, ["a", "b"])
    rest = rest.groupBy("row").agg(F.sum(F.col("k") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("k") * F.col("n")).alias("more"))
    own = [c for c in found.columns if c not in ("row", "rare")]
    add = {"n_best": "more_best", "count_sum": "more"}
    return found.join(rest, "row", "left").select(*((F.col(c) + F.coalesce(F.col(add[c]), F.lit(0))).alias(c) if c in add else c for c in own))
