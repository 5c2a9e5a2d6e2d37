"""Edit-aware token counts (operator 10).

A document is kept as a segment tree over its pre-tokens: leaves hold runs of pre-tokens with their token counts,
inner nodes the sums of characters and tokens below. An edit descends to the leaf it touches, re-splits only the
pre-tokens it touches with two pre-tokens before them, until the new boundaries meet the old ones, re-encodes only
pre-tokens that are new there, and updates the sums on the way up.

Why that is enough: the splitting pattern reads left to right, starts afresh at each boundary, and looks one
character ahead, or past a run of white space, which is at most two pre-tokens. So the two before the edited one may
change, an earlier one can't; and where a new boundary falls on an old one behind the edit, all that follows is as it
was."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.bpe import Encoder, groups

LEAF = 32


class Counter(Encoder):
    """Token counts of pre-tokens, each distinct one encoded once."""

    def pre_tokens(self, text: str) -> list[str]:
        p = self.split(text)
        if p is None:
            p = [text[a:z] for _, (a, z) in self.lib.pre_tokenizer.pre_tokenize_str(text)]
            if "".join(p) != text or "<|" in text:  # added tokens are matched before splitting: one indivisible pre-token
                p = [text]
        return p

    def counts(self, words: list[str]) -> list[int]:
        self.know([words])
        get = self.cache.__getitem__
        return [len(get(w)) >> 2 for w in words]


@lru_cache(maxsize=2)
def shared_counter(path: str) -> Counter:
    return Counter(path)


class CountTree:
    """Token counts of one text under edits. total: tokens; encoded: pre-tokens encoded so far."""

    def __init__(self, counter: Counter, text: str, words: list[str] | None = None, counts: list[int] | None = None):
        self.counter, self.encoded = counter, 0
        words = counter.pre_tokens(text) if words is None else words
        self.build(words, counter.counts(words) if counts is None else counts)

    def build(self, words: list[str], counts: list[int]) -> None:
        n = max(1, -(-len(words) // LEAF))
        self.size = 1 << (n - 1).bit_length()
        self.leaves = [(words[k : k + LEAF], counts[k : k + LEAF]) for k in range(0, n * LEAF, LEAF)]
        self.leaves += [([], [])] * (self.size - n)
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for k, (w, c) in enumerate(self.leaves):
            self.chars[self.size + k], self.tokens[self.size + k] = sum(map(len, w)), sum(c)
        for k in range(self.size - 1, 0, -1):
            self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(w for words, _ in self.leaves for w in words)

    def find(self, at: int) -> tuple[int, int]:
        """(leaf that holds character `at`, characters before it); the last leaf with text for the end."""
        k, before = 1, 0
        at = min(at, max(self.length - 1, 0))
        while k < self.size:
            k *= 2
            if at - before >= self.chars[k]:
                before += self.chars[k]
                k += 1
        return k - self.size, before

    def words_before(self, at: int) -> tuple[int, int, int]:
        """(leaf, index, start) of the pre-token before the one that holds character `at` (that one if it is the first)."""
        leaf, start = self.find(at)
        words, i = self.leaves[leaf][0], 0
        while i + 1 < len(words) and start + len(words[i]) <= at:
            start += len(words[i])
            i += 1
        if start == 0 or not words:
            return leaf, i, start
        if i:
            return leaf, i - 1, start - len(words[i - 1])
        leaf, before = self.find(start - 1)
        return leaf, len(self.leaves[leaf][0]) - 1, start - len(self.leaves[leaf][0][-1])

    def edit(self, at: int, cut: int, text: str) -> None:
        """Replace `cut` characters from `at` by `text`."""
        at = max(0, min(at, self.length))
        cut = max(0, min(cut, self.length - at))
        if not cut and not text:
            return
        leaf, i, start = self.words_before(at)
        if start:
            leaf, i, start = self.words_before(start)
        # Old pre-tokens are taken until the new splitting meets one of their boundaries behind the edit.
        old: list[str] = []
        bounds, size, more = [], 0, 8
        walk = (leaf, i)
        whole = False
        while True:
            while not whole and (size < at + cut - start or more > 0):
                l, k = walk
                if k >= len(self.leaves[l][0]):
                    if l + 1 >= self.size:
                        whole = True
                        break
                    walk = (l + 1, 0)
                    continue
                old.append(self.leaves[l][0][k])
                size += len(old[-1])
                bounds.append(size)
                more -= size > at + cut - start
                walk = (l, k + 1)
            piece = "".join(old)
            new_text = piece[: at - start] + text + piece[at - start + cut :]
            shift = len(text) - cut
            words = self.counter.pre_tokens(new_text)
            behind = {b + shift: k + 1 for k, b in enumerate(bounds) if b >= at - start + cut}
            here, met = 0, None
            for k, w in enumerate(words):
                here += len(w)
                # A pre-token that ends before the window does, with its next character in view, ends there in the whole text too.
                if here in behind and (here < len(new_text) or whole):
                    met = (k + 1, behind[here])
                    break
            if met or whole:
                break
            more = 2 * len(old) + 8
        n_new, n_old = met or (len(words), len(old))
        words = words[:n_new]
        self.replace(leaf, i, n_old, words)

    def replace(self, leaf: int, i: int, n_old: int, words: list[str]) -> None:
        """Put words in place of n_old pre-tokens from (leaf, i) on. Pre-tokens that stay at either end keep their counts."""
        counts = self.counter.counts(words)
        self.encoded += len(words)
        touched, left, l, k = [], n_old, leaf, i
        while True:
            w, c = self.leaves[l]
            n = min(left, len(w) - k)
            self.leaves[l] = (w[:k] + (words if l == leaf else []) + w[k + n :], c[:k] + (counts if l == leaf else []) + c[k + n :])
            touched.append(l)
            left -= n
            if not left:
                break
            l, k = l + 1, 0
        if len(self.leaves[leaf][0]) > 4 * LEAF:
            self.build([w for x, _ in self.leaves for w in x], [c for _, x in self.leaves for c in x])
            return
        for l in touched:
            k = self.size + l
            self.chars[k], self.tokens[k] = sum(map(len, self.leaves[l][0])), sum(self.leaves[l][1])
            while k > 1:
                k //= 2
                self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]


def edited_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """docs has edits array<struct<at int, cut int, text string>>, applied in order to the text as it then is.
    doc_id, n_tokens, n_edits, n_tokens_after, n_chars_after, n_encoded (pre-tokens encoded for the edits): one row
    per row of docs, in one pass without a shuffle.

    Defined results: null text counts as empty; null edits as none, and null fields as 0 or ''; an edit out of range
    is moved into it; null ids stay; repeated rows are counted each; an empty table gives no rows; other columns are
    ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shared_counter(tokenizer)
        for b in batches:
            edits = b.column(2)
            for k, texts in groups(b.column(1).to_pylist()):
                parts = [counter.pre_tokens(t) for t in texts]
                counter.know(parts)
                rows = []
                for j, (t, words) in enumerate(zip(texts, parts)):
                    tree = CountTree(counter, t, words)
                    before, todo = tree.total, [e for e in edits[k + j].as_py() or [] if e]
                    for e in todo:
                        tree.edit(e["at"] or 0, e["cut"] or 0, e["text"] or "")
                    rows.append((before, len(todo), tree.total, tree.length, tree.encoded))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, len(texts)), *(pa.array(c, pa.int64()) for c in zip(*rows))], names=["doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_chars_after", "n_encoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.col(edits_col).cast("array<struct<at:int,cut:int,text:string>>").alias("e"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_edits long, n_tokens_after long, n_chars_after long, n_encoded long")
