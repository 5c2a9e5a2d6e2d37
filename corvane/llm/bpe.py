"""Byte-level BPE ids through the tokenizers library, each distinct pre-token encoded once per worker.

Pre-tokens of a byte-level BPE are encoded apart from each other, so a text's ids are the joined ids of its
pre-tokens. Texts made of Latin letters, where every version of Unicode agrees on the character classes, are split
here; all other texts go to the library whole."""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import filterfalse

import numpy as np

from corvane.llm.common import env_single_thread

# Letters and numbers up to U+024F.
_L = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_N = "0-9²³¹¼-¾"
_S = " \\t\\n\\x0b\\x0c\\r\\x85\\xa0"
PRE_TOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: Characters outside the alphabet whose classes are certain (controls such as U+001C count as space for some engines only).
_UNSURE = re.compile("[^\\t\\n\\r -~ -ɏ‐-‧‰-⁞€]")


class Encoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit bytes. Memory: at most `words` cached pre-tokens."""

    def __init__(self, path: str, words: int = 800_000):
        env_single_thread()
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.words, self.cache = words, {}
        self.newline = self.ids("\n")

    def ids(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def split(self, text: str) -> list[str] | None:
        """The text's pre-tokens, or None if only the library can tell."""
        return None if _UNSURE.search(text) or "<|" in text else PRE_TOKEN.findall(text)

    def learn(self, new: set[str]) -> None:
        """Encode unseen pre-tokens in one call: those without white space inside are joined by newlines, which
        are pre-tokens of their own there, and cut apart again at the newline's id."""
        if len(self.cache) + len(new) > self.words:
            self.cache = {w: v for w, v in self.cache.items() if len(w) <= 6} if len(self.cache) < 4 * self.words else {}
        rest = [w for w in new if w.isspace() or not w] if len(self.newline) == 4 else list(new)
        plain = list(new.difference(rest))
        for k in range(0, len(plain), 20_000):
            some = plain[k : k + 20_000]
            ids = np.array(self.lib.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            at = np.flatnonzero(ids == np.frombuffer(self.newline, "<u4")[0])
            if len(at) != len(some) - 1:
                rest += some
                continue
            raw, ends = ids.tobytes(), (at * 4).tolist()
            self.cache.update(zip(some, [raw[a:z] for a, z in zip([0, *(x + 4 for x in ends)], [*ends, len(raw)])]))
        for w in rest:
            self.cache[w] = self.ids(w)

    def know(self, parts: list[list[str]]) -> None:
        """After this the cache holds all words of the parts."""
        words = set().union(*parts)  # a small set first: looking each occurrence up in the large cache is slower
        for _ in range(2):  # learning may drop others when the cache is full
            new = set(filterfalse(self.cache.__contains__, words))
            if not new:
                return
            self.learn(new)

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [self.split(t) for t in texts]
        self.know([p for p in parts if p])
        get = self.cache.__getitem__
        return [self.ids(t) if p is None else b"".join(map(get, p)) for t, p in zip(texts, parts)]


@lru_cache(maxsize=2)
def shared_encoder(path: str, words: int = 800_000) -> Encoder:
    """The Python worker's own: what one task has learnt serves the next."""
    return Encoder(path, words)


def groups(texts, most: int = 2_000_000):
    """Runs of texts of about `most` characters: (start, list)."""
    start, size, run = 0, 0, []
    for k, t in enumerate(texts):
        if run and size + len(t) > most:
            yield start, run
            start, size, run = k, 0, []
        run.append(t)
        size += len(t)
    if run:
        yield start, run
