"""Languages of documents as mixtures (operator 12).

Learning: how often each hashed n-gram of bytes of the lower-cased letters occurs in each language, summed over all
labelled rows that aren't held out. Inference, apart for each document: expectation-maximisation finds the proportions
of the languages under which the document's n-grams are likeliest; then sets of languages, growing in the order of
those proportions, are each fitted by the same steps, and the one whose log likelihood less a penalty for each language
(that of the Bayesian information criterion, over the letters and not the overlapping n-grams) is highest is selected.
The prediction is the selected set's largest language, the score its proportion when all languages may have one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.bpe import groups
from corvane.llm.common import Tables, lean_worker

GRAM = 4
_BLANK = np.uint32(0x20202020)
_LETTER = regex.compile(r"\p{L}")
_BYTE = np.array([x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in range(256)], np.uint32)


def grams(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hashed n-gram) of every place whose n-gram has a letter; all but letters count as spaces."""
    raw = [t.lower().encode() for t in texts]
    sizes = np.array([len(x) + 4 for x in raw])
    b = _BYTE[np.frombuffer(b"".join(b"  " + x + b"  " for x in raw), np.uint8)]
    if len(b) < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    n = len(b) - GRAM + 1
    code = np.zeros(n, np.uint32)
    for k in range(GRAM):
        code = (code << np.uint32(8)) | b[k : n + k]
    ok = np.flatnonzero(code != _BLANK)
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0x9E3779B1)
    code = (code ^ (code >> np.uint32(13))) * np.uint32(0x85EBCA6B)
    return np.repeat(np.arange(len(raw)), sizes)[ok], (code >> np.uint32(32 - bits))[ok]


def gram_counts(rows: DataFrame, bits: int) -> DataFrame:
    """(lang, h, n) over all rows (lang, t). A task sends each n-gram of a language once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            for k, texts in groups(b.column(1).to_pylist()):
                names, of = np.unique(langs[k : k + len(texts)].astype(str), return_inverse=True)
                doc, h = grams(texts, bits)
                n = np.bincount((of[doc] << bits) + h, minlength=len(names) << bits).reshape(len(names), -1)
                for name, row in zip(names.tolist(), n):
                    held[name] = held[name] + row if name in held else row
        for name, row in held.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(row[at])], names=["lang", "h", "n"])
        lean_worker()

    return rows.mapInArrow(run, "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))


class Mixture:
    """Languages and the logarithms of their n-grams' probabilities."""

    def __init__(self, langs: list[str], log_p: np.ndarray, bits: int, strength: float = 1.0):
        self.langs, self.log_p, self.bits, self.strength = langs, log_p, bits, strength

    def proportions(self, p: np.ndarray, count: np.ndarray, first: np.ndarray, allowed: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
        """EM from equal proportions of the allowed languages: (proportions, log likelihood) of each document.
        p: languages x n-grams, count of each n-gram, first n-gram of each document, allowed: languages x documents."""
        sizes = np.diff(np.append(first, len(count)))
        n = np.add.reduceat(count, first)
        theta = allowed / allowed.sum(axis=0)
        for k in range(rounds + 1):
            mix = np.zeros(len(count), np.float32)
            for row, t in zip(p, theta.astype(np.float32)):
                mix += row * np.repeat(t, sizes)
            if k == rounds:
                return theta, np.add.reduceat(count * np.log(mix), first).astype(np.float64)
            share = count / mix
            theta = theta * np.stack([np.add.reduceat(row * share, first) for row in p]) / n

    def infer(self, texts: list[str]) -> list[tuple[list[str], list[float], float]]:
        """(selected languages, their proportions, the first one's proportion among all languages), largest first; nothing for texts without n-grams."""
        out: list[tuple[list[str], list[float], float]] = [([], [], 0.0)] * len(texts)
        doc, h = grams(texts, self.bits)
        if not len(doc) or not self.langs:
            return out
        key, count = np.unique((doc.astype(np.int64) << self.bits | h).astype(np.uint32 if len(texts) << self.bits < 1 << 32 else np.int64), return_counts=True)
        of, h = (key >> self.bits).astype(np.int64), key & ((1 << self.bits) - 1)
        count = count.astype(np.float32)
        first = np.flatnonzero(np.diff(of, prepend=-1))
        docs, sizes = of[first], np.diff(np.append(first, len(of)))
        log_p = self.log_p[:, h]
        top = log_p.max(axis=0)
        alone = np.stack([np.add.reduceat(count * (row - top), first) for row in log_p]).astype(np.float64)
        p = np.exp(log_p - top)
        every, best = self.proportions(p, count, first, np.ones((len(self.langs), len(docs))))
        letters = np.add.reduceat(count, first) / GRAM
        penalty = self.strength * np.log(np.maximum(letters, 2)) / 2
        chosen = np.zeros_like(every)
        chosen[alone.argmax(axis=0), np.arange(len(docs))] = 1
        score = alone.max(axis=0) / GRAM - penalty
        order, open_ = np.argsort(-every, axis=0, kind="stable"), np.arange(len(docs))
        for k in range(2, len(self.langs) + 1):
            # Not even all languages together would pay for k of them: done.
            open_ = open_[best[open_] / GRAM - k * penalty[open_] > score[open_]]
            if not len(open_):
                break
            allowed = np.zeros((len(self.langs), len(open_)))
            np.put_along_axis(allowed, order[:k, open_], 1, axis=0)
            at = np.repeat(first[open_] - np.cumsum(sizes[open_]) + sizes[open_], sizes[open_]) + np.arange(sizes[open_].sum())
            theta, fit = self.proportions(p[:, at], count[at], np.cumsum(sizes[open_]) - sizes[open_], allowed)
            gain = fit / GRAM - k * penalty[open_]
            better = gain > score[open_]
            chosen[:, open_[better]], score[open_[better]] = theta[:, better], gain[better]
        for i, d in enumerate(docs.tolist()):
            by = [j for j in np.argsort(-chosen[:, i], kind="stable").tolist() if chosen[j, i] > 0]
            out[d] = ([self.langs[j] for j in by], [float(chosen[j, i]) for j in by], float(min(max(every[by[0], i], 0), 1)))
        return out


def learn(rows: DataFrame, bits: int = 16, smooth: float = 0.5, most: int = 256) -> Mixture:
    """The model of all rows (lang, t): 2**bits numbers a language, of at most the `most` languages with the most n-grams
    (by name among equals), whatever the number of rows."""
    counts = Tables(rows.sparkSession, "language").write(gram_counts(rows, bits), "counts")
    kept = counts.groupBy("lang").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "lang").limit(most)
    got = counts.join(F.broadcast(kept.select("lang")), "lang").toArrow()
    names = np.array(got["lang"].to_pylist(), object).astype(str)
    langs, of = np.unique(names, return_inverse=True)
    n = np.zeros((len(langs), 1 << bits))
    n[of, got["h"].to_numpy()] = got["n"].to_numpy()
    return Mixture(langs.tolist(), np.log((n + smooth) / (n.sum(axis=1, keepdims=True) + smooth * (1 << bits))).astype(np.float32), bits)


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, languages array<string>, proportions array<double>"


def predict_languages(docs: DataFrame, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, held_out (crc32 of the id as text is divisible by folds), lang_pred, score, and
    the selected languages with their proportions. Learns from the labelled rows of the other folds. Two passes over
    the texts, which aren't shuffled; the model is broadcast, 4 bytes x 65,536 a language.

    Defined results: null texts and texts without a letter are `und` with score 0 and no languages, and so is each text
    when there is nothing to learn from; rows without an id aren't held out and aren't learned from; repeated rows count
    each; an empty table gives no rows; other columns are ignored."""
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
    model = learn(docs.filter((fold != 0) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("t")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, texts in groups(b.column(2).to_pylist(), 1_000_000):
                found = shared.value.infer(texts)
                found = [f if _LETTER.search(t) else ([], [], 0.0) for f, t in zip(found, texts)]
                cols = [b.column(0).slice(k, len(texts)), b.column(1).slice(k, len(texts)), pa.array([f[0][0] if f[0] else "und" for f in found]), pa.array([f[2] for f in found]), pa.array([f[0] for f in found], pa.list_(pa.string())), pa.array([f[1] for f in found], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(cols, names=[c.split(" ")[0] for c in SCHEMA.split(", ")])
        lean_worker()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(fold == 0, F.lit(False)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.mapInArrow(run, SCHEMA)
