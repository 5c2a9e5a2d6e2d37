"""Toxicity by cumulative-link ordinal regression on sparse text features (operator 1).

Severity grades 0..G are ordered. One weight vector w scores a text, ordered thresholds c_1 < ... < c_G cut the score:
P(grade >= k) = sigmoid(w.x - c_k), and the expected severity is the sum of these over k.

Features: presence of a hashed word (lower-cased runs of letters and digits) or of a word's beginning. The fit uses a bounded, deterministic
sample of labelled rows (`max_rows`, least hashes of the id first); of the hashed words it keeps the `max_features` with the
greatest log-odds ratio to its error, so rare words of one document carry no weight. Scoring is one pass without a
shuffle; what is broadcast is the weight vector, of fixed size 2**bits.

Labels that only say toxic or not are graded by their strength: 1 for a toxic row with at most one of the words that
mark toxic rows, 2 with two or three, 3 with more. A `severity` column is used as it is."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import lean_worker
from corvane.llm.words import NOT_ALNUM, bounds, buffers, hashes, mix, slices


#: Lengths in bytes of the word beginnings that are features too: in inflected languages a stem marks a text, not a form.
STEMS = (4, 5, 6)


def buckets(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashed features of the batch, for each text the first of its features): words and their beginnings."""
    data, offsets = buffers(texts)
    s, e = bounds(data, offsets, NOT_ALNUM)
    kinds = [hashes(data, s, e), *(mix(hashes(data, s, np.minimum(e, s + n)) + np.uint64(n)) for n in STEMS)]
    return (np.column_stack(kinds).ravel() >> np.uint64(64 - bits)).astype(np.int64), np.searchsorted(s, offsets) * len(kinds)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Ordinal:
    weights: np.ndarray
    cuts: np.ndarray

    def grades(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1..G, one row per score."""
        return sigmoid(score[:, None] - self.cuts[None, :])


def fit(doc: np.ndarray, feature: np.ndarray, grade: np.ndarray, n_features: int, l2: float = 2e-5, steps: int = 400, rate: float = 0.05) -> Ordinal:
    """Penalised maximum likelihood by Adam. doc, feature: the nonzero entries; grade: one per document.
    The gaps between thresholds are exponentials, so they stay ordered."""
    n, g = len(grade), max(int(grade.max(initial=0)), 1)
    p = np.concatenate([np.zeros(n_features), [0.0], np.zeros(g - 1)])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        w, c1, gaps = p[:n_features], p[n_features], np.exp(p[n_features + 1 :])
        cuts = c1 + np.concatenate([[0.0], np.cumsum(gaps)])
        s = np.bincount(doc, weights=w[feature], minlength=n)
        up = np.column_stack([np.ones(n), sigmoid(s[:, None] - cuts), np.zeros(n)])  # P(grade >= 0..G+1)
        slope = up * (1 - up)
        at = np.arange(n)
        prob = np.maximum(up[at, grade] - up[at, grade + 1], 1e-12)
        ds = (slope[at, grade] - slope[at, grade + 1]) / prob
        dcut = np.zeros((n, g + 2))
        dcut[at, grade] -= slope[at, grade] / prob
        dcut[at, grade + 1] += slope[at, grade + 1] / prob
        dc = dcut[:, 1 : g + 1].mean(axis=0)
        grad = np.concatenate([-np.bincount(feature, weights=ds[doc], minlength=n_features) / n + l2 * w, [-dc.sum()], [-dc[k:].sum() * gaps[k - 1] for k in range(1, g)]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return Ordinal(p[:n_features], p[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(p[n_features + 1 :]))]))


def log_odds(doc: np.ndarray, feature: np.ndarray, toxic: np.ndarray, n: int) -> np.ndarray:
    """Of each feature's presence, the log-odds ratio over its standard error (0.5 added to each cell)."""
    pos, neg = (np.bincount(feature[toxic[doc] == k], minlength=n) + 0.5 for k in (1, 0))
    np_, nn = (toxic == 1).sum() + 1.0, (toxic == 0).sum() + 1.0
    ratio = np.log(pos / np.maximum(np_ - pos, 0.5)) - np.log(neg / np.maximum(nn - neg, 0.5))
    return ratio / np.sqrt(1 / pos + 1 / neg + 1 / np.maximum(np_ - pos, 0.5) + 1 / np.maximum(nn - neg, 0.5))


def sample_features(docs: DataFrame, labels: DataFrame, bits: int, max_rows: int, id_col: str, text_col: str, target: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """The grades or flags of the sample and each row's features. At most max_rows rows reach the driver: of the rows
    that repeat an id one stands for all, that whose text has the least hash."""
    rows = labels.select(F.col("doc_id").cast("long").alias("k"), F.col(target).cast("int").alias("y")).dropna().groupBy("k").agg(F.max("y").alias("y"))
    some = rows.orderBy(F.xxhash64("k"), "k").limit(max_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")).join(F.broadcast(some), "k")
    texts = texts.groupBy("k", "y").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("least")).select("k", "y", "least.t")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 2, 2_000_000):
                x, first = buckets(b.column(2), bits)
                found = [np.unique(x[first[i] : first[i + 1]]).astype("<i4").tobytes() for i in range(len(b))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())], names=["k", "y", "x"])

    got = sorted(((r.k, bytes(r.x), r.y) for r in texts.mapInArrow(make, "k long, y int, x binary").toLocalIterator()), key=lambda r: r[:2])
    return np.array([r[2] for r in got], np.int64), [np.frombuffer(r[1], "<i4").astype(np.int64) for r in got]


def train(docs: DataFrame, labels: DataFrame, bits: int = 20, max_rows: int = 8000, max_features: int = 2000, least_z: float = 3.0, id_col: str = "doc_id", text_col: str = "text") -> Ordinal:
    """Without labelled rows, or with one class only, the model grades everything 0."""
    graded = "severity" in labels.columns
    y, rows = sample_features(docs, labels, bits, max_rows, id_col, text_col, "severity" if graded else "toxic")
    none = Ordinal(np.zeros(1 << bits), np.array([40.0]))
    y = np.maximum(y, 0)
    if not len(y) or y.min() > 0 or y.max() == 0:
        return none
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.concatenate(rows) if len(doc) else np.zeros(0, np.int64)
    z = log_odds(doc, feature, (y > 0).astype(np.int64), 1 << bits)
    keep = np.argsort(-np.abs(z), kind="stable")[:max_features]
    keep = keep[np.abs(z[keep]) >= least_z]
    if not graded:
        marks = np.bincount(doc, weights=z[feature] >= least_z, minlength=len(rows))
        one = 1 + len(STEMS)  # features of one word
        y = np.where(y > 0, 1 + (marks > one) + (marks > 3 * one), 0)
        y = np.searchsorted(np.unique(y), y)
    index = np.full(1 << bits, -1)
    index[keep] = np.arange(len(keep))
    on = index[feature] >= 0
    if not len(keep):
        return none
    m = fit(doc[on], index[feature[on]], y, len(keep))
    w = np.zeros(1 << bits)
    w[keep] = m.weights
    return Ordinal(w, m.cuts)


FOUND = ["expected_severity", "grade", "p_toxic", "toxic"]


def score(docs: DataFrame, model: Ordinal, keep: list[str], text_col: str = "text", reject_at: float = 0.5, prefix: str = "") -> DataFrame:
    """Columns `keep` of docs and, their names behind `prefix`, expected_severity double, grade int (most likely),
    p_toxic double, toxic boolean. Columns of docs with one of these four names are passed through as docs_<name>."""
    from pyspark.sql import types as T

    spark, bits = docs.sparkSession, int(np.log2(len(model.weights)))
    shared = spark.sparkContext.broadcast((model.weights, model.cuts))
    n = len(keep)

    at = keep.index(text_col) if text_col in keep else n  # the text travels once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, cuts = shared.value
        for whole in batches:
            for b in slices(whole, at, 2_000_000):
                x, first = buckets(b.column(at), bits)
                hit = np.flatnonzero(w[x])
                d = np.searchsorted(first, hit, side="right") - 1
                one = np.unique((d << bits) + x[hit])
                s = np.bincount(one >> bits, weights=w[one & ((1 << bits) - 1)], minlength=len(b))
                up = sigmoid(s[:, None] - cuts[None, :])
                levels = np.column_stack([np.ones(len(b)), up, np.zeros(len(b))])
                grade = np.argmax(levels[:, :-1] - levels[:, 1:], axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), pa.array(up.sum(axis=1)), pa.array(grade), pa.array(up[:, 0]), pa.array(up[:, 0] >= reject_at)], names=[*(f"k{i}" for i in range(n)), *FOUND])
        lean_worker()

    given = docs.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)), *([F.col(f"`{text_col}`").alias("t")] if at == n else []))
    fields = [T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
    out = T.StructType([*fields, T.StructField("expected_severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("p_toxic", T.DoubleType()), T.StructField("toxic", T.BooleanType())])
    scored = given.mapInArrow(run, out)
    taken = {f"{prefix}{c}".lower() for c in FOUND}
    return scored.select(*(F.col(f"k{i}").alias(f"docs_{c}" if c.lower() in taken else c) for i, c in enumerate(keep)), *(F.col(c).alias(f"{prefix}{c}") for c in FOUND))


def toxicity(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """Train on the labelled rows, score all rows.

    Defined results: null and empty texts have no features and score grade 0 unless toxic rows are the rule; null
    ids and labels aren't trained on, of a repeated label the greatest counts; repeated rows are scored each; an
    empty table gives no rows; `keep` names the columns passed through (the id by default), those with a name of the
    result as docs_<name>."""
    return score(docs, train(docs, labels, id_col=id_col, text_col=text_col, **options), keep or [id_col], text_col)
