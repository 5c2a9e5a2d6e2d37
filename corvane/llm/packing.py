"""Best-fit packing of documents into sequences by a grouping genetic algorithm (operator 6).

Pieces of one length are interchangeable, so the packing problem of any corpus is its histogram of piece lengths
(at most `capacity` numbers). A chromosome is a set of bins grouped by content: pattern (lengths and how many of each)
-> number of such bins. Crossover injects whole well-filled bins of one parent, strikes from the other parent's bins
those whose documents are used already, and puts the displaced documents back by best fit. Islands evolve as Spark
tasks; after each epoch every island gets its neighbour's best chromosome. The best pattern set found is then dealt
to the pieces: the r-th piece of a length belongs to the bin whose interval of ranks holds r.

Work: one pass that encodes, one pass over the (small) piece rows; the search doesn't grow with the corpus. A hot
length isn't a hot key: ranks within a length are (offset of the task's block) + (place in the block), so
no task ever gathers a length."""

from __future__ import annotations

import json
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm.bpe import groups, shared_encoder
from corvane.llm.common import Tables, lean_worker

Pattern = tuple[tuple[int, int], ...]

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("block", pa.int32()), ("place", pa.int64())])


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole if they fit, else the remainder first and then full pieces."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return [(0, first)] * bool(first) + [(s, capacity) for s in range(first, n, capacity)]


# --- the search, on histograms -------------------------------------------------------------------------------


class Bins:
    """Open bins by free space; best fit finds the tightest that takes a length."""

    def __init__(self, capacity: int, bins: dict[Pattern, int] | None = None):
        self.capacity, self.by_free, self.mask = capacity, {}, 0
        for p, m in (bins or {}).items():
            self.add(p, m)

    def add(self, p: Pattern, m: int) -> None:
        free = self.capacity - sum(n * k for n, k in p)
        d = self.by_free.setdefault(free, {})
        d[p] = d.get(p, 0) + m
        self.mask |= 1 << free

    def put(self, n: int, count: int) -> None:
        while count:
            fit = self.mask >> n
            if fit:
                free = n + (fit & -fit).bit_length() - 1
                d = self.by_free[free]
                p, m = d.popitem()
            else:
                free, p, m = self.capacity, (), count
            each = min(free // n, count)
            used = min(m, count // each)
            if fit:
                if m > used:
                    d[p] = m - used
                if not d:
                    self.mask &= ~(1 << free)
            has = dict(p)
            has[n] = has.get(n, 0) + each
            self.add(tuple(sorted(has.items(), reverse=True)), used)
            count -= used * each

    def bins(self) -> dict[Pattern, int]:
        return {p: m for d in self.by_free.values() for p, m in d.items()}


def best_fit(hist: dict[int, int], capacity: int, order: list[int] | None = None, bins: dict[Pattern, int] | None = None) -> dict[Pattern, int]:
    b = Bins(capacity, bins)
    for n in order or sorted(hist, reverse=True):
        if hist[n]:
            b.put(n, hist[n])
    return b.bins()


def worth(bins: dict[Pattern, int], capacity: int) -> tuple[int, float]:
    """Fewer bins first; among equals, fuller full bins (mean squared fill)."""
    total = sum(bins.values())
    fill = sum(m * (sum(n * k for n, k in p) / capacity) ** 2 for p, m in bins.items())
    return -total, fill / max(total, 1)


def crossover(a: dict[Pattern, int], b: dict[Pattern, int], hist: dict[int, int], capacity: int, rng: random.Random) -> dict[Pattern, int]:
    left = dict(hist)
    child: dict[Pattern, int] = {}

    def take(p: Pattern, most: int) -> None:
        m = min(most, *(left[n] // k for n, k in p))
        if m > 0:
            child[p] = child.get(p, 0) + m
            for n, k in p:
                left[n] -= k * m

    fill = {p: sum(n * k for n, k in p) for p in (*a, *b)}
    limit = rng.choice((capacity, capacity - capacity // 100, capacity - capacity // 20))
    inject = [p for p in b if fill[p] >= limit and rng.random() < 0.6]
    rng.shuffle(inject)
    for p in inject:
        take(p, b[p])
    keep = sorted((p for p in a if fill[p] >= limit or rng.random() < 0.7), key=lambda p: (-fill[p], rng.random()))
    for p in keep:  # bins that hold a document used above go: what is left bounds them
        take(p, a[p])
    return best_fit(left, capacity, bins=child)


def evolve(hist: dict[int, int], capacity: int, population: list[dict[Pattern, int]], seed: int, generations: int, size: int) -> list[dict[Pattern, int]]:
    rng = random.Random(seed)
    desc = sorted(hist, reverse=True)
    while len(population) < size:
        noise = 0.0 if not population else 0.05 * len(population)
        population = [*population, best_fit(hist, capacity, sorted(desc, key=lambda n: -n * (1 + noise * (rng.random() - 0.5))))]
    least = -(-sum(n * c for n, c in hist.items()) // capacity)
    for _ in range(generations):
        population.sort(key=lambda x: worth(x, capacity), reverse=True)
        if not hist or -worth(population[0], capacity)[0] == least:
            break
        a, b = population[0], population[1 + rng.randrange(len(population) - 1)]
        children = [crossover(a, b, hist, capacity, rng), crossover(b, a, hist, capacity, rng)]
        population = sorted([*population, *children], key=lambda x: worth(x, capacity), reverse=True)[:size]
    return sorted(population, key=lambda x: worth(x, capacity), reverse=True)


def dump(bins: dict[Pattern, int]) -> str:
    return json.dumps([[list(map(list, p)), m] for p, m in bins.items()])


def load(s: str) -> dict[Pattern, int]:
    return {tuple((n, k) for n, k in p): m for p, m in json.loads(s)}


def search(spark, hist: dict[int, int], capacity: int, islands: int = 4, epochs: int = 3, generations: int = 6, size: int = 4) -> dict[Pattern, int]:
    """Islands as Spark tasks. What travels is bounded by the capacity, not by the corpus."""
    if not hist:
        return {}
    state = {i: [] for i in range(islands)}

    def run(frames):
        for f in frames:
            for i, seed, pop in zip(f["island"], f["seed"], f["population"]):
                out = evolve(hist, capacity, [load(x) for x in pop], int(seed), generations, size)
                f = f.__class__({"island": [i], "population": [[dump(x) for x in out]]})
                yield f

    least = -(-sum(n * c for n, c in hist.items()) // capacity)
    for epoch in range(epochs):
        rows = [(i, 1000 * epoch + i, state[i]) for i in range(islands)]
        df = spark.createDataFrame(rows, "island int, seed long, population array<string>").repartition(islands, "island")
        got = {r.island: list(r.population) for r in df.mapInPandas(run, "island int, population array<string>").collect()}
        elite = {i: got[i][0] for i in got}
        if any(-worth(load(e), capacity)[0] == least for e in elite.values()):
            break
        state = {i: [elite[(i - 1) % islands], *got[i][: size - 1]] for i in got}
    return max((load(e) for e in elite.values()), key=lambda x: worth(x, capacity))


def intervals(bins: dict[Pattern, int]) -> dict[str, np.ndarray]:
    """For each length, runs of ranks: keys (length << 44) + first rank, and per run: pieces a bin, first bin, offset in the bin."""
    seen: dict[int, int] = {}
    rows, first = [], 0
    for p, m in sorted(bins.items(), reverse=True):
        offset = 0
        for n, k in p:
            rows.append((n, seen.get(n, 0), k, first, offset))
            seen[n] = seen.get(n, 0) + k * m
            offset += n * k
        first += m
    a = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {"key": (a[:, 0] << 44) + a[:, 1], "rank": a[:, 1], "each": a[:, 2], "bin": a[:, 3], "offset": a[:, 4]}


# --- the passes over the corpus ------------------------------------------------------------------------------


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", words: int | None = None) -> DataFrame:
    """One row per piece; block: the task, place: how many pieces of this length the task made before. With `words`, a
    task keeps so many pre-tokens at most and leaves none in its worker: slower, for executors that do more than this."""
    end = np.array([end_id], "<u4").tobytes()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, block, seen = shared_encoder(tokenizer, *([words] if words else [])), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for b in batches:
            ids = b.column(0).to_pylist()
            for k, texts in groups(b.column(1).to_pylist()):
                rows = []
                for d, e in zip(ids[k : k + len(texts)], enc.encode(texts)):
                    e += end
                    for j, (s, n) in enumerate(cut(len(e) // 4, capacity)):
                        rows.append((d, j, s, n, zlib.crc32(e[4 * s : 4 * (s + n)]), block, seen[n]))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECES)], schema=PIECES)
        if words:
            del enc
            lean_worker()

    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.mapInArrow(make, "doc_id long, piece int, start long, length long, ids_crc32 long, block int, place long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, words: int | None = None, **search_options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece of every row.

    Defined results: null text counts as empty (one piece holding the end id); null doc_ids stay null; repeated rows
    are packed each; an empty table gives no rows; other columns are ignored."""
    spark = docs.sparkSession
    tables = Tables(spark, "packing")
    pieces = tables.write(token_pieces(docs, tokenizer, capacity, end_id, words=words), "pieces")
    counts = tables.write(pieces.groupBy("block", "length").agg(F.count("*").alias("n")), "counts")
    offsets = counts.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("block")) - F.col("n")).drop("n")
    hist = {int(r.length): int(r.n) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = spark.sparkContext.broadcast(intervals(search(spark, hist, capacity, **search_options)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = runs.value
        for b in batches:
            n, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            i = np.searchsorted(r["key"], (n << 44) + rank, side="right") - 1
            at = rank - r["rank"][i]
            seq, offset = r["bin"][i] + at // r["each"][i], r["offset"][i] + at % r["each"][i] * n
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(5)), pa.array(seq), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(offsets, ["block", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
