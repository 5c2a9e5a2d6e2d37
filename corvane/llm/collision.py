"""Embedding near-duplicates by collision-counting projections (operator 3).

Vectors are scaled to length 1, so cosine >= s means a distance of at most r = sqrt(2 - 2 s), and a projection on a
random Gaussian direction differs by N(0, d * d) for a pair at distance d. Each of m projections is sorted; a query's window is
its value +- w, found by binary search; a pair's count is the number of projections in whose window it falls. Only
pairs with a count of at least l are verified, by cosine in double precision. l is the largest count that a pair at
exactly the threshold reaches with probability `recall`; nearer pairs reach it more often.

Copies (same label and vector) become one class with a weight first, so a common vector costs one row. Classes of a
label are dealt by the first projection into cells as wide as a window that holds a threshold pair with probability
`recall`, and cells into blocks of at most about `block` classes; a tile compares two blocks of the same or of adjacent
cells. A tile returns its classes' link counts and links that join components, at most as many as it has classes.

Cost: within a label the tiles of adjacent cells are compared in full, by vectorised counting, so work grows with the
square of a label's distinct vectors, in independent tiles; rows shuffled grow with vectors times blocks of the cells."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Tables, slots
from corvane.llm.graph import components


@lru_cache(maxsize=4)
def directions(dim: int, m: int) -> np.ndarray:
    return np.random.default_rng([77, dim]).standard_normal((dim, m))


def calibrated(threshold: float, m: int, width: float, recall: float) -> int:
    """The largest l with P(Bin(m, p) >= l) >= recall, p: the chance that a threshold pair collides."""
    p = erf(width / (sqrt(2 - 2 * threshold) * sqrt(2)))
    tail = 0.0
    for k in range(m, -1, -1):
        tail += comb(m, k) * p**k * (1 - p) ** (m - k)
        if tail >= recall:
            return k
    return 0


def cell_width(threshold: float, recall: float) -> float:
    r, lo, hi = sqrt(2 - 2 * threshold), 0.0, 40.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if erf(mid / sqrt(2)) >= recall else (mid, hi)
    return max(hi * r, 1e-6)


def collisions(q: np.ndarray, t: np.ndarray, width: float) -> np.ndarray:
    """How often each target lies in each query's window; q and t: projections, one column each."""
    counts = np.zeros((len(q), len(t)), np.int16)
    at = np.arange(len(q))
    for k in range(q.shape[1]):
        order = np.argsort(t[:, k], kind="stable")
        line = t[order, k]
        d = np.zeros((len(q), len(t) + 1), np.int8)
        d[at, np.searchsorted(line, q[:, k] - width, side="left")] += 1
        d[at, np.searchsorted(line, q[:, k] + width, side="right")] -= 1
        counts[:, order] += np.cumsum(d[:, :-1], axis=1, dtype=np.int8)
    return counts


def moderate(v: np.ndarray) -> np.ndarray:
    """Rows scaled by powers of two, which rounds nothing, so that their largest component lies in [0.5, 1)."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def tile_links(q: dict, t: dict, same: bool, threshold: float, m: int, width: float, least: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Link weights of the queries and the targets, and links that span the tile's components."""
    q, t = ({**x, "v": moderate(x["v"])} for x in (q, t))  # squares neither overflow nor vanish
    qn, tn = (np.sqrt((x["v"] ** 2).sum(axis=1)) for x in (q, t))
    way = directions(q["v"].shape[1], m)
    counts = collisions((q["v"] / qn[:, None]) @ way, (t["v"] / tn[:, None]) @ way, width)
    i, j = np.nonzero(counts >= least)
    if same:
        i, j = i[q["c"][i] < t["c"][j]], j[q["c"][i] < t["c"][j]]
    ok = np.zeros(len(i), bool)
    for k in range(0, len(i), 100_000):
        s = slice(k, k + 100_000)
        ok[s] = np.einsum("ij,ij->i", q["v"][i[s]], t["v"][j[s]]) / (qn[i[s]] * tn[j[s]]) >= threshold
    i, j = i[ok], j[ok]
    dq, dt = np.bincount(i, weights=t["n"][j], minlength=len(qn)), np.bincount(j, weights=q["n"][i], minlength=len(tn))
    ids, pos = np.unique(np.concatenate([q["c"], t["c"]]), return_inverse=True)
    comp, span = np.arange(len(ids)), []
    pq, pt = pos[: len(qn)], pos[len(qn) :]
    cut = np.searchsorted(i, np.arange(len(qn) + 1))
    for a in np.unique(i).tolist():
        to = pt[j[cut[a] : cut[a + 1]]]
        roots, first = np.unique(comp[to], return_index=True)
        for r, f in zip(roots.tolist(), first.tolist()):
            if r != comp[pq[a]]:
                span.append((int(ids[pq[a]]), int(ids[to[f]])))
                comp[comp == r] = comp[pq[a]]
    return dq.astype(np.int64), dt.astype(np.int64), span


def near_vectors(vectors: DataFrame, threshold: float = 0.98, m: int = 24, width: float = 0.3, recall: float = 0.9999, block: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of vectors; only equal, non-null labels are compared.

    Defined results: vectors that are null, empty, zero, of another dimension, or hold a null, NaN or infinite
    component link with nothing, and so do rows without label, not even with their copies (component_id is their own
    id, n_links 0); rows that repeat an id count as vectors of their own; a null id takes its component's id and isn't
    kept; an empty table gives no rows; other columns are ignored."""
    spark = vectors.sparkSession
    tables = Tables(spark, "vectors")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    good = F.col("label").isNotNull() & F.coalesce(F.size("v") > 0, F.lit(False)) & F.expr("coalesce(forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0), false)")
    rows = rows.select("vec_id", F.when(good, F.col("v")).alias("v"), F.when(good, F.col("label")).alias("label"))
    classes = rows.filter("v is not null").groupBy("label", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    step = cell_width(threshold, recall)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = []
            for v in b.column(1).to_pylist():
                x = moderate(np.array([v]))[0]
                cells.append(int(np.floor(x @ directions(len(x), m)[:, 0] / np.sqrt((x * x).sum()) / step)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.int32())], names=[*b.schema.names, "cell"])

    kind = rows.schema["label"].dataType.simpleString()
    placed = classes.select("label", "v", "n", "least").mapInArrow(place, f"label {kind}, v array<double>, n long, least long, cell int")
    classes = tables.write(placed.withColumn("c", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "classes")

    where = ["label", "dim", "cell"]
    blocks = classes.groupBy(*where).agg(F.ceil(F.count("*") / block).cast("int").alias("nb"))
    up = blocks.select("label", "dim", (F.col("cell") - 1).alias("cell"), F.col("nb").alias("nb_up"))
    down = blocks.select("label", "dim", (F.col("cell") + 1).alias("cell"), F.col("nb").alias("nb_down"))
    near = blocks.join(up, where, "left").join(down, where, "left")
    mine = classes.join(near, where).withColumn("b", F.expr("cast(pmod(xxhash64(c), nb) as int)"))
    # Tile (cell, i, to, j): block i of the cell against block j of the same cell (to = 0) or the next (to = 1).
    q = "concat(transform(sequence(b, nb - 1), j -> struct(cell, b as i, 0 as to, j)), if(nb_up is null, array(), transform(sequence(0, nb_up - 1), j -> struct(cell, b as i, 1 as to, j))))"
    t = "concat(transform(sequence(0, b), i -> struct(cell, i, 0 as to, b as j)), if(nb_down is null, array(), transform(sequence(0, nb_down - 1), i -> struct(cell - 1 as cell, i, 1 as to, b as j))))"
    dealt = mine.select("label", "dim", F.explode(F.expr(q)).alias("tile"), F.lit(True).alias("query"), "c", "n", "v").union(mine.select("label", "dim", F.explode(F.expr(t)).alias("tile"), F.lit(False), "c", "n", "v"))
    dealt = dealt.select("label", "dim", "tile.cell", "tile.i", "tile.to", "tile.j", "query", "c", "n", "v")
    least = calibrated(threshold, m, width, recall)
    tile = ["label", "dim", "cell", "i", "to", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        at = None
        for b in batches:
            parts = []
            for r in b.to_pylist():
                k = tuple(r[x] for x in tile)
                if k != at:
                    parts.append(solve(held, threshold, m, width, least))
                    held, at = [], k
                held.append(r)
            yield rows_of(parts)
        yield rows_of([solve(held, threshold, m, width, least)])

    spread = dealt.repartition(slots(spark), *tile).sortWithinPartitions(*tile, "c")
    found = tables.write(spread.mapInArrow(run, "a long, b long, add long"), "found")
    degree = found.filter("b is null").groupBy(F.col("a").alias("c")).agg(F.sum("add").alias("others"))
    comp = components(found.filter("b is not null").select("a", "b"), tables, "cc")
    labels = comp.join(classes.select(F.col("c").alias("node"), "least"), "node")
    ids = labels.groupBy("comp").agg(F.min("least").alias("component_id"))
    known = labels.join(ids, "comp").select(F.col("node").alias("c"), "component_id")
    of_class = classes.join(degree, "c", "left").join(known, "c", "left").select("label", "v", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    out = rows.join(of_class, ["label", "v"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def solve(held: list[dict], threshold: float, m: int, width: float, least: int) -> list[tuple]:
    side = [[r for r in held if r["query"] == w] for w in (True, False)]
    if not side[0] or not side[1]:
        return []
    q, t = ({"c": np.array([r["c"] for r in s], np.int64), "n": np.array([r["n"] for r in s], np.float64), "v": np.array([r["v"] for r in s])} for s in side)
    same = held[0]["to"] == 0 and held[0]["i"] == held[0]["j"]
    dq, dt, span = tile_links(q, t, same, threshold, m, width, least)
    out = [(c, None, d) for x, ds in ((q, dq), (t, dt)) for c, d in zip(x["c"].tolist(), ds.tolist()) if d]
    return out + [(a, b, 0) for a, b in span]


def rows_of(parts: list[list[tuple]]) -> pa.RecordBatch:
    rows = [r for p in parts for r in p]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["a", "b", "add"])
