"""MinHash near-duplicates with sequential Bayesian verification (operator 9).

1. Rows of equal text become one class; only classes go on.
2. A class's set of k-word shingles gives a signature of `bands * rows` minhashes, one pass over the texts.
3. Classes that agree in a whole band are candidates. Of a band's bucket each member is first paired with the
   bucket's least class only, its star. In buckets that this leaves in several components, the members outside the
   star's are then compared with all others in tiles of bounded size: first the signatures alone, which says whose
   texts are needed, then those texts; a tile returns only links that join components. So no link between components
   is missed, and n near copies cost n rows, not n * n.
4. Candidates' signatures are compared batch by batch. With a uniform prior the similarity's posterior after n hashes,
   m of them equal, is Beta(m + 1, n - m + 1); a pair goes as soon as P(similarity >= t) < miss.
5. Survivors are verified on the whole shingle sets, of strings and not of hashes. Only the texts of classes in
   question are fetched: by a broadcast of their names while these are few (counted), beyond that a bit set of fixed
   size drops most other texts before the shuffle.
6. Components by label propagation; the classes' documents take their component.

Of pairs at the threshold, 1 - (1 - t**rows)**bands become candidates: 0.99999 for t = 0.85 with 24 bands of 6."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Tables, bit_set, keep_in_set, lean_worker, slots
from corvane.llm.graph import components
from corvane.llm.words import mix, shingles, slices, word_hashes

#: A signature has 16 bits of each minhash, the low ones once it is mixed again: the high ones of a minimum of many
#: values are few. Two that differ agree once in 65,536 times, which prunes no pair.
SIG = np.dtype("<u2")


def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(x: np.ndarray, mult: np.ndarray) -> np.ndarray:
    low = np.full(len(mult), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(x), 512):
        np.minimum(low, (x[k : k + 512, None] * mult).min(axis=0), out=low)
    return mix(low).astype(SIG)


def signatures(base: DataFrame, k: int, n_hashes: int) -> DataFrame:
    """(doc_id, cls, n_shingles, sig, row) of each row; sig is null for an empty set."""
    schema = pa.schema([("doc_id", pa.int64()), ("cls", pa.binary()), ("n_shingles", pa.int64()), ("sig", pa.binary()), ("row", pa.int64())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mult = multipliers(n_hashes)
        for whole in batches:
            for b in slices(whole, 2):
                h, first = word_hashes(b.column(2))
                sets = [shingles(h[first[i] : first[i + 1]], k) for i in range(len(b))]
                sigs = [signature(x, mult).tobytes() if len(x) else None for x in sets]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array(sigs, pa.binary()), b.column(3)], schema=schema)
        lean_worker()

    return base.select("doc_id", "cls", "text", "row").mapInArrow(make, "doc_id long, cls binary, n_shingles long, sig binary, row long")


def least_matches(t: float, miss: float, n_hashes: int, batch: int) -> list[tuple[int, int]]:
    """(n, matches below which a pair goes after n hashes): P(Beta(m+1, n-m+1) >= t) = P(Bin(n+1, t) <= m) < miss."""
    out = []
    for n in range(batch, n_hashes + 1, batch):
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= miss or m == n:
                break
            m += 1
        out.append((n, m))
    return out


def bayes_filter(pairs: DataFrame, t: float, miss: float, n_hashes: int, batch: int = 16) -> DataFrame:
    """(a, b, sig_a, sig_b) -> (a, b) that no batch has pruned."""
    rule = least_matches(t, miss, n_hashes, batch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            a, b = (np.frombuffer(b"".join(x.column(c).to_pylist()), SIG).reshape(-1, n_hashes) for c in (2, 3))
            alive, same = np.arange(len(a)), np.zeros(len(a), np.int64)
            for n, least in rule:
                same = same + (a[alive, n - batch : n] == b[alive, n - batch : n]).sum(axis=1)
                ok = same >= least
                alive, same = alive[ok], same[ok]
            yield x.select([0, 1]).take(pa.array(alive))

    return pairs.mapInArrow(run, "a long, b long")


def word_set(text: str | None, k: int) -> set:
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def exact_filter(pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b, text_a, text_b) -> (a, b) with den * intersection >= num * union, on sets of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ok, last = [], (None, None)
            for i in range(len(x)):
                t = x.column(2)[i].as_py()
                if last[0] != t or last[1] is None:
                    last = (t, word_set(t, k))
                s = word_set(x.column(3)[i].as_py(), k)
                both = len(last[1] & s)
                if both and den * both >= num * (len(last[1]) + len(s) - both):
                    ok.append(i)
            yield x.select([0, 1]).take(pa.array(ok, pa.int64()))
        lean_worker()

    return pairs.mapInArrow(run, "a long, b long")


def text_of(base: DataFrame, classes: DataFrame, needed: DataFrame, few: int = 500_000, bits: int = 24) -> DataFrame:
    """(c, text) of the needed classes (c), one row each."""
    named = classes.join(needed, "c").select("cls", "c", F.xxhash64("cls").alias("h"))
    texts = base.select("cls", "text")
    if needed.count() <= few:  # 48 bytes each
        got = texts.join(F.broadcast(named.drop("h")), "cls")
    else:
        got = keep_in_set(texts.withColumn("h", F.xxhash64("cls")), "h", bit_set(named, "h", bits), bits).drop("h").join(named.drop("h"), "cls")
    return got.groupBy("c").agg(F.first("text").alias("text"))


def tiles(labelled: DataFrame, queries: int = 512, targets: int = 1024) -> DataFrame:
    """The comparisons left open: in a bucket whose members lie in several components, each member outside the
    star's component (a query) with every member (a target). Buckets are dealt in tiles of about queries x targets
    members, so no bucket is gathered. (key, band, i, j, query, c, comp, inner)."""
    by_comp = labelled.groupBy("key", "comp").agg(F.count("*").alias("n"), F.max(F.col("c") == F.col("star")).alias("own"))
    stats = by_comp.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("own"), F.col("n"))).alias("n_in"), F.max(F.when(F.col("own"), F.col("comp"))).alias("home"), F.count("*").alias("k"))
    stats = stats.filter("k > 1 and n > 2").select("key", "home", F.ceil((F.col("n") - F.col("n_in")) / queries).cast("int").alias("ni"), F.ceil(F.col("n") / targets).cast("int").alias("nj"))
    # The star has met every member already.
    left = labelled.filter("c <> star").join(stats, "key").withColumn("inner", F.col("comp") == F.col("home"))
    cols = ["key", "band", "i", "j", "query", "c", "comp", "inner"]
    q = left.filter("not inner").withColumn("i", F.expr("cast(pmod(xxhash64(c), ni) as int)")).withColumn("j", F.explode(F.expr("sequence(0, nj - 1)"))).withColumn("query", F.lit(True)).select(cols)
    return q.union(left.withColumn("j", F.expr("cast(pmod(xxhash64(c), nj) as int)")).withColumn("i", F.explode(F.expr("sequence(0, ni - 1)"))).withColumn("query", F.lit(False)).select(cols))


class Tile:
    """The queries and targets of one tile."""

    def __init__(self, rows: list[dict], rule: list[tuple[int, int]], n_hashes: int, bands: int, width: int):
        self.queries, self.targets = [r for r in rows if r["query"]], [r for r in rows if not r["query"]]
        self.sig = np.frombuffer(b"".join(r["sig"] for r in self.targets), SIG).reshape(-1, n_hashes)
        self.ids, self.inner, self.comp = (np.array([r[c] for r in self.targets]) for c in ("c", "inner", "comp"))
        self.least, self.batch, self.bands, self.width = np.array([m for _, m in rule]), rule[0][0], bands, width

    def likely(self, q: dict) -> np.ndarray:
        """The targets of other components that no batch of hashes prunes, likeliest first."""
        if not len(self.targets):
            return np.zeros(0, np.int64)
        same = self.sig == np.frombuffer(q["sig"], SIG)
        counts = same.reshape(len(same), -1, self.batch).sum(axis=2).cumsum(axis=1)
        here = same[:, : self.bands * self.width].reshape(len(same), self.bands, self.width).all(axis=2).argmax(axis=1) == q["band"]  # a pair meets in its first common band only
        ok = np.flatnonzero((counts >= self.least).all(axis=1) & here & (self.ids != q["c"]) & (self.comp != q["comp"]) & (self.inner | (self.ids > q["c"])))
        return ok[np.argsort(-counts[ok, -1], kind="stable")]


def in_question(tile: Tile) -> list[dict]:
    """The members of a tile that have a likely partner."""
    asked, met = [], set()
    for q in tile.queries:
        likely = tile.likely(q)
        if len(likely):
            asked.append(q)
            met.update(likely.tolist())
    return asked + [tile.targets[i] for i in sorted(met)]


def joining_links(tile: Tile, k: int, num: int, den: int, sets_most: int = 8_000_000) -> list[tuple[int, int]]:
    """Links of a tile that join components. Sets of hashes find them, at most `sets_most` kept at a time; each link is
    verified on the words."""
    parent: dict[int, int] = {}
    sets: dict[int, np.ndarray] = {}
    out, size = [], 0

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    def shingle_set(r: dict) -> np.ndarray:
        nonlocal size
        if r["c"] not in sets:
            if size > sets_most:
                sets.clear()
                size = 0
            h, _ = word_hashes(pa.array([r["text"]]))
            sets[r["c"]] = shingles(h, k)
            size += len(sets[r["c"]])
        return sets[r["c"]]

    for q in tile.queries:
        for i in tile.likely(q).tolist():
            t = tile.targets[i]
            x, y = root(q["comp"]), root(t["comp"])
            if x == y:
                continue
            a, b = shingle_set(q), shingle_set(t)
            if den * min(len(a), len(b)) < num * max(len(a), len(b)):
                continue
            both = len(np.intersect1d(a, b, assume_unique=True))
            if den * both >= num * (len(a) + len(b) - both) and similar(q["text"], t["text"], k, num, den):
                parent[max(x, y)] = min(x, y)
                out.append((min(q["c"], t["c"]), max(q["c"], t["c"])))
    return out


def similar(a: str, b: str, k: int, num: int, den: int) -> bool:
    s, t = word_set(a, k), word_set(b, k)
    both = len(s & t)
    return bool(both) and den * both >= num * (len(s) + len(t) - both)


def over_tiles(members: DataFrame, solve, kind: str) -> DataFrame:
    """solve(rows of a tile, as dicts) -> a batch, for each tile; a tile comes whole to one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for x in batches:
            for part in slices(x, x.schema.get_field_index("text")) if "text" in x.schema.names else (x,):
                for r in part.to_pylist():
                    tile = (r["key"], r["i"], r["j"])
                    if tile != at:
                        if held:
                            yield solve(held)
                        held, at = [], tile
                    held.append(r)
        if held:
            yield solve(held)
        held = []
        lean_worker()

    dealt = members.repartition(slots(members.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j", "c")
    return dealt.mapInArrow(run, kind)


TILE = "key long, band int, i int, j int, query boolean, c long, comp long, inner boolean"


def tile_links(tiled: DataFrame, sig_of: DataFrame, texts_of, tables: Tables, k: int, num: int, den: int, t: float, miss: float, n_hashes: int, bands: int, width: int) -> DataFrame:
    """(a, b): links between components, at most one fewer than a tile has components. texts_of(classes) -> (c, text)."""
    rule = least_matches(t, miss, n_hashes, 16)
    names = [x.split(" ")[0] for x in TILE.split(", ")]
    types = [{"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[x.split(" ")[1]] for x in TILE.split(", ")]

    def members(rows: list[dict]) -> pa.RecordBatch:
        some = in_question(Tile(rows, rule, n_hashes, bands, width))
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in some], x) for c, x in zip(names, types)], names=names)

    def links(rows: list[dict]) -> pa.RecordBatch:
        return links_batch(joining_links(Tile(rows, rule, n_hashes, bands, width), k, num, den))

    some = tables.write(over_tiles(tiled.select(*names).join(sig_of, "c"), members, TILE), "in-question")
    if some.isEmpty():
        return some.select(F.col("c").alias("a"), F.col("c").alias("b"))
    return over_tiles(some.join(sig_of.join(texts_of(some.select("c").distinct()), "c"), "c"), links, "a long, b long")


def links_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])


def linked_classes(docs: DataFrame, tables: Tables, k: int = 5, num: int = 80, den: int = 100, bands: int = 28, rows: int = 5, miss: float = 1e-6, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows (doc_id, cls, n_shingles, sig, row), their classes (cls, c, least_doc, least, n_shingles, sig) and the
    components (node, comp) of the classes that have links. row is row_col, null without one; least is the class's
    first (no_id, doc_id, row): the least id, the least row among equals, rows without an id last."""
    t, n_hashes = num / den, bands * rows
    n_hashes += -n_hashes % 16
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (F.col(row_col) if row_col else F.lit(None)).cast("long").alias("row")).withColumn("cls", F.unhex(F.sha2("text", 256)))
    sigs = tables.write(signatures(base, k, n_hashes), "sigs")
    first_row = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("least")
    reps = sigs.groupBy("cls").agg(F.min("doc_id").alias("least_doc"), first_row, F.min("n_shingles").alias("n_shingles"), F.min("sig").alias("sig"))
    reps = tables.write(reps.withColumn("c", F.monotonically_increasing_id()), "classes")
    sets = reps.filter("sig is not null")
    band = F.expr(f"transform(sequence(0, {bands - 1}), i -> xxhash64(i, substring(sig, i * {SIG.itemsize * rows} + 1, {SIG.itemsize * rows})))")
    keys = sets.select("c", F.posexplode(band).alias("band", "key"))
    buckets = tables.write(keys.groupBy("key").agg(F.min("c").alias("star"), F.count("*").alias("n")).filter("n > 1").select("key", "star"), "buckets")
    members = tables.write(keys.join(buckets, "key").select("key", "band", "star", "c"), "members")
    sig_of = sets.select("c", "sig")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        needed = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct()
        texts = tables.write(text_of(base, reps, needed), f"{name}-texts")
        a, b = (texts.select(F.col("c").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
        out = tables.write(exact_filter(pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b"), k, num, den), f"{name}-links")
        tables.release(f"{name}-texts")
        return out

    stars = tables.write(members.filter("c <> star").select(F.col("star").alias("a"), F.col("c").alias("b")).distinct(), "stars")
    a, b = (sig_of.select(F.col("c").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab")
    alive = tables.write(bayes_filter(stars.join(a, "a").join(b, "b").select("a", "b", "sig_a", "sig_b"), t, miss, n_hashes), "alive")
    first = confirmed(alive, "star")
    comp = components(first, tables, "near1")
    labelled = tables.write(members.join(comp.select(F.col("node").alias("c"), "comp"), "c", "left").select("key", "band", "c", F.coalesce("comp", "c").alias("comp"), "star"), "labelled")
    tiled = tables.write(tiles(labelled), "tiles")
    found = tile_links(tiled, sig_of, lambda needed: tables.write(text_of(base, reps, needed), "tile-texts"), tables, k, num, den, t, miss, n_hashes, bands, rows)
    second = tables.write(found.distinct(), "found")
    comp = tables.write(components(first.union(second), tables, "near2"), "components")
    tables.release("members", "stars", "alive", "tiles", "tile-texts", "found", "buckets", "labelled", "in-question")
    return sigs, reps, comp


def near_components(docs: DataFrame, tables: Tables, **options) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id."""
    sigs, reps, comp = linked_classes(docs, tables, **options)
    labels = comp.join(reps.select(F.col("c").alias("node"), "least_doc"), "node")
    ids = labels.groupBy("comp").agg(F.min("least_doc").alias("component_id"))
    known = labels.join(ids, "comp").select(F.col("node").alias("c"), "component_id")
    of_class = reps.join(known, "c", "left").select("cls", F.coalesce("component_id", "least_doc").alias("component_id"))
    own = F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return sigs.join(of_class, "cls").select("doc_id", "n_shingles", own.alias("component_id"))


def near_survivors(docs: DataFrame, row_col: str, **options) -> DataFrame:
    """(row): the number of the one row that stays of each component, by row_col, which numbers the rows of docs.

    It is the row with the least id, of several the least row number; a row without an id stays only where no row has
    one. Blank texts link with nothing, so each of their rows stays."""
    tables = Tables(docs.sparkSession, "minhash")
    sigs, reps, comp = linked_classes(docs, tables, row_col=row_col, **options)
    labels = reps.filter("sig is not null").join(comp.withColumnRenamed("node", "c"), "c", "left")
    of_group = labels.groupBy(F.coalesce("comp", "c").alias("g")).agg(F.min("least").alias("least"))
    out = tables.write(of_group.select("least.row").union(sigs.filter("sig is null").select("row")), "survivors")
    tables.release(*[k for k in list(tables.paths) if k != "survivors"])
    return out


def minhash_dedup(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (doc_id = component_id): one row per row of docs.

    Defined results: null and blank texts have no shingles and link with nothing, not even their copies
    (component_id is their own id); a null id takes its component's id and isn't kept, and has none if no document
    there has an id; repeated rows with the kept id are each kept; an empty table gives no rows; other columns are
    ignored."""
    out = near_components(docs, Tables(docs.sparkSession, "minhash"), **options)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
