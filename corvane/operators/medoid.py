"""Minimum-risk choice: of an item's candidates the one most similar to the others, the first among equals."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions.text import token_set


@dataclass(frozen=True)
class Similarity:
    """compare(prepare(a), prepare(b)); prepare runs once a candidate, compare once a pair."""

    prepare: Callable[[Column], Column]
    compare: Callable[[Column, Column], Column]

    def __call__(self, a: Column, b: Column) -> Column:
        return self.compare(self.prepare(a), self.prepare(b))


def _f1(x: Column, y: Column) -> Column:
    both = F.size(F.array_intersect(x, y)).cast("double")
    return F.when(F.size(x) + F.size(y) == 0, F.lit(1.0)).otherwise(2 * both / (F.size(x) + F.size(y)))


token_f1 = Similarity(token_set, _f1)


def distinct_capped(cands: DataFrame, cap: int | None = 48, item: str = "item") -> DataFrame:
    """First occurrences only, the first `cap` of them."""
    first = cands.filter(F.coalesce(F.col("value") != "", F.lit(False))).groupBy(item, "value").agg(F.min("pos").alias("pos"))
    if cap is None:
        return first
    return first.withColumn("k", F.row_number().over(W.partitionBy(item).orderBy("pos"))).filter(F.col("k") <= cap).drop("k")


def _chosen(rows: DataFrame, item: str) -> DataFrame:
    """(item, pos, value, u) -> the value of the greatest u, the least pos among equals."""
    return rows.groupBy(item).agg(F.max_by("value", F.struct("u", (-F.col("pos")).alias("k"))).alias("value"))


def _in_arrays(values: DataFrame, similarity: Similarity, item: str) -> DataFrame:
    """One row an item: its distinct values with what is prepared of each (d), and all candidates in the order of their
    positions (c). Each pair of distinct values is compared once; a candidate's utility is summed in the order of
    positions, as sums of doubles and so ties depend on it."""
    entry = F.struct("value", "places", similarity.prepare(F.col("value")).alias("t"))
    pools = values.groupBy(item).agg(F.array_sort(F.collect_list(F.struct(F.array_min("places").alias("first"), entry.alias("e")))).alias("d"))
    pools = pools.select(item, F.transform("d", lambda x: x["e"]).alias("d"))
    order = F.array_sort(F.flatten(F.transform("d", lambda e, i: F.transform(e["places"], lambda p: F.struct(p.alias("pos"), i.alias("v"))))))
    pools = pools.withColumn("c", order).withColumn("one", F.explode(F.transform("d", lambda e, i: F.struct(e.alias("e"), i.alias("i")))))
    alike = F.transform("d", lambda e: similarity.compare(F.col("one.e.t"), e["t"]))
    pools = pools.select(item, "c", F.col("one.e.value").alias("value"), F.col("one.e.places").alias("places"), alike.alias("s"))
    total = lambda p: F.aggregate("c", F.lit(0.0), lambda m, x: m + F.when(x["pos"] == p, 0.0).otherwise(F.get("s", x["v"])))
    return pools.select(item, "value", F.explode(F.transform("places", lambda p: F.struct(p.alias("pos"), total(p).alias("u")))).alias("x")).select(item, "value", "x.pos", "x.u")


def medoid(cands: DataFrame, similarity: Similarity = token_f1, distinct: bool = True, cap: int | None = 48, item: str = "item", many: int = 4096) -> DataFrame:
    """item, value: candidates (item, pos, value). distinct: without repeats and capped, before any pair is made;
    otherwise repeats reinforce each other. Items of up to `many` candidates are solved in one row of arrays, larger
    ones by pairs of distinct values."""
    pool = distinct_capped(cands, cap, item) if distinct else cands.filter(F.coalesce(F.col("value") != "", F.lit(False))).select(item, "value", "pos")
    if distinct and cap is not None and cap <= many:
        return _chosen(_in_arrays(pool.select(item, "value", F.array("pos").alias("places")), similarity, item), item)
    sizes = pool.groupBy(item).agg(F.count("*").alias("n"))
    large = sizes.filter(F.col("n") > many).select(item)
    small = pool.join(large, item, "left_anti").groupBy(item, "value").agg(F.collect_list("pos").alias("places"))
    out = _chosen(_in_arrays(small, similarity, item), item)
    if large.isEmpty():
        return out
    # A value's places aren't listed: how many and the first are enough.
    hot = pool.join(large, item, "left_semi").groupBy(item, "value").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    return out.unionByName(_chosen(_weighted_counts(hot, similarity, item), item))


def _weighted_counts(v: DataFrame, similarity: Similarity, item: str) -> DataFrame:
    """(item, value, n, pos) -> (item, value, pos, u): repeats of a value count by their number, so the pairs are those of
    distinct values, dealt over tasks by the first of them. The same sums as in arrays but for their order."""
    v = v.withColumn("t", similarity.prepare(F.col("value")))
    other = v.select(item, F.col("value").alias("y"), F.col("n").alias("m"), F.col("t").alias("ty"))
    own = F.col("m") - F.when(F.col("value") == F.col("y"), 1).otherwise(0)
    pairs = v.join(other, item).select(item, "value", "pos", (own * similarity.compare(F.col("t"), F.col("ty"))).alias("s"))
    return pairs.groupBy(item, "value", "pos").agg(F.sum("s").alias("u"))


def medoid_vectors(rows: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """group, key, n, mean_similarity: of each group the vector with the greatest sum of cosines to the others (the least
    key among equals). That sum is the dot product of the vector, scaled to length 1, with the sum of all scaled
    vectors of the group, less 1: two aggregates, no pairs. Vectors that are null, zero or hold nulls or numbers that
    aren't finite take no part, nor do rows without a group."""
    length = F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda m, x: m + x.cast("double") * x))
    unit = rows.select(group, key, F.col(vector).alias("x_"), length.alias("r_")).filter(F.col(group).isNotNull() & (F.col("r_") > 0) & ~F.isnan("r_") & (F.col("r_") < float("inf")))
    unit = unit.select(group, key, F.transform("x_", lambda x: x.cast("double") / F.nullif(F.col("r_"), F.lit(0.0))).alias("x_"))
    sums = unit.select(group, F.posexplode("x_").alias("i", "x")).groupBy(group, "i").agg(F.sum("x").alias("x"))
    sums = sums.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("s_"))
    use = F.aggregate(F.arrays_zip("x_", "s_"), F.lit(-1.0), lambda m, p: m + p["x_"] * p["s_"])
    best = unit.join(sums, group).select(group, key, use.alias("u")).groupBy(group).agg(F.count("*").alias("n"), F.max(F.struct("u", (-F.col(key)).alias("k"))).alias("b"))
    return best.select(group, (-F.col("b.k")).alias(key), "n", (F.col("b.u") / F.greatest(F.col("n") - 1, F.lit(1))).alias("mean_similarity"))
