"""Votes in long form: one row per vote, with its position in the concatenated pool. Order is semantic: among equally
frequent values the one seen first wins. Two aggregations, both combined before their shuffle; a hot item is spread
by value first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def majority(votes: DataFrame, item: str = "item", value: str = "value", pos: str = "pos") -> DataFrame:
    """item, value, top, n, margin_a = (2 top - n) / n, margin_b = top / n. Null and empty votes don't count."""
    real = votes.filter(F.col(value).isNotNull() & (F.col(value) != ""))
    counts = real.groupBy(item, F.col(value).alias("value")).agg(F.count("*").alias("k"), F.min(pos).alias("p"))
    out = counts.groupBy(item).agg(F.max_by("value", F.struct("k", (-F.col("p")).alias("p"))).alias("value"), F.max("k").alias("top"), F.sum("k").alias("n"))
    return out.withColumns({"margin_a": (2 * F.col("top") - F.col("n")).cast("double") / F.col("n"), "margin_b": F.col("top").cast("double") / F.col("n")})


def margins_with_empty(items: DataFrame, votes: DataFrame, item: str = "item") -> DataFrame:
    """Margins of every item; without votes margin_a is 1 and margin_b is 0."""
    return items.select(item).distinct().join(majority(votes, item), item, "left").fillna({"margin_a": 1.0, "margin_b": 0.0})


def pool_arrays(votes: DataFrame, item: str = "item") -> DataFrame:
    """item, pool: the exact ordered votes."""
    return votes.groupBy(item).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("pool"))


def interleaved(a: DataFrame, b: DataFrame, item: str = "item") -> DataFrame:
    """Two pools in turn, then the longer one's rest: positions anew from 0."""
    from pyspark.sql import Window as W

    # One shuffle, by item, for all windows.
    both = a.withColumn("src", F.lit(0)).unionByName(b.withColumn("src", F.lit(1)), allowMissingColumns=True).filter(F.col(item).isNotNull()).repartition(item)
    both = both.withColumn("k", F.row_number().over(W.partitionBy(item, "src").orderBy("pos")))
    longest = lambda src: F.coalesce(F.max(F.when(F.col("src") == src, F.col("k"))).over(W.partitionBy(item)), F.lit(0))
    both = both.withColumn("m", F.least(longest(0), longest(1)))
    order = W.partitionBy(item).orderBy(F.least(F.col("k"), F.col("m") + 1), F.when(F.col("k") > F.col("m"), F.lit(0)).otherwise(F.col("src")), "src", "k")
    return both.withColumn("pos", F.row_number().over(order) - 1).drop("k", "src", "m")
