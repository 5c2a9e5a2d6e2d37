"""Nearest-key join of two tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _beyond(blocks: DataFrame, by: str, levels: int, fan: int = 1 << 12) -> DataFrame:
    """blocks (by, b_, lo_, hi_), once each, the keys' ends null where a block has none: (by, b_, before_, after_), the
    greatest key of the earlier blocks and the least of the later ones. Blocks of a `by` meet in groups of `fan` places,
    and what lies beyond a group comes from the groups in the same way, so no task holds all blocks of a hot one. Both
    windows grow from their start: one that shrinks to the end would be gone through again for each row."""
    keys = [by, "g_"] if levels else [by]
    rows = blocks.withColumn("g_", F.floor(F.col("b_") / fan)) if levels else blocks
    earlier = W.partitionBy(*keys).orderBy("b_").rowsBetween(W.unboundedPreceding, -1)
    later = W.partitionBy(*keys).orderBy(F.desc("b_")).rowsBetween(W.unboundedPreceding, -1)
    out = rows.withColumn("before_", F.last("hi_", True).over(earlier)).withColumn("after_", F.last("lo_", True).over(later))
    if levels:
        groups = rows.groupBy(by, F.col("g_").alias("b_")).agg(F.min("lo_").alias("lo_"), F.max("hi_").alias("hi_"))
        far = _beyond(groups, by, levels - 1, fan).select(by, F.col("b_").alias("g_"), F.col("before_").alias("far_before_"), F.col("after_").alias("far_after_"))
        out = out.join(far, [by, "g_"]).withColumns({"before_": F.coalesce("before_", "far_before_"), "after_": F.coalesce("after_", "far_after_")})
    return out.select(by, "b_", "before_", "after_")


def nearest_keys(rows: DataFrame, keys: DataFrame, by: str, at: str, width: int = 1 << 16) -> DataFrame:
    """rows with `near`: of the keys (by, at) of the same `by` the nearest to the row's `at`, the smaller of two equally
    near; rows without any key go. Rows and keys of a `by` meet in blocks of `width` places, so a hot one is dealt over
    its blocks; what lies beyond a block comes from the least and greatest key of each block."""
    block = F.floor(F.col(at) / width)
    own = keys.select(F.col(by), F.col(at).alias("k_")).filter(F.col(by).isNotNull() & F.col("k_").isNotNull()).distinct().withColumn("b_", F.floor(F.col("k_") / width))
    none = F.lit(None).cast(own.schema["k_"].dataType)
    asked = rows.withColumn("b_", block)
    ends = own.select(by, "b_", F.col("k_").alias("lo_"), F.col("k_").alias("hi_")).unionByName(asked.select(by, "b_", none.alias("lo_"), none.alias("hi_")).filter(F.col(by).isNotNull() & F.col("b_").isNotNull()))
    places = _beyond(ends.groupBy(by, "b_").agg(F.min("lo_").alias("lo_"), F.max("hi_").alias("hi_")), by, 2)
    both = asked.select("*", none.alias("k_"), F.col(at).alias("at_"), F.lit(1).alias("side_")).unionByName(own.select(by, "b_", "k_", F.col("k_").alias("at_"), F.lit(0).alias("side_")), allowMissingColumns=True)
    left = W.partitionBy(by, "b_").orderBy("at_", "side_").rowsBetween(W.unboundedPreceding, 0)
    right = W.partitionBy(by, "b_").orderBy(F.desc("at_"), F.desc("side_")).rowsBetween(W.unboundedPreceding, 0)
    met = both.select("*", F.last("k_", True).over(left).alias("l_"), F.last("k_", True).over(right).alias("r_")).filter("side_ = 1").join(places, [by, "b_"], "left")
    near = F.array_min(F.transform(F.array_compact(F.array("l_", "r_", "before_", "after_")), lambda k: F.struct(F.abs(k - F.col(at)).alias("d"), k.alias("k"))))["k"]
    return met.withColumn("near", near).filter(F.col("near").isNotNull()).select(*rows.columns, "near")
