"""Grouped train and validation splits: a subject is wholly on one side."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.operators.ranks import at_ranks


def split_size(n: int, ratio: float) -> int:
    return max(1, int(n * ratio))


def by_hash(rows: DataFrame, key: str, ratio: float = 0.05, seed: int = 42) -> DataFrame:
    """split: the subjects with the least (md5(seed, key), key) are validation. The last of them is found by its rank;
    rows are then told by comparison with it, without a join. A null key is never validation."""
    md5 = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    ids = rows.select(md5.alias("h_"), key).distinct()
    n = ids.filter(F.col(key).isNotNull()).count()
    last = at_ranks(ids, ["h_", key], [split_size(n, ratio) - 1]) if n else {}
    if not last:
        return rows.withColumn("split", F.lit("train"))
    (end,) = last.values()
    low = (md5 < F.lit(end["h_"])) | ((md5 == F.lit(end["h_"])) & (F.col(key) <= F.lit(end[key]).cast(rows.schema[key].dataType)))
    return rows.withColumn("split", F.when(low & F.col(key).isNotNull(), "val").otherwise("train"))


def by_shuffle(rows: DataFrame, key: str, ratio: float = 0.05, seed: int = 42) -> DataFrame:
    """split by a Mersenne Twister shuffle of the sorted subjects, on the driver: for subject lists that fit there."""
    ids = [r[0] for r in rows.select(key).distinct().orderBy(key).collect()]
    random.Random(seed).shuffle(ids)
    val = rows.sparkSession.createDataFrame([(x,) for x in ids[: split_size(len(ids), ratio)]], rows.select(key).schema)
    return rows.join(F.broadcast(val.withColumn("v", F.lit(True))), key, "left").withColumn("split", F.when(F.col("v"), "val").otherwise("train")).drop("v")


def record_ids(items: DataFrame, key: str = "video_id", order: str = "ord") -> DataFrame:
    """id = key::task::number of the item within key and task."""
    k = F.row_number().over(W.partitionBy(key, "task").orderBy(order)) - 1
    return items.withColumn("id", F.concat_ws("::", F.col(key).cast("string"), F.col("task"), k.cast("string")))


def summary(records: DataFrame) -> DataFrame:
    """kind, value, n, mean_weight: all counts in one pass by grouping sets."""
    sets = records.groupingSets([["tier"], ["task"], ["split"], []], "tier", "task", "split")
    agg = sets.agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.avg("init_weight").alias("mean_weight"))
    kind = F.when(F.col("g") == 3, "tier").when(F.col("g") == 5, "task").when(F.col("g") == 6, "split").otherwise("all")
    return agg.select(kind.alias("kind"), F.coalesce("tier", "task", "split").alias("value"), "n", "mean_weight")
