"""Quality tiers of subjects from the signals of their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators.ranks import checkpointed, quantiles


def signals(items: DataFrame, key: str = "video_id", text_col: str = "reasoning") -> DataFrame:
    r = T.text(text_col)
    one = items.select(key, T.count_pattern(r).alias("c"), T.count_words_in(r).alias("p"), F.length(r).alias("n"), T.hedge_ratio(r).alias("h"))
    return one.groupBy(key).agg(F.sum("c").alias("timestamp_hits"), F.sum("p").alias("spatial_hits"), F.avg("n").alias("avg_reasoning_len"), F.avg("h").alias("generic_ratio"))


def scored(sig: DataFrame) -> DataFrame:
    """s_score from the signals and the median of the lengths, which is found by ranks before the plan is made; the
    signals are computed once."""
    sig = checkpointed(sig)
    med = F.lit(quantiles(sig, "avg_reasoning_len", [0.5])[0] or 0.0)
    score = F.least(F.col("timestamp_hits") / 6.0, F.lit(2.0)) * 1.2 + F.least(F.col("spatial_hits") / 4.0, F.lit(2.0)) * 1.0 + F.when(F.col("avg_reasoning_len") >= med, 1.0).otherwise(0.0) * 0.6 - F.col("generic_ratio") * 5.0
    return sig.withColumn("s_score", score)


def tiers(sig: DataFrame, s_at: float = 75.0, a_at: float = 25.0) -> DataFrame:
    s = scored(sig)
    return s.withColumn("tier", tier_of(s, "s_score", s_at, a_at))


def tier_of(rows: DataFrame, score: str, s_at: float = 75.0, a_at: float = 25.0) -> Column:
    """S, A or B by the percentiles of a score over all rows."""
    s_cut, a_cut = quantiles(rows, score, [s_at / 100, a_at / 100])
    return F.when(F.col(score) >= F.lit(s_cut), "S").when(F.col(score) >= F.lit(a_cut), "A").otherwise("B")


def replicate(rows: DataFrame, weights: dict[str, int], tier: str = "tier") -> DataFrame:
    """Each row as often as its tier weighs; unknown tiers once."""
    n = F.lit(1)
    for t, w in weights.items():
        n = F.when(F.col(tier) == t, w).otherwise(n)
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), n)))
