"""Scores of predictions against answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators.medoid import token_f1

EXACT = {"bcq": T.yes_no, "mcq": T.letter_leading}
SIMILAR = ("bcq_openended", "mcq_openended", "open_qa", "causal_linkage", "scene_description", "temporal_description", "video_summarization")


def scores(rows: DataFrame, similarity=token_f1) -> DataFrame:
    """rows (task, answer, prediction) -> task, n, score. Two unreadable answers are equal; other tasks aren't scored."""
    s = F.lit(None).cast("double")
    for task, reader in EXACT.items():
        s = F.when(F.col("task") == task, reader(F.col("answer")).eqNullSafe(reader(T.unwrap_or_whole(F.col("prediction")))).cast("double")).otherwise(s)
    s = F.when(F.col("task").isin(*SIMILAR), similarity(F.col("answer"), T.unwrap_or_whole(F.col("prediction")))).otherwise(s)
    return rows.withColumn("s", s).filter("s is not null").groupBy("task").agg(F.count("*").alias("n"), F.avg("s").alias("score"))


def mean_of_tasks(scored: DataFrame) -> DataFrame:
    return scored.agg(F.avg("score").alias("mean_score"))


def empty_counts(pred: DataFrame) -> DataFrame:
    return pred.groupBy("task").agg(F.count_if(T.strip(T.text("prediction")) == "").alias("n_empty"))
