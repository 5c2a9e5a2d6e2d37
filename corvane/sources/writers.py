"""Sinks. Each writes through Spark's writers; single-file forms are for results meant for people."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from corvane.functions.rounding import python_round


def jsonl(rows: DataFrame, path: str, order: list[str] | None = None, single: bool = False) -> None:
    """One JSON object a line, fields that are null left out, non-ASCII kept."""
    cols = rows.columns
    out = rows.repartition(1) if single else rows  # the rows meet in one task, but aren't computed in it
    out = (out.sortWithinPartitions(*order) if single else out.orderBy(*order)) if order else out
    out.select(F.to_json(F.struct(*cols)).alias("value")).write.mode("overwrite").text(path)


def counted_jsonl(rows: DataFrame, path: str, known: dict[str, list[str]]) -> dict[str, dict[str | None, int]]:
    """Writes one JSON object a line, null fields kept, and returns how many rows each value of some columns has.

    Values named in `known` are counted while the rows are written, in the writing tasks themselves, so nothing is read
    twice and a repeated attempt of a task isn't counted twice. Only if rows are left over (other values, or null) are
    they counted from the written files. Values without rows are left out."""
    watch = Observation()
    named = {f"n{i}_{j}": (c, v) for i, (c, vs) in enumerate(known.items()) for j, v in enumerate(vs)}
    counts = [F.count_if(F.col(c) == v).alias(name) for name, (c, v) in named.items()]
    lines = rows.observe(watch, F.count("*").alias("all"), *counts)
    lines.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)
    seen = watch.get
    out: dict[str, dict[str | None, int]] = {c: {} for c in known}
    for name, (c, v) in named.items():
        if seen[name]:
            out[c][v] = seen[name]
    for c, vs in known.items():
        if sum(out[c].values()) < seen["all"]:
            back = rows.sparkSession.read.schema(rows.select(c).schema).json(path)
            rest = back.filter(F.col(c).isNull() | ~F.col(c).isin(*vs)).groupBy(c).count()
            out[c] |= {r[c]: r["count"] for r in rest.collect()}
    return out


def split_jsonl(records: DataFrame, path: str) -> None:
    """A folder split=train and one split=val; records keep their split column."""
    records.withColumn("part", F.col("split")).select("part", F.to_json(F.struct(*records.columns)).alias("value")).withColumnRenamed("part", "split").write.mode("overwrite").partitionBy("split").text(path)


def submission(pred: DataFrame, path: str) -> int:
    """item_index,prediction; returns how many predictions are blank."""
    pred.select(F.col("item").alias("item_index"), "prediction").write.mode("overwrite").options(header=True, escape='"', quoteAll=False).csv(path)
    return pred.filter(F.trim(F.coalesce("prediction", F.lit(""))) == "").count()


def append_pool(rows: DataFrame, path: str) -> None:
    """A batch of pool rows; readers take the whole folder, so nothing is written twice."""
    rows.write.mode("append").parquet(path)


def reports(tier: DataFrame, consistency: DataFrame, summary: DataFrame, path: str) -> None:
    jsonl(tier, f"{path}/tiers", single=True)
    jsonl(consistency.withColumn("mean_score", python_round(F.col("mean_score"), 4)), f"{path}/consistency", single=True)
    jsonl(summary.withColumn("mean_weight", python_round(F.col("mean_weight"), 3)), f"{path}/summary", single=True)


def conversations(records: DataFrame) -> DataFrame:
    """Image-conversation records (idx, fps, images, question, reasoning, answer, tier, task, init_weight)."""
    from corvane.functions.frames import timed_prompt
    from corvane.functions.text import thought_answer

    turn = lambda who, v: F.struct(F.lit(who).alias("from"), v.alias("value"))
    talk = F.array(turn("human", timed_prompt(F.col("idx"), F.col("fps"), F.col("question"))), turn("gpt", thought_answer(F.col("reasoning"), F.col("answer"))))
    return records.select(talk.alias("conversations"), "images", "tier", "task", F.coalesce("init_weight", F.lit(1.0)).alias("init_weight"))
