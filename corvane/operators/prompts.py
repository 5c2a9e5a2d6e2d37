"""Prompt texts built from a subject's other questions and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators.pairing import context_rows

#: Tasks whose questions tell a judge what happened, in this order (fixed values).
CONTEXT = ("temporal_localization", "open_qa", "causal_linkage", "scene_description", "video_summarization", "temporal_description")


def judge_context(items: DataFrame, pred: DataFrame) -> DataFrame:
    """(video, context): questions of the context tasks, the chosen option and the open answer, in a fixed order."""
    j = items.join(pred, "item", "left")
    task_at = F.array_position(F.array(*map(F.lit, CONTEXT)), F.col("task"))
    asked = F.concat(F.lit("- ("), F.col("task"), F.lit(") "), F.substring(T.cut_format(F.col("question")), 1, 170))
    option = T.option_text(F.col("question"), F.col("prediction"))
    line = (
        F.when(task_at > 0, asked)
        .when((F.col("task") == "mcq") & (option != ""), F.concat(F.lit("[fact, what happened] "), option))
        .when(F.col("task") == "mcq_openended", F.concat(F.lit("[fact, description] "), F.substring(T.text("prediction"), 1, 220)))
    )
    rank = F.when(task_at > 0, task_at).when(F.col("task") == "mcq", 100).otherwise(101)
    rows = j.select("video", rank.alias("r"), "ord", line.alias("line")).filter("line is not null")
    return rows.groupBy("video").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "ord", "line"))), lambda x: x["line"]), "\n").alias("context"))


def judge_prompts(items: DataFrame, pred: DataFrame, task: str = "bcq") -> DataFrame:
    q = items.filter(F.col("task") == task).join(judge_context(items, pred), "video", "left")
    say = F.concat(F.lit("Known about one video:\n"), T.text("context"), F.lit("\n\nYes/No question: "), T.cut_format(F.col("question")), F.lit("\n\nFrom this alone, answer YES, NO or UNKNOWN."))
    return q.select("item", F.lit("judge").alias("task"), say.alias("prompt"))


def evidence(items: DataFrame, pred: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(video, event, cause, option, who): what other questions of the video tell; '' where nothing."""
    loc = context_rows(items, "temporal_localization").select("video", T.cut_format(F.col("question")).alias("event"))
    cause = context_rows(items, "causal_linkage").select("video", T.cut_format(F.col("question")).alias("cause"))
    mcq = context_rows(items, "mcq").join(pred, "item", "left").select("video", T.option_text_bracket(F.col("question"), F.col("prediction")).alias("option"))
    out = items.select("video").distinct().join(loc, "video", "left").join(cause, "video", "left").join(mcq, "video", "left")
    out = out.join(pairs.select("video", F.array_join("entities", ", ").alias("who")), "video", "left") if pairs is not None else out.withColumn("who", F.lit(None).cast("string"))
    return out.fillna("", ["event", "cause", "option", "who"])


def grounded_prompts(items: DataFrame, ev: DataFrame) -> DataFrame:
    """(item, task, prompt) of the tasks whose gate is open: an open question needs an event or an option, a causal
    one an option, an open polar one a closed sibling with the same first line."""
    line = lambda t: items.filter(F.col("task") == t).select("video", "item", "question", T.first_line(F.col("question")).alias("line"))
    polar = line("bcq_openended").join(line("bcq").select("video", "line").distinct(), ["video", "line"], "left_semi").select("video", "item", F.lit("bcq_oe_no").alias("task"), "question")
    rest = items.filter(F.col("task").isin("open_qa", "causal_linkage")).select("video", "item", "task", "question")
    j = rest.unionByName(polar).join(ev, "video")
    has = lambda c: F.col(c) != ""
    gate = F.when(F.col("task") == "open_qa", has("event") | has("option")).when(F.col("task") == "causal_linkage", has("option")).otherwise(True)
    part = lambda c, label: F.when(has(c), F.concat(F.lit(f"{label}: "), F.col(c), F.lit("\n"))).otherwise("")
    prompt: Column = F.concat(part("event", "Event"), part("option", "What happened"), part("who", "Involved"), T.cut_format(F.col("question")))
    return j.filter(gate).select("item", "task", prompt.alias("prompt"))


def event_prompts(items: DataFrame, task: str, ev: DataFrame, with_option: bool = False) -> DataFrame:
    """Description or summary prompts that name the event; a video without a localization question has none."""
    body = F.concat(F.lit("Event: "), F.col("event"), F.lit("\n"))
    if with_option:
        body = F.concat(body, F.when(F.col("option") != "", F.concat(F.lit("What happened: "), F.col("option"), F.lit("\n"))).otherwise(""))
    return items.filter(F.col("task") == task).join(ev.filter("event <> ''"), "video").select("item", "task", F.concat(body, T.cut_format(F.col("question"))).alias("prompt"))
