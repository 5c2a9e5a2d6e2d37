"""Decisions after the vote, in this order: judge override, pair repair, no-stance texts, guard against blanks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T


def override(pred: DataFrame, verdicts: DataFrame, margins: DataFrame, limit: float = 0.5) -> DataFrame:
    """pred (item, prediction): a judge's yes or no replaces a prediction whose margin_a is at most `limit`."""
    sure = verdicts.filter(F.col("verdict").isin("yes", "no"))
    j = pred.join(sure.select("item", "verdict"), "item", "left").join(margins.select("item", "margin_a"), "item", "left")
    take = F.col("verdict").isNotNull() & (F.coalesce("margin_a", F.lit(1.0)) <= limit)
    return j.select("item", F.when(take, T.capitalised(F.col("verdict"))).otherwise(F.col("prediction")).alias("prediction"))


def pair_repair(members: DataFrame, margin: str = "margin_a", empty: float = 1.0) -> DataFrame:
    """members (group, item, ord, prediction, margin, verdict): in groups of exactly two with equal answers one flips:
    the one its verdict contradicts, if it is the only one; else the one of lower margin, the first among equals."""
    p = F.lower(T.strip(T.text("prediction")))
    row = F.struct("ord", "item", p.alias("p"), F.coalesce(F.col(margin), F.lit(empty)).alias("m"), (F.col("verdict").isin("yes", "no") & (F.col("verdict") != p)).alias("d"))
    g = members.groupBy("group").agg(F.count("*").alias("n"), F.min(row).alias("a"), F.max(row).alias("b")).filter("n = 2 and a.p = b.p")
    da, db = (F.coalesce(F.col(f"{x}.d"), F.lit(False)) for x in "ab")
    flip = F.when(da & ~db, F.col("a.item")).when(db & ~da, F.col("b.item")).when(F.col("a.m") <= F.col("b.m"), F.col("a.item")).otherwise(F.col("b.item"))
    out = members.join(g.select(flip.alias("item"), F.lit(True).alias("flip")), "item", "left")
    return out.select("group", "item", F.when(F.col("flip"), T.flipped(F.col("prediction"))).otherwise(F.col("prediction")).alias("prediction"))


def no_stance_texts(pred: DataFrame, stances: DataFrame, texts: DataFrame) -> DataFrame:
    """Where the sibling's stance is no, the evidence text (item, value) replaces the prediction if it says no itself."""
    j = pred.join(stances, "item", "left").join(texts.select("item", "value"), "item", "left")
    take = (F.col("stance") == "no") & (T.yes_no(F.col("value")) == "no")
    return j.select("item", F.when(F.coalesce(take, F.lit(False)), F.col("value")).otherwise(F.col("prediction")).alias("prediction"))


def guard(pred: DataFrame, fallback: DataFrame, last: str = "No") -> DataFrame:
    """A blank prediction becomes the fallback's value, else `last`."""
    j = pred.join(fallback.select("item", "value"), "item", "left")
    return j.select("item", F.coalesce(T.blank_null(T.strip(T.text("prediction"))), T.blank_null(F.col("value")), F.lit(last)).alias("prediction"))
