"""Sibling questions: the closed and the open form of one question about one subject."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators.ranks import checkpointed


def _both_ways(first: DataFrame) -> DataFrame:
    """first (x, ox, y), one row an x, to (item, sibling) both ways: a y chosen by several is paired back with the last x."""
    back = F.row_number().over(W.partitionBy("y").orderBy(F.desc("ox"))) == 1
    ways = F.array(F.struct(F.col("x").alias("item"), F.col("y").alias("sibling")), F.struct(F.col("y").alias("item"), F.col("x").alias("sibling")))
    return first.select("x", "y", back.alias("back")).select(F.explode(F.slice(ways, 1, F.when(F.col("back"), 2).otherwise(1))).alias("p")).select("p.*")


def choice_siblings(items: DataFrame, closed: str = "mcq", open_: str = "mcq_openended", least: int = 3, few: int = 20_000) -> DataFrame:
    """items (item, video, task, question, ord): equal stem and at least `least` (1 to 4) common normal options. Each x
    takes its first y. Only lines that look like options are parsed; a question without four of them shares none.

    Two sets share `least` options exactly if they share a subset of that size, and four options have six such subsets
    at most. So questions meet by (video, stem, subset), where only the first y of each key is kept: no pairs of a stem
    are made, and the work grows with the number of questions.

    Parsing is most of the work. Where the same questions are asked of many subjects, `few` different texts at most and
    64 MB of them, each text is parsed once and what it says is broadcast; else each row is parsed in its place."""
    if not 1 <= least <= len(T.LETTERS):
        raise ValueError(f"least must lie between 1 and {len(T.LETTERS)}: {least}")
    keys = ["video", "stem", "shared"]

    def parsed(rows: DataFrame, *kept: str) -> DataFrame:
        q = rows.filter(F.regexp_like(T.text("question"), F.lit(T.MARK)))
        opts = F.array_sort(F.array_distinct(T.normal_options(T.options(F.col("question")))))
        return q.select(*kept, T.stem(F.col("question")).alias("stem"), opts.alias("o"))

    asked = items.filter(F.col("task").isin(closed, open_))
    size = asked.agg(F.approx_count_distinct("question").alias("n"), F.max(F.octet_length("question")).alias("most")).first()
    texts = None
    if size["n"] <= few and size["n"] * (size["most"] or 0) <= 1 << 26:
        texts = F.broadcast(checkpointed(parsed(asked.select("question").distinct(), "question")))

    def side(task: str) -> DataFrame:
        # explode_outer: for explode the optimizer adds a filter that parses the question once for each use of o.
        rows = items.filter(F.col("task") == task)
        q = parsed(rows, "video", "item", "ord") if texts is None else rows.join(texts, "question").select("video", "item", "ord", "stem", "o")
        subsets = F.array(*(F.array(*(F.get("o", F.lit(i)) for i in some)) for some in combinations(range(len(T.LETTERS)), least)))
        return q.select("video", "stem", "item", "ord", F.explode_outer(F.filter(subsets, lambda x: F.forall(x, lambda v: v.isNotNull()))).alias("shared"))

    first = side(open_).groupBy(*keys).agg(F.min(F.struct(F.col("ord").alias("oy"), F.col("item").alias("y"))).alias("m"))
    met = side(closed).select(*keys, F.col("item").alias("x"), F.col("ord").alias("ox")).join(first, keys)
    return _both_ways(met.groupBy("x").agg(F.min(F.struct("m.oy", "ox", "m.y")).alias("m")).select("x", "m.*"))


def stance_siblings(items: DataFrame, closed: str = "bcq", open_: str = "bcq_openended") -> DataFrame:
    """Equal stem. Without a further condition every x of a (video, stem) meets the same first y, so no pairs are made.

    An item given by several rows has one sibling, the first over all of them."""
    q = items.select("item", "video", "task", "ord", T.pair_stem(F.col("question")).alias("stem"))
    keys = ["video", "stem"]
    first = q.filter(F.col("task") == open_).groupBy(*keys).agg(F.min(F.struct("ord", "item")).alias("y"))
    met = q.filter(F.col("task") == closed).join(first, keys)
    forth = met.groupBy(F.col("item").alias("x")).agg(F.min("y").alias("y"), F.max("ord").alias("ox"))
    return _both_ways(forth.select("x", "ox", F.col("y.item").alias("y")))


def stance_by_line(items: DataFrame, predictions: DataFrame, closed: str = "bcq", open_: str = "bcq_openended") -> DataFrame:
    """(item, stance): an open item takes the decided stance of the closed item with the same first line; the last of several."""
    q = items.withColumn("line", F.lower(T.first_line(T.cut_format(F.col("question")))))
    said = q.filter(F.col("task") == closed).join(predictions, "item", "left").groupBy("video", "line").agg(F.max_by(F.lower(T.strip(T.text("prediction"))), "ord").alias("stance"))
    return q.filter(F.col("task") == open_).join(said, ["video", "line"], "left").select("item", "stance")


def context_rows(items: DataFrame, task: str, last: bool = False) -> DataFrame:
    """Of each subject the first (or last) question of a task."""
    pick = F.max_by if last else F.min_by
    return items.filter(F.col("task") == task).groupBy("video").agg(pick(F.struct("item", "question"), "ord").alias("c")).select("video", "c.*")
