"""Rules that compare a subject's answers to related questions: 1 consistent, 0 conflicting, 0.5 undecided."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import clock as C
from corvane.functions import text as T

UNDECIDED = 0.5


def by_task(items: DataFrame, tasks, key: str = "video_id") -> DataFrame:
    """One row per subject: of each task its first item as a struct, and the yes and no counts of the polar task."""
    first = [F.min_by(F.when(F.col("task") == t, F.struct("question", "answer", "reasoning")), F.when(F.col("task") == t, F.col("ord"))).alias(t) for t in tasks]
    p = T.prefix_polarity(T.text("answer"))
    return items.groupBy(key).agg(*first, F.count_if((F.col("task") == "bcq") & (p == "yes")).alias("n_yes"), F.count_if((F.col("task") == "bcq") & (p == "no")).alias("n_no"))


def _score(undecided: Column, good: Column) -> Column:
    return F.when(F.coalesce(undecided, F.lit(True)), UNDECIDED).when(good, 1.0).otherwise(0.0)


def _answer(task: str) -> Column:
    return T.text(F.col(task)["answer"])


def polar_cause(a: str, b: str) -> Column:
    says = T.implies_event(_answer(b))
    return _score(F.col(b).isNull() | (F.col("n_yes") + F.col("n_no") == 0) | says.isNull(), (F.col("n_yes") >= F.col("n_no")) == says)


def time_pair(a: str, b: str, tolerance: int = 10) -> Column:
    start = C.first_clock(C.start_text(_answer(a)))
    said = F.concat_ws(" ", _answer(b), T.text(F.col(b)["reasoning"]))
    p = r"(\d{1,2}):(\d{2})(?:\.\d+)?"
    seen = F.zip_with(F.regexp_extract_all(said, F.lit(p), F.lit(1)), F.regexp_extract_all(said, F.lit(p), F.lit(2)), lambda m, s: m.cast("int") * 60 + s.cast("int"))
    return _score(F.col(a).isNull() | F.col(b).isNull() | start.isNull() | (F.size(seen) == 0), F.exists(seen, lambda s: F.abs(s - start) <= tolerance))


def overlap(x: Column, y: Column, missing: Column, floor: float) -> Column:
    a, b = T.long_words(x), T.long_words(y)
    return _score(missing | (F.size(a) == 0) | (F.size(b) == 0), T.jaccard(a, b) >= floor)


def text_pair(a: str, b: str, floor: float = 0.15) -> Column:
    return overlap(_answer(a), _answer(b), F.col(a).isNull() | F.col(b).isNull(), floor)


def option_cause(a: str, b: str) -> Column:
    option = T.option_line(F.col(a)["question"], F.col(a)["answer"])
    return overlap(T.text(option), _answer(b), F.col(a).isNull() | F.col(b).isNull() | option.isNull(), 0.10)


#: Rules by task pair; a new rule is a function of two task columns.
RULES: dict[tuple[str, str], Callable[[str, str], Column]] = {
    ("bcq", "causal_linkage"): polar_cause,
    ("temporal_localization", "temporal_description"): time_pair,
    ("scene_description", "video_summarization"): text_pair,
    ("mcq", "causal_linkage"): option_cause,
}


def consistency(items: DataFrame, pairs=tuple(RULES), below: float = 0.4, weight: float = 0.5, key: str = "video_id") -> DataFrame:
    """key, pair_scores map, mean_score, downweight. A pair given in reverse uses its rule with the tasks as given."""
    tasks = sorted({t for p in pairs for t in p})
    wide = by_task(items, tasks, key)
    rule = lambda p: RULES.get(p) or RULES.get((p[1], p[0]))
    scores = [(f"{a}|{b}", rule((a, b))(a, b) if rule((a, b)) else F.lit(UNDECIDED)) for a, b in pairs]
    total = F.lit(0.0)
    for _, s in scores:
        total = total + s
    mean = total / len(scores) if scores else F.lit(UNDECIDED)
    cells = [x for k, s in scores for x in (F.lit(k), s)]
    out = wide.select(key, (F.create_map(*cells) if cells else F.create_map().cast("map<string,double>")).alias("pair_scores"), mean.alias("mean_score"))
    return out.withColumn("downweight", F.when(F.col("mean_score") < below, weight).otherwise(1.0))


def flagged(rows: DataFrame) -> DataFrame:
    """(n, flagged): how many rows there are and how many weigh less than 1."""
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("downweight") < 1.0).alias("flagged"))
