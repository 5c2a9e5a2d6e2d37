"""Corpus build: items to tiered, weighted, split records, then the union with external records. One lazy plan; the
only global values are a median, two percentiles and a subject count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.rounding import python_round
from corvane.operators.consistency import consistency
from corvane.operators.split import by_hash, by_shuffle, record_ids
from corvane.operators.tiers import signals, tiers
from corvane.sources.config import Settings


def build_records(items: DataFrame, settings: Settings | None = None, exact_split: bool = False) -> DataFrame:
    """items (video_id, task, question, answer, reasoning, ord) -> training records."""
    s = settings or Settings()
    t = tiers(signals(items), s.tier.s_percentile, s.tier.a_percentile).select("video_id", "tier")
    c = consistency(items, below=s.conflict_threshold, weight=s.conflict_downweight).select("video_id", "mean_score", "downweight")
    w = F.lit(1.0)
    for name, x in s.tier.weights.items():
        w = F.when(F.col("tier") == name, float(x)).otherwise(w)
    rows = record_ids(items).join(t, "video_id").join(c, "video_id")
    rows = (by_shuffle if exact_split else by_hash)(rows, "video_id", s.val_ratio, s.seed)
    first = rows.groupBy("video_id").agg(F.min("ord").alias("video_ord"))
    rows = rows.join(first, "video_id")
    return rows.select("id", "video_id", "task", "question", "answer", "reasoning", "tier", python_round(F.col("mean_score"), 4).alias("consistency_score"), python_round(w * F.col("downweight"), 4).alias("init_weight"), "split", "video_ord", "ord")


def merge(train: DataFrame, external: DataFrame, video_dir: str) -> DataFrame:
    """Records of the training split and external ones (tier A) in the merged form, with their source and order."""
    cols = ["video_path", "task", "question", "answer", "reasoning", "tier", "source"]
    a = train.filter("split = 'train'").withColumns({"video_path": F.concat(F.lit(video_dir.rstrip("/") + "/"), F.col("video_id")), "tier": F.coalesce("tier", F.lit("B")), "source": F.lit("challenge")})
    b = external.withColumns({"question": F.lit("") if "question" not in external.columns else F.col("question"), "tier": F.lit("A"), "source": F.lit("external")})
    return a.select(*cols, F.lit(0).alias("src_ord")).unionByName(b.select(*cols, F.lit(1).alias("src_ord")))


def write_merged(train: DataFrame, external: DataFrame | None, video_dir: str, path: str, tasks: list[str]) -> dict[str, dict[str | None, int]]:
    """The merged corpus as JSON lines below path, and its counts by source and by task, taken while it is written. tasks
    are those expected; others are counted too. Without external records the challenge's stand alone. Records of the two
    sources stay apart in files, the challenge's first; nothing is sorted for it."""
    from corvane.sources.writers import counted_jsonl

    none = "video_path string, task string, answer string, reasoning string"
    both = merge(train, train.sparkSession.createDataFrame([], none) if external is None else external, video_dir)
    return counted_jsonl(both.drop("src_ord"), path, {"source": ["challenge", "external"], "task": tasks})
