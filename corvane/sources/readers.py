"""Scans. Paths go to Spark's readers, so any store works; existence is asked of Spark's file system."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

ITEM = "video_id string, question string, answer string, reasoning string"


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def task_file(spark: SparkSession, path: str, task: str, task_ord: int = 0) -> DataFrame:
    """One task's items, from {metadata, items} or a bare list. item_ord is the place in the file. A different task
    name inside is reported; the given one wins."""
    raw = spark.read.schema(f"metadata struct<task:string>, items array<struct<{ITEM.replace(' string', ':string')}>>, {ITEM}").option("multiLine", True).json(path)
    named = [r[0] for r in raw.filter("items is not null").select("metadata.task").distinct().limit(2).collect() if r[0]]
    if named and named != [task]:
        log.warning("%s says task %s, read as %s", path, named, task)
    listed = raw.filter("items is not null").select(F.posexplode("items").alias("item_ord", "i")).select(F.col("item_ord").cast("long").alias("item_ord"), "i.*")
    bare = raw.filter("items is null").withColumn("item_ord", F.monotonically_increasing_id()).select("item_ord", "video_id", "question", "answer", "reasoning")
    return listed.unionByName(bare).withColumns({"task": F.lit(task), "task_ord": F.lit(task_ord)})


def all_tasks(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Missing files are reported and skipped. ord follows (task, item); items without video_id go."""
    out = spark.createDataFrame([], f"item_ord long, {ITEM}, task string, task_ord int")
    for k, (task, path) in enumerate(paths.items()):
        if exists(spark, path):
            out = out.unionByName(task_file(spark, path, task, k))
        else:
            log.warning("no %s", path)
    return out.filter("video_id is not null").withColumn("ord", F.col("task_ord").cast("long") * (1 << 50) + F.col("item_ord"))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def test_items(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("items array<struct<item_index:string,video_id:string,task_type:string,question:string>>").option("multiLine", True).json(path)
    return raw.select(F.posexplode("items").alias("ord", "i")).select(F.col("i.item_index").alias("item"), F.col("i.video_id").alias("video"), F.col("i.task_type").alias("task"), "i.question", "ord")


def optional(spark: SparkSession, path: str | None, schema: str, tolerant: bool = False, **options) -> DataFrame:
    """An optional pool: absent or not asked for gives no rows; a damaged one fails, or gives none if tolerant."""
    none = spark.createDataFrame([], schema)
    if path is None or not exists(spark, path):
        return none
    df = spark.read.schema(schema).options(multiLine=True, mode="FAILFAST", **options).json(path)
    if not tolerant:
        return df
    try:
        df.foreach(lambda r: None)
        return df
    except Exception as e:
        log.warning("%s not readable: %s", path, str(e)[:200])
        return none


def first_filled(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The first of several places that holds rows."""
    for p in paths:
        df = optional(spark, p, schema, tolerant=True)
        if not df.isEmpty():
            return df
    return spark.createDataFrame([], schema)


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """item_index,prediction; the last of repeated items counts: of several files that of the last name, within a file
    the last row. A file of quoted line breaks isn't split, so its rows are numbered in order."""
    raw = spark.read.schema("item_index string, prediction string").options(header=True, multiLine=True, escape='"').csv(path)
    at = raw.select("*", F.struct(F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i")).alias("k"))
    return at.groupBy(F.col("item_index").alias("item")).agg(F.max_by(F.coalesce("prediction", F.lit("")), "k").alias("prediction"))


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path) of the files below a folder, without their content."""
    return spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=pattern).load(folder).select("path")


def only_existing(rows: DataFrame, listing: DataFrame, path: Column) -> DataFrame:
    return rows.withColumn("_p", path).join(listing.select(F.col("path").alias("_p")).distinct(), "_p", "left_semi").drop("_p")


def detections(spark: SparkSession, folder: str) -> DataFrame:
    """(video, idx, boxes) from one JSON per video; box: class, x1, y1, x2, y2, confidence."""
    raw = spark.read.schema("video_id string, n int, frames array<struct<idx:int,boxes:array<array<double>>>>").option("multiLine", True).json(folder)
    box = lambda b: F.struct(b[0].cast("int").alias("cls"), b[1].alias("x1"), b[2].alias("y1"), b[3].alias("x2"), b[4].alias("y2"), b[5].alias("conf"))
    return raw.select(F.col("video_id").alias("video"), F.explode("frames").alias("f")).select("video", "f.idx", F.transform("f.boxes", box).alias("boxes"))


def external(rows: DataFrame, listing: DataFrame, fps: DataFrame | None = None) -> DataFrame:
    """External records (path, think, answer, start, end) to items: a localization item where both frame numbers are
    given, and always a description. fps (path, fps) defaults to 30."""
    from corvane.functions.clock import minutes_seconds
    from corvane.functions.text import unwrap_external

    r = only_existing(rows, listing, F.col("path"))
    r = r.join(fps, "path", "left") if fps is not None else r.withColumn("fps", F.lit(None).cast("double"))
    rate = F.coalesce("fps", F.lit(30.0))
    u = unwrap_external(F.col("think"), F.col("answer"))
    window = F.to_json(F.struct(minutes_seconds(F.col("start") / rate).alias("start"), minutes_seconds(F.col("end") / rate).alias("end")))
    item = lambda task, a: F.struct(F.lit(task).alias("task"), a.alias("answer"))
    both = F.array(F.when(F.col("start").isNotNull() & F.col("end").isNotNull(), item("temporal_localization", window)), item("anomaly_description", u["answer"]))
    return r.select(F.col("path").alias("video_path"), u["reasoning"].alias("reasoning"), F.explode(F.array_compact(both)).alias("i")).select("video_path", "i.task", "i.answer", "reasoning")


def resolved(video: Column, base: str, remaps: dict[str, str]) -> Column:
    """Where a video lies: under base, or a prefix is mapped and the suffix becomes .avi. Candidates in order."""
    out = [F.concat(F.lit(base.rstrip("/") + "/"), video)]
    for old, new in remaps.items():
        rest = F.regexp_replace(F.substring(video, len(old) + 1, 1 << 30), r"\.[^./]*$", ".avi")
        out.append(F.when(F.startswith(video, F.lit(old)), F.concat(F.lit(new), rest)))
    return F.array_compact(F.array(*out))


def under_root(path: Column, root: str) -> Column:
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def distinct_videos(parts: list[DataFrame]) -> DataFrame:
    """(video, base) over several tables; the first table's base wins; sorted."""
    out = None
    for k, p in enumerate(parts):
        p = p.select("video", "base", F.lit(k).alias("k"))
        out = p if out is None else out.unionByName(p)
    return out.groupBy("video").agg(F.min_by("base", "k").alias("base")).orderBy("video")


def training_records(corpus: DataFrame, tasks, weights: dict[str, int] | None, tiers=None, listing: DataFrame | None = None, seed: int = 0, limit: int | None = None) -> DataFrame:
    """Filter, replicate by tier, shuffle by seed, limit."""
    from corvane.operators.tiers import replicate

    r = corpus.filter(F.col("task").isin(*tasks))
    r = r.filter(F.col("tier").isin(*tiers)) if tiers else r
    r = only_existing(r, listing, F.col("video_path")) if listing is not None else r
    r = (replicate(r, weights) if weights else r).orderBy(F.rand(seed))
    return r.limit(limit) if limit else r


def shard(rows: DataFrame, order: str, k: int, n: int) -> DataFrame:
    """Every n-th row from k on, of the rows in order. Numbers come from per-partition counts, not from one sort in a task."""
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), order).sortWithinPartitions(order).withColumn("_i", F.monotonically_increasing_id())
    part = F.shiftright("_i", 33)
    counts = sorted((r.p, r.c) for r in ranged.groupBy(part.alias("p")).agg(F.count("*").alias("c")).collect())
    before, starts = 0, []
    for p, c in counts:
        starts.append((p, before))
        before += c
    at = spark.createDataFrame(starts, "p long, before long")
    got = ranged.withColumn("p", part).join(F.broadcast(at), "p")
    return got.filter((F.col("before") + F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))) % n == k).drop("_i", "p", "before")


def first_seen(items: DataFrame, key: str = "video", order: str = "ord") -> DataFrame:
    """Distinct keys with the position (ord) at which each comes first: sorting by it gives the order of first sight."""
    return items.groupBy(key).agg(F.min(order).alias("ord"))
