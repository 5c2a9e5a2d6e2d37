"""The keyframe stage as tables: which frames each record takes, which are on disk already, which are still to be decoded.

The folder of frames is listed, never opened, but for the small files that keep the indices of whole sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import clock as C
from corvane.functions import frames as N
from corvane.functions import text as T
from corvane.operators.tiers import replicate
from corvane.sources.writers import conversations


def _slug(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def saved_indices(spark: SparkSession, folder: str) -> DataFrame:
    """(slug, idx, fps) from the indices.json of each set below folder."""
    raw = spark.read.schema("indices array<bigint>, fps double").options(recursiveFileLookup=True, pathGlobFilter="indices.json", multiLine=True).json(folder)
    return raw.select(_slug(F.col("_metadata.file_path")).alias("slug"), F.col("indices").alias("idx"), "fps")


def frame_files(listing: DataFrame) -> DataFrame:
    """(folder, odd, bits) of the images in a listing (path): a row a folder for those named as stage() names them, up to
    number 63, whose bits say which are there, and a row for each other name (odd). Paths are combined before they
    are shuffled, so a folder's many names move as one number."""
    name = F.substring_index("path", "/", -1)
    number = F.substring(name, 7, 5).try_cast("int")
    plain = number.between(0, 63) & (name == _frame(number))
    images = listing.filter(F.regexp_like("path", F.lit(r"/frame_[^/]*\.jpg$"))).select(_parent(F.col("path")).alias("folder"), name.alias("name"), F.when(plain, number).alias("number"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("number"))
    return images.groupBy("folder", F.when(F.col("number").isNull(), F.col("name")).alias("odd")).agg(F.bit_or(bit).alias("bits"))


def _parent(path: Column) -> Column:
    return F.substr(path, F.lit(1), F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1)


def _frame(number: Column) -> Column:
    return F.concat(F.lit("frame_"), F.lpad(number.cast("string"), 5, "0"), F.lit(".jpg"))


def _is_there(bits: Column, number: Column) -> Column:
    return F.call_function("shiftright", bits, number.cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1


def _paths(held: Column) -> Column:
    """The paths of frame files (array<struct<folder, odd, bits>>), in order."""

    def of(x: Column) -> Column:
        numbers = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: _is_there(x["bits"], i))
        return F.when(x["odd"].isNotNull(), F.array(F.concat(x["folder"], F.lit("/"), x["odd"]))).otherwise(F.transform(numbers, lambda i: F.concat(x["folder"], F.lit("/"), _frame(i))))

    return F.sort_array(F.flatten(F.transform(held, of)))


def whole_sets(listing: DataFrame, saved: DataFrame) -> DataFrame:
    """(slug, idx, fps, held) of the sets that needn't be made again: exactly N_FRAMES images and saved indices. listing
    (path) may hold any files; held are a set's frame_files. Counts come first, so only whole sets are gathered."""
    files = frame_files(listing).withColumn("slug", F.substring_index("folder", "/", -1))
    size = F.when(F.col("odd").isNull(), F.bit_count("bits")).otherwise(1)
    full = files.withColumn("n", F.sum(size).over(W.partitionBy("slug"))).filter(F.col("n") == N.N_FRAMES)
    named = full.groupBy("slug").agg(F.collect_list(F.struct("folder", "odd", "bits")).alias("held"))
    return named.join(saved.dropDuplicates(["slug"]), "slug").select("slug", "idx", "fps", "held")


def planned(records: DataFrame, videos: DataFrame, sets: DataFrame) -> DataFrame:
    """stage() without the names of images, which named() adds: held instead, null for a set that isn't whole. A table of
    these rows is a small part of one with the names."""
    q, a = T.text(F.col("question")), T.text(F.col("answer"))
    rows = records.withColumn("slug", T.slug(F.col("video_id"), q)).join(videos.select("video_id", F.col("total").cast("long").alias("total_"), F.col("fps").cast("double").alias("rate_")), "video_id")
    have = sets.select("slug", F.col("idx").alias("idx_"), F.col("fps").alias("fps_"), "held")
    rows = rows.join(have, "slug", "left").withColumn("cached", F.col("held").isNotNull())
    rows = rows.filter("cached or total_ > 0").withColumn("rate_", F.when(F.col("rate_") > 0, F.col("rate_")).otherwise(30.0))
    plan = N.filled(N.plan(F.col("task"), C.clock_pairs(q), C.answer_window(a), F.col("total_"), F.col("rate_")), F.col("total_"))
    rows = rows.withColumn("idx", F.when(F.col("cached"), F.col("idx_")).otherwise(plan)).withColumn("fps", F.when(F.col("cached"), F.col("fps_")).otherwise(F.col("rate_")))
    return rows.drop("idx_", "fps_", "total_", "rate_")


def named(rows: DataFrame, folder: str) -> DataFrame:
    """planned() rows with images: those of a whole set, or the names that its frames will have."""
    own = F.concat(F.lit(folder.rstrip("/") + "/"), F.col("slug"), F.lit("/"))
    names = F.transform(F.sequence(F.lit(0), F.size("idx") - 1), lambda i: F.concat(own, _frame(i)))
    images = F.when(F.col("cached"), _paths(F.col("held"))).when(F.size("idx") > 0, names).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("images", images).drop("held")


def stage(records: DataFrame, videos: DataFrame, sets: DataFrame, folder: str) -> DataFrame:
    """records (video_id, task, question, answer, ...) with slug, idx, fps, images and cached. videos (video_id, total, fps)
    holds the videos that exist, once each; records of others go, and those of a video without frames unless their set is
    whole. Null texts are ''. A rate that is null or 0 counts as 30."""
    return named(planned(records, videos, sets), folder)


def missing_frames(staged: DataFrame, listing: DataFrame) -> DataFrame:
    """(path, video_id, idx) still to be decoded: frames of staged sets that aren't whole, without those whose file is there.
    If several records name one file, the least index counts.

    Records meet the listing by folder, and only what is missing becomes rows; paths meet only where records share
    a folder."""
    rows = staged.filter(~F.col("cached") & (F.size("idx") > 0)).select("video_id", "idx", _parent(F.get("images", F.lit(0))).alias("folder"))
    there = frame_files(listing).filter("odd is null").select("folder", "bits")
    known = rows.groupBy("folder").agg(F.count("*").alias("n")).join(there, "folder", "left").withColumn("bits", F.coalesce("bits", F.lit(0).cast("long")))
    every = F.transform("idx", lambda x, k: F.struct(k.alias("number"), x.alias("idx")))
    absent = F.filter(every, lambda x: ~_is_there(F.col("bits"), x["number"]))
    one = rows.join(known, "folder").select("folder", "n", "video_id", F.explode(absent).alias("x")).select("folder", "n", "video_id", "x.*")
    shared = one.filter("n > 1").groupBy("folder", "number").agg(F.min(F.struct("idx", "video_id")).alias("x")).select("folder", "number", "x.video_id", "x.idx")
    out = one.filter("n = 1").select("folder", "number", "video_id", "idx").unionByName(shared)
    return out.select(F.concat("folder", F.lit("/"), _frame(F.col("number"))).alias("path"), "video_id", "idx")


def training_turns(staged: DataFrame, by_tier: bool) -> DataFrame:
    """Conversation records of the staged rows, each as often as its tier weighs (training split) or once. A null tier is B."""
    rows = staged.withColumn("tier", F.coalesce("tier", F.lit("B")))
    out = conversations(rows)
    return replicate(out, N.REPEATS).drop("copy") if by_tier else out
