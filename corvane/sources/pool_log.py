"""Durable pools: a folder of numbered batches, where the last write of a key wins.

A batch is a folder batch=<number> that counts once Spark has put its _SUCCESS file there, so a killed run leaves either a
whole batch or one that readers pass over and the next writer replaces. base=<number> is the same for a compacted state:
it stands for all batches up to its number. One writer at a time; any number of readers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.pools import last_wins, resume

SEQ = "batch_"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _whole(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """(number of the newest whole base or -1, numbers of whole batches above it). One listing of the folder's entries."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return -1, []
    found: dict[str, list[int]] = {"base": [], "batch": []}
    for st in fs.listStatus(p):
        kind, _, n = st.getPath().getName().partition("=")
        if kind in found and n.isdigit() and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            found[kind].append(int(n))
    base = max(found["base"], default=-1)
    return base, sorted(n for n in found["batch"] if n > base)


def append(rows: DataFrame, path: str) -> int:
    """Writes rows as the next batch and returns its number. An unfinished batch of that number is replaced."""
    base, batches = _whole(rows.sparkSession, path)
    n = max([base, *batches]) + 1
    rows.write.mode("overwrite").parquet(f"{path}/batch={n}")
    return n


def log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of whole batches, with their batch's number; none if there is nothing."""
    base, batches = _whole(spark, path)
    parts = ([(base, f"{path}/base={base}")] if base >= 0 else []) + [(n, f"{path}/batch={n}") for n in batches]
    if not parts:
        return spark.createDataFrame([], schema).withColumn(SEQ, F.lit(0).cast("long"))
    rows = spark.read.schema(schema).parquet(*(p for _, p in parts))
    number = F.regexp_extract(F.col("_metadata.file_path"), r"/(?:base|batch)=(\d+)/[^/]*$", 1).cast("long")
    return rows.withColumn(SEQ, number)


def current(spark: SparkSession, path: str, schema: str, key: str = "item") -> DataFrame:
    """One row a key: that of its last batch. Rows of one key within a batch must be one; of several, any stays."""
    rows = log(spark, path, schema)
    return last_wins(rows, key, F.col(SEQ)).drop(SEQ)


def compact(spark: SparkSession, path: str, schema: str, key: str = "item") -> None:
    """Writes the current state as a base and then deletes what it stands for. Killed before the base is whole, nothing
    has changed; killed after, the leftovers are passed over and go with the next compaction."""
    base, batches = _whole(spark, path)
    if not batches:
        return
    current(spark, path, schema, key).write.mode("overwrite").parquet(f"{path}/base={batches[-1]}")
    fs, p = _fs(spark, path)
    for st in fs.listStatus(p):
        kind, _, n = st.getPath().getName().partition("=")
        if n.isdigit() and ((kind == "batch" and int(n) <= batches[-1]) or (kind == "base" and int(n) < batches[-1])):
            fs.delete(st.getPath(), True)


def fill(work: DataFrame, path: str, schema: str, make: Callable[[DataFrame], DataFrame], slices: int = 20, retry_errors: bool = False, key: str = "item") -> int:
    """Makes the rows of all work that the log doesn't hold, a slice of the keys at a time (by a hash, so the same in every
    run); each slice is one batch. Killed at any point, a further run makes only what isn't in a whole batch. work must
    give the same rows when read again. Returns how many batches were written."""
    spark = work.sparkSession
    written = 0
    for k in range(slices):
        part = resume(work.filter(F.pmod(F.xxhash64(key), F.lit(slices)) == k), current(spark, path, schema, key), retry_errors, key)
        if not part.isEmpty():
            append(make(part), path)
            written += 1
    return written
