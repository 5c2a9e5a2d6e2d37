"""Helpers that the training-data operators share: shared storage, batches, row counts."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.words import mix

_LOCAL: dict[str, str] = {}


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of at most so many rows, unless the session has a size of its own: ten thousand long texts are too
    many at once for a worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def lean_worker() -> None:
    """Give back to the system what this Python worker has free, and what tokenizing tasks left in it: workers outlive
    their tasks, and idle ones count too."""
    bpe = sys.modules.get("corvane.llm.bpe")
    if bpe and bpe.shared_encoder.cache_info().currsize:
        bpe.shared_encoder.cache_clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset
    and Spark runs on one machine (tests), a temporary folder of this process. ValueError elsewhere."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        d = _LOCAL.get("d") or _LOCAL.setdefault("d", "file://" + tempfile.mkdtemp(prefix="corvane-"))
    return d.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/corvane/{name}-{uuid.uuid4().hex[:12]}"


class Tables:
    """Intermediate tables in the shared folder. A written table cuts the lineage as checkpoint() does, but
    stays columnar; a lost executor never makes its rows be computed again. release() deletes those no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}
        small_batches(spark)

    def write(self, df: DataFrame, key: str, **options) -> DataFrame:
        path = new_path(self.spark, f"{self.name}-{key}")
        df.write.options(**options).parquet(path)
        self.paths.setdefault(key, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self, *keys: str) -> None:
        for k in keys:
            for p in self.paths.pop(k, []):
                remove(self.spark, p)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def bit_set(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bit set of 2**bits bits, of fixed size whatever the input, in which the hashes of a column of longs are set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(mix(b.column(0).to_numpy().view(np.uint64)) >> np.uint64(64 - bits))
            word, first = np.unique((at >> np.uint64(6)).astype(np.int32), return_index=True)
            mask = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask.view(np.int64))], names=["w", "m"])

    got = keys.select(column).mapInArrow(run, "w int, m long").groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[got["w"].to_numpy()] = got["m"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def in_set(have: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    """Which of these hashes are set: all that were put in, and some others."""
    bit = h >> np.uint64(64 - bits)
    return (have[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def keep_in_set(rows: DataFrame, column: str, have: np.ndarray, bits: int) -> DataFrame:
    """The rows whose column, of longs, may be in the bit set."""
    shared, at = rows.sparkSession.sparkContext.broadcast(have), rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(in_set(shared.value, bits, mix(b.column(at).to_numpy().view(np.uint64)))))

    return rows.mapInArrow(run, rows.schema)


def keep_in_bits(rows: DataFrame, column: str, wanted: DataFrame, bits: int) -> DataFrame:
    """The rows whose column, of longs, may be among wanted's of that name: a bit set of fixed size, as in keep_in_set, but
    looked up by a broadcast join, so that rows don't pass through Python."""
    spark, h = rows.sparkSession, F.xxhash64(column)
    word, bit = F.shiftrightunsigned(h, 64 - bits + 6).cast("int"), F.shiftrightunsigned(h, 64 - bits).bitwiseAND(F.lit(63)).cast("int")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    got = wanted.select(word.alias("w"), mask.alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    have = np.zeros(1 << (bits - 6), np.int64)
    have[got["w"].to_numpy()] = got["m"].to_numpy()
    sets = spark.createDataFrame(pa.table({"corvane_set": pa.array([have], pa.list_(pa.int64()))}))
    return rows.join(F.broadcast(sets), F.get("corvane_set", word).bitwiseAND(mask) != 0, "left_semi")


def input_bytes(df: DataFrame) -> int:
    """Size of the files behind a frame, by the optimizer's statistics (0 if unknown)."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    except Exception:
        return 0


def slots(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def env_single_thread() -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("OMP_NUM_THREADS", "1")
