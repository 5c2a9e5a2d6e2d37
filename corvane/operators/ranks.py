"""Rows at given ranks of an order, without a task that holds them all."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder's name below spark.checkpoint.dir. On a local master without that setting it lies in a temporary folder;
    elsewhere that is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not d and not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="corvane-tables-"))
    return f"{(d or _LOCAL[0]).rstrip('/')}/corvane-tables/{uuid.uuid4().hex}"


def checkpointed(rows: DataFrame) -> DataFrame:
    """rows computed once and written as a table in a shared folder, for plans that look at them several times."""
    spark = rows.sparkSession
    path = shared_folder(spark)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def at_ranks(rows: DataFrame, by: list[str], ranks: list[int], parts: int | None = None) -> dict[int, Row]:
    """{rank: row of the `by` columns} for ranks from 0 of the rows in ascending order, nulls left out; ranks beyond the
    rows are absent. Equal rows are counted together first. One range partitioning counts the rows of each part; only
    the parts that hold a wanted rank are looked at again, by their values: 1/parts of the distinct rows each.
    The driver gets one row a part and one a rank."""
    spark = rows.sparkSession
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    key = F.struct(*(F.col(c) for c in by))
    counts = rows.select(*by).na.drop().groupBy(*by).agg(F.count("*").alias("n_"))
    ranged = counts.repartitionByRange(parts, *by).groupBy(F.spark_partition_id().alias("p_"))
    held, before = [], 0
    for p in ranged.agg(F.sum("n_").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).orderBy("lo").collect():
        if any(before <= r < before + p["n"] for r in ranks):
            held.append((before, p["lo"], p["hi"]))
        before += p["n"]
    out: dict[int, Row] = {}
    types = {f.name: f.dataType for f in rows.select(*by).schema}
    for start, lo, hi in held:
        ends = [F.struct(*(F.lit(x[c]).cast(types[c]).alias(c) for c in by)) for x in (lo, hi)]
        last = F.sum("n_").over(W.orderBy(*by)) + start
        some = counts.filter((key >= ends[0]) & (key <= ends[1])).withColumn("last_", last)
        wanted = F.lit(False)
        for r in ranks:
            wanted = wanted | ((F.col("last_") > r) & (F.col("last_") - F.col("n_") <= r))
        for x in some.filter(wanted).collect():
            out |= {r: Row(**{c: x[c] for c in by}) for r in ranks if x["last_"] - x["n_"] <= r < x["last_"]}
    return out


def quantiles(rows: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles, interpolated between neighbours; nulls left out, None without rows."""
    known = rows.select(column).filter(F.col(column).isNotNull())
    n = known.count()
    if not n:
        return [None] * len(shares)
    places = [s * (n - 1) for s in shares]
    got = at_ranks(known, [column], sorted({r for p in places for r in (int(p), min(int(p) + 1, n - 1))}))
    value = {r: float(x[column]) for r, x in got.items()}
    return [value[int(p)] * (1 - (p - int(p))) + value[min(int(p) + 1, n - 1)] * (p - int(p)) for p in places]
