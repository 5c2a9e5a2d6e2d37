"""Candidate pools in one long table: source, src_ord, item, kind, pos, value, task, err."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

POOL = "source string, src_ord int, item string, kind string, pos int, value string, task string, err string"
KINDS = ("votes", "picks", "samples")


def from_nested(df: DataFrame, source: str, src_ord: int) -> DataFrame:
    """Rows (item, task, votes, picks, samples, greedy, err) to the long form; greedy has position -1."""

    def cells_of(kind: str) -> Column:
        return F.transform(F.col(kind), lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), x.alias("value")))

    parts = [cells_of(kind) for kind in KINDS if kind in df.columns]
    if "greedy" in df.columns:
        parts.append(F.array(F.struct(F.lit("samples").alias("kind"), F.lit(-1).alias("pos"), F.col("greedy").alias("value"))))
    cells = F.concat(*(F.coalesce(p, F.array().cast("array<struct<kind:string,pos:int,value:string>>")) for p in parts))
    opt = lambda c: (F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c)
    long = df.select(F.col("item").cast("string"), opt("task"), opt("err"), F.explode_outer(cells).alias("x"))
    return long.select(F.lit(source).alias("source"), F.lit(src_ord).alias("src_ord"), "item", "x.kind", "x.pos", "x.value", "task", "err")


def from_prefixed(df: DataFrame, source: str, src_ord: int) -> DataFrame:
    """Rows (key, values): moe_<item> holds picks, boe_<item> samples."""
    kind = F.when(F.startswith("key", F.lit("moe_")), "picks").when(F.startswith("key", F.lit("boe_")), "samples")
    long = df.select(F.substring("key", 5, 1 << 30).alias("item"), kind.alias("kind"), F.posexplode_outer("values").alias("pos", "value"))
    return long.select(F.lit(source).alias("source"), F.lit(src_ord).alias("src_ord"), "item", "kind", "pos", "value", F.lit(None).cast("string").alias("task"), F.lit(None).cast("string").alias("err"))


def ordered(parts: list[DataFrame], item: str = "item") -> DataFrame:
    """Bag union of (item, pos, value) in the order given, with one position over all."""
    out = None
    for k, p in enumerate(parts):
        p = p.select(item, F.lit(k).alias("src"), "pos", "value")
        out = p if out is None else out.unionByName(p)
    return out.withColumn("at", F.col("src").cast("long") * (1 << 31) + F.col("pos")).select(item, F.col("at").alias("pos"), "value")


def capped(pool: DataFrame, n: int, item: str = "item") -> DataFrame:
    return pool.withColumn("k", F.row_number().over(W.partitionBy(item).orderBy("pos"))).filter(F.col("k") <= n).drop("k")


def valid(pool: DataFrame, options: DataFrame) -> DataFrame:
    """Votes whose value is among the item's options (item, opts); repeats stay."""
    return pool.join(options, "item").filter(F.array_contains("opts", F.col("value"))).drop("opts")


def resume(work: DataFrame, done: DataFrame, retry_errors: bool = False, item: str = "item") -> DataFrame:
    """Work not finished yet. Errors count as finished unless retry_errors."""
    fin = done.filter(F.col("err").isNull()) if retry_errors and "err" in done.columns else done
    return work.join(fin.select(item).distinct(), item, "left_anti")


def upsert(old: DataFrame, new: DataFrame, item: str = "item") -> DataFrame:
    return old.join(new.select(item).distinct(), item, "left_anti").unionByName(new, allowMissingColumns=True)


def last_wins(rows: DataFrame, key: str, order: Column) -> DataFrame:
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("x")).select(key, "x.*")


def top_in_order(rows: DataFrame, key: str, score: str, pos: str, n: int) -> DataFrame:
    """Of each key its n best-scored rows, the earlier of equals, numbered again by position (k from 1)."""
    best = rows.withColumn("k", F.row_number().over(W.partitionBy(key).orderBy(F.desc(score), pos))).filter(F.col("k") <= n)
    return best.withColumn("k", F.row_number().over(W.partitionBy(key).orderBy(pos)))


def with_previous(rows: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """Each row with its predecessor's value (previous), null at the first."""
    return rows.withColumn("previous", F.lag(value).over(W.partitionBy(key).orderBy(pos)))
