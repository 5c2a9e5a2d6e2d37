"""Pools that survive killed runs, and counts taken while a corpus is written."""

import os

import pytest
from pyspark.sql import functions as F

SCHEMA = "item string, value string, err string"


def test_last_batch_wins_and_compaction(spark, tmp_path):
    from corvane.sources import pool_log as L

    p = f"{tmp_path}/pool"
    df = lambda *rows: spark.createDataFrame(rows, SCHEMA)
    state = lambda: {r["item"]: r["value"] for r in L.current(spark, p, SCHEMA).collect()}
    assert state() == {}
    assert [L.append(df(("a", "1", None), ("b", "1", None)), p), L.append(df(("b", "2", None)), p)] == [0, 1]
    df(("a", "half", None)).write.parquet(f"{p}/batch=2")  # a batch whose job was killed
    os.remove(f"{p}/batch=2/_SUCCESS")
    assert state() == {"a": "1", "b": "2"}
    assert L.append(df(("c", "3", None)), p) == 2
    L.compact(spark, p, SCHEMA)
    assert state() == {"a": "1", "b": "2", "c": "3"} and [d for d in sorted(os.listdir(p))] == ["base=2"]
    assert L.append(df(("a", None, "x")), p) == 3 and state() == {"a": None, "b": "2", "c": "3"}
    df(("a", "late", None)).write.parquet(f"{p}/base=3")  # a compaction that was killed
    os.remove(f"{p}/base=3/_SUCCESS")
    assert state()["a"] is None
    L.compact(spark, p, SCHEMA)
    assert state() == {"a": None, "b": "2", "c": "3"} and os.listdir(p) == ["base=3"]


def test_a_killed_run_goes_on(spark, tmp_path):
    from corvane.sources import pool_log as L

    p, made = f"{tmp_path}/pool", []
    work = spark.range(100).select(F.col("id").cast("string").alias("item"))

    def make(part):
        made.append({r["item"] for r in part.collect()})
        if len(made) == 3:
            raise KeyboardInterrupt
        return part.withColumns({"value": F.col("item"), "err": F.when(F.col("item") == "7", "no")})

    with pytest.raises(KeyboardInterrupt):
        L.fill(work, p, SCHEMA, make, slices=5)
    assert L.fill(work, p, SCHEMA, make, slices=5) == 3
    whole = made[:2] + made[3:]
    assert sum(map(len, whole)) == 100 and len(set().union(*whole)) == 100
    assert L.current(spark, p, SCHEMA).count() == 100
    assert L.fill(work, p, SCHEMA, make, slices=5) == 0
    assert L.fill(work, p, SCHEMA, make, slices=5, retry_errors=True) == 1 and made[-1] == {"7"}


def test_counts_of_the_write_pass(spark, tmp_path):
    from corvane.sources.writers import counted_jsonl

    rows = spark.createDataFrame([("a", "x", None), ("a", "y", "é"), ("b", "x", "z"), ("b", "new", "z"), (None, "x", "z")], "source string, task string, text string").repartition(3)
    got = counted_jsonl(rows, f"{tmp_path}/out", {"source": ["a", "b"], "task": ["x", "y", "none"]})
    assert got == {"source": {"a": 2, "b": 2, None: 1}, "task": {"x": 3, "y": 1, "new": 1}}
    back = spark.read.schema(rows.schema).json(f"{tmp_path}/out")
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
    assert '"text":null' in "".join(r["value"] for r in spark.read.text(f"{tmp_path}/out").collect())
