"""Every query with SQL gives DuckDB's rows at the smallest scale."""

import math

import duckdb
import pytest

from corvane import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return tuple(v) if isinstance(v, list) else v


def rows_of(rows, names):
    at = [names.index(c) for c in sorted(names)]
    return sorted((tuple(cell(r[i]) for i in at) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = rows_of(df.collect(), df.columns)
    assert got
    if name in catalog.oracle_sql():
        want = duck.sql(catalog.oracle_sql()[name])
        assert got == rows_of(want.fetchall(), want.columns)


def test_whole_medoids(spark, tmp_path):
    """Every user has a row, low values or not, and the cap of 48 distinct candidates bites in query and SQL."""
    rows = [(k, 1, "abcde"[k % 5] + "type", float(k % 100)) for k in range(400)] + [(1000, 2, "atype", 3.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("medoid_token", "medoid_nodedup"):
        df, want = catalog.queries()[name](spark, str(tmp_path)), c.sql(catalog.oracle_sql()[name])
        got = rows_of(df.collect(), df.columns)
        assert [r[0] for r in got] == [1, 2] and got == rows_of(want.fetchall(), want.columns)
    pool = catalog.medoid_pool(spark, str(tmp_path))
    assert pool.filter("item = 1").select("value").distinct().count() > 48


def test_whole_vote_pools(spark):
    """Every event's vote is in its user's pool."""
    pools = catalog.queries()["vote_pool_arrays"](spark, SF).collect()
    events = catalog.t(spark, SF, "events")
    assert sum(len(r["pool"]) for r in pools) == events.count() and len(pools) == events.select("user_id").distinct().count()


def test_bench_times_all():
    import json

    import bench

    out = json.loads(bench.line({"a": 1.0, "b": 2.5}, "/x/sf0.1"))
    assert out["value"] == 3.5 and "skipped" not in out and out["sf"] == "0.1"
