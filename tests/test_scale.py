"""Operators that spread what one task held before: ranks, nearest keys, medoids, best matches, the vote on a stream."""

import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F


def percentile(values, share):
    s = sorted(values)
    k = share * (len(s) - 1)
    lo = int(k)
    return s[lo] * (1 - (k - lo)) + s[min(lo + 1, len(s) - 1)] * (k - lo)


@pytest.mark.parametrize("n", [0, 1, 2, 7, 500])
def test_quantiles(spark, n):
    from corvane.operators.ranks import at_ranks, quantiles

    r = random.Random(n)
    values = [r.choice((1.0, 1.0, 2.5, r.random() * 9)) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double").repartition(5)
    shares = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    assert quantiles(df, "v", shares) == ([percentile(values, s) for s in shares] if n else [None] * 6)
    got = at_ranks(df, ["v"], [0, n // 2, n, n + 5])
    assert got == {k: Row(v=sorted(values)[k]) for k in {0, n // 2} if k < n}


def test_split_is_told_by_the_last_rank(spark):
    import hashlib

    from corvane.operators.split import by_hash

    keys = [f"v{k}" for k in range(130)]
    df = spark.createDataFrame([(k, i) for k in [*keys, None] for i in range(3)], "video string, i int").repartition(4)
    val = set(sorted(keys, key=lambda k: (hashlib.md5(f"42:{k}".encode()).hexdigest(), k))[:6])
    got = by_hash(df, "video").collect()
    assert len(got) == 393 and all((r["split"] == "val") == (r["video"] in val) for r in got)
    assert by_hash(df.limit(0), "video").collect() == []


@pytest.mark.parametrize("width", [1, 10, 1 << 16])
def test_nearest_keys(spark, width):
    from corvane.operators.asof import nearest_keys

    r = random.Random(width)
    keys = [(u, r.randrange(-60, 60)) for u in "abc" for _ in range(9)] + [("a", 7), ("a", 7), (None, 3), ("b", None)]
    rows = [(k, r.choice("abcd"), r.randrange(-90, 90)) for k in range(300)] + [(999, None, 4)]
    got = {x["id"]: x["near"] for x in nearest_keys(spark.createDataFrame(rows, "id int, u string, x long"), spark.createDataFrame(keys, "u string, x long"), "u", "x", width).collect()}
    want = {}
    for k, u, x in rows:
        some = [v for w, v in keys if w == u and u is not None and v is not None]
        if some:
            want[k] = min(some, key=lambda v: (abs(v - x), v))
    assert got == want


def test_nearest_keys_looks_at_no_block_twice(spark):
    """What lies beyond a block comes from groups of blocks; no window shrinks to the end, which is quadratic in a hot group's blocks."""
    from corvane.operators.asof import _beyond, nearest_keys

    r = random.Random(3)
    blocks = {(u, b): r.choice((None, (10 * b, 10 * b + 7))) for u in "ab" for b in r.sample(range(-40, 40), 30)}
    rows = [(u, b, *(x or (None, None))) for (u, b), x in blocks.items()]
    got = {(x["u"], x["b_"]): (x["before_"], x["after_"]) for x in _beyond(spark.createDataFrame(rows, "u string, b_ long, lo_ long, hi_ long"), "u", 2, fan=4).collect()}
    for u, b in blocks:
        has = [(c, x) for (w, c), x in blocks.items() if w == u and x]
        assert got[u, b] == (max((x[1] for c, x in has if c < b), default=None), min((x[0] for c, x in has if c > b), default=None))
    e = spark.range(100).select((F.col("id") % 2).alias("u"), "id")
    plan = nearest_keys(e, e.filter("id % 9 = 0"), "u", "id", 4)._jdf.queryExecution().toString().lower()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan


def test_medoid_of_many_candidates_equals_arrays(spark):
    """Candidates of thousands of votes are solved by pairs of distinct values, to the same choice."""
    from corvane.operators.medoid import medoid

    r = random.Random(4)
    words = "red green blue car truck man runs falls".split()
    rows = [(i, p, " ".join(r.sample(words, r.randrange(1, 5)))) for i in range(6) for p in range(r.choice((3, 40, 90)))] + [(7, 0, ""), (8, 0, None), (9, 0, "one")]
    df = spark.createDataFrame(rows, "item int, pos long, value string").repartition(3)

    def best(i):
        c = [(p, set(v.split())) for k, p, v in rows if k == i and v]
        u = [sum(2 * len(a & b) / (len(a) + len(b)) for q, b in c if q != p) for p, a in c]
        return max(u), {rows_[2] for rows_, x in zip([x for x in rows if x[0] == i and x[2]], u) if x > max(u) - 1e-9}

    for many in (4096, 30, 1):
        got = {x["item"]: x["value"] for x in medoid(df, distinct=False, many=many).collect()}
        assert set(got) == {*range(6), 9} and all(got[i] in best(i)[1] for i in got)
    assert {x["item"] for x in medoid(df).collect()} == {*range(6), 9}


def test_medoid_vectors(spark):
    from corvane.operators.medoid import medoid_vectors

    r = random.Random(6)
    rows = [(k, [r.gauss(0, 1) for _ in range(5)], k % 3) for k in range(60)]
    odd = [(100, None, 0), (101, [0.0] * 5, 1), (102, [float("nan")] * 5, 2), (103, [1.0] * 5, None), (104, [1.0, None, 0.0, 0.0, 0.0], 0), (105, [2.0] * 5, 9)]
    got = {x["label"]: (x["id"], x["n"], round(x["mean_similarity"], 9)) for x in medoid_vectors(spark.createDataFrame(rows + odd, "id long, v array<double>, label int").repartition(4), "label", "id", "v").collect()}

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5

    want = {9: (105, 1, 0.0)}
    for g in range(3):
        own = [x for x in rows if x[2] == g]
        u = [(sum(cos(a[1], b[1]) for b in own if b[0] != a[0]), -a[0]) for a in own]
        want[g] = (-max(u)[1], len(own), round(max(u)[0] / (len(own) - 1), 9))
    assert got == want


@pytest.mark.parametrize("small", [1_000_000, 0])
def test_best_match(spark, small):
    from corvane.operators.best_match import best_match

    r = random.Random(8)
    words = [f"w{k}" for k in range(60)]
    some = lambda n: " ".join(r.choice(words[: r.choice((5, 60))]) for _ in range(n))
    texts = [(k, some(r.choice((1, 4, 30)))) for k in range(300)] + [(900, None), (901, ""), (902, "unknown here"), (903, "W1, w2!")]
    entries = [(k, some(r.choice((1, 3, 12)))) for k in range(40)] + [(90, None), (91, ""), (92, "w1 w2"), (93, "w2 w1")]
    got = {x["k"]: (x["e"], x["jaccard"]) for x in best_match(spark.createDataFrame(texts, "k long, text string").repartition(3), spark.createDataFrame(entries, "e long, text string"), "k", "e", small=small).collect()}
    token = lambda s: set("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789 " else " " for c in (s or "").lower()).split())
    for k, text in texts:
        x = token(text)
        j = max(((len(x & token(y)) / max(1, len(x | token(y))), -e) for e, y in entries), default=(0, 0))
        assert got[k] == ((-j[1], j[0]) if j[0] > 0 else (None, 0.0)), k


def test_best_match_tells_pairs_apart_where_their_text_is(spark):
    """No exchange of pairs, whose hash tables would grow with the input, and more tasks for more texts."""
    import re

    from corvane.operators.best_match import _tasks, best_match

    texts = spark.range(50).select(F.col("id").alias("k"), F.concat(F.lit("all w"), F.col("id") % 7).alias("text"))
    entries = spark.range(9).select(F.col("id").alias("e"), F.concat(F.lit("all w"), "id").alias("text"))
    out = best_match(texts, entries, "k", "e")
    assert not re.search(r"hashpartitioning\(k#\d+L?, e#", out._jdf.queryExecution().executedPlan().toString())
    assert {r["k"]: r["e"] for r in out.collect()} == {k: k % 7 for k in range(50)}
    assert _tasks(10, 200, 8) == 8 and _tasks(3_000_000, 200, 8) == 300 and _tasks(3_000_000, 10**7, 8) == 3000 and _tasks(0, 0, 8) == 8


def test_vote_on_a_stream_with_late_rows_and_a_restart(spark, tmp_path):
    """Each window's winner comes once, when the watermark has passed it; rows behind it are dropped; a restarted query
    goes on where it stopped; the winners are those of a batch over the rows that were in time."""
    from corvane.streaming.votes import windowed_counts, winners, winners_stream

    schema = "ts timestamp, user long, kind string, id long"

    def put(k, rows):
        with open(f"{tmp_path}/in/{k}.json", "w") as f:
            f.writelines(json.dumps({"ts": f"2024-01-01 {h:02d}:{m:02d}:00", "user": u, "kind": v, "id": i}) + "\n" for h, m, u, v, i in rows)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
        q = winners_stream(windowed_counts(stream, "user", "kind", "ts", "id")).writeStream.format("parquet").outputMode("append")
        q.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination(180)
        return spark.read.parquet(f"{tmp_path}/out").selectExpr("hour(window.start) AS h", "item", "value", "n").collect()

    (tmp_path / "in").mkdir()
    early = [(1, 5, 1, "a", 1), (1, 6, 1, "b", 2), (1, 50, 1, "b", 3), (1, 7, 2, "a", 4), (1, 8, 2, "b", 5), (2, 1, 1, "c", 6)]
    put(1, early)
    put(2, [(1, 59, 2, "b", 7), (2, 30, 2, "d", 8)])
    first = run()
    late = (1, 1, 1, "a", 9)
    put(3, [late, late, late, (3, 40, 1, "z", 10)])
    put(4, [(5, 30, 1, "z", 11)])
    put(5, [(6, 30, 1, "z", 12)])
    both = run()
    got = sorted(tuple(x) for x in both)
    assert len(first) <= len(both) and len({x[:2] for x in got}) == len(got)
    on_time = [*early, (1, 59, 2, "b", 7), (2, 30, 2, "d", 8), (3, 40, 1, "z", 10)]
    rows = spark.createDataFrame([(f"2024-01-01 {h:02d}:{m:02d}:00", u, v, i) for h, m, u, v, i in on_time], "ts string, user long, kind string, id long").withColumn("ts", F.col("ts").cast("timestamp"))
    batch = winners(windowed_counts(rows, "user", "kind", "ts", "id")).selectExpr("hour(window.start) AS h", "item", "value", "n")
    want = sorted(tuple(x) for x in batch.collect())
    assert [x for x in got if x[0] <= 2] == [x for x in want if x[0] <= 2] and set(got) <= set(want) | {(5, 1, "z", 1)}


def test_predictions_over_files(spark, tmp_path):
    """The last row of the last file counts."""
    from corvane.sources.readers import predictions

    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.csv").write_text('item_index,prediction\n1,"one\nline"\n2,x\n1,again\n3,only\n')
    (tmp_path / "p/b.csv").write_text("item_index,prediction\n2,y\n4,\n")
    got = {r["item"]: r["prediction"] for r in predictions(spark, f"{tmp_path}/p").collect()}
    assert got == {"1": "again", "2": "y", "3": "only", "4": ""}
