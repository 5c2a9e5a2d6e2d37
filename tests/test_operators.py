"""Tie rules, defaults and small plans."""

from pyspark.sql import functions as F

from corvane.operators import medoid as M
from corvane.operators import pairing as J
from corvane.operators import pools as P
from corvane.operators import repair as R
from corvane.operators import split as S
from corvane.operators import tiers as Q
from corvane.operators import vote as V


def votes(spark, values, item="i"):
    return spark.createDataFrame([(item, k, v) for k, v in enumerate(values)], "item string, pos int, value string")


def test_majority_first_seen_wins(spark):
    r = V.majority(votes(spark, ["no", "yes", "yes", "no", "", None])).first()
    assert (r["value"], r["margin_a"], r["margin_b"]) == ("no", 0.0, 0.5)


def test_empty_margins(spark):
    r = V.margins_with_empty(spark.createDataFrame([("z",)], "item string"), votes(spark, ["a"])).first()
    assert (r["margin_a"], r["margin_b"]) == (1.0, 0.0)


def test_interleave(spark):
    out = V.interleaved(votes(spark, ["a", "b", "c"]), votes(spark, ["x", "y"])).orderBy("pos").collect()
    assert [r["value"] for r in out] == ["a", "x", "b", "y", "c"]


def test_medoid_with_and_without_repeats(spark):
    pool = votes(spark, ["b q", "a q", "a q"])
    assert M.medoid(pool).first()["value"] == "b q"
    assert M.medoid(pool, distinct=False).first()["value"] == "a q"
    assert M.medoid(votes(spark, ["only"])).first()["value"] == "only"


def test_pair_repair(spark):
    cols = "group string, item string, ord int, prediction string, margin_a double, verdict string"
    rows = [("a", "1", 0, "Yes", 0.5, None), ("a", "2", 1, "Yes", 0.5, None), ("b", "3", 0, "Yes", 0.1, "yes"), ("b", "4", 1, "Yes", 0.9, "no"), ("c", "5", 0, "No", 0.1, None)]
    rows += [("d", str(k), k, "Yes", 0.1, None) for k in (6, 7, 8)]
    got = {r["item"]: r["prediction"] for r in R.pair_repair(spark.createDataFrame(rows, cols)).collect()}
    assert got == {"1": "No", "2": "Yes", "3": "Yes", "4": "No", "5": "No", "6": "Yes", "7": "Yes", "8": "Yes"}


def test_guard(spark):
    pred = spark.createDataFrame([("1", " "), ("2", None), ("3", "x")], "item string, prediction string")
    got = {r["item"]: r["prediction"] for r in R.guard(pred, spark.createDataFrame([("1", "m"), ("2", "")], "item string, value string")).collect()}
    assert got == {"1": "m", "2": "No", "3": "x"}


def test_replication(spark):
    assert Q.replicate(spark.createDataFrame([("S",), ("A",), ("B",), (None,)], "tier string"), {"S": 3, "A": 2, "B": 1}).count() == 7


def test_split(spark):
    assert S.split_size(3670, 0.05) == 183
    rows = spark.range(100).selectExpr("id % 20 as g", "id")
    for f in (S.by_hash, S.by_shuffle):
        out = f(rows, "g").collect()
        assert len(out) == 100 and len({(r["g"], r["split"]) for r in out}) == 20
        assert len({r["g"] for r in out if r["split"] == "val"}) == 1


def test_siblings_first_match_and_last_back(spark):
    rows = [("x1", "v", "bcq", "Is it? Answer with yes", 0), ("x2", "v", "bcq", "Is it? Provide", 1), ("y1", "v", "bcq_openended", "is it?", 2), ("y2", "v", "bcq_openended", "is it?", 3)]
    items = spark.createDataFrame(rows, "item string, video string, task string, question string, ord int")
    assert {(r[0], r[1]) for r in J.stance_siblings(items).collect()} == {("x1", "y1"), ("x2", "y1"), ("y1", "x2")}


def test_resume_and_upsert(spark):
    work = spark.createDataFrame([("a",), ("b",), ("c",)], "item string")
    done = spark.createDataFrame([("a", None), ("b", "boom")], "item string, err string")
    assert [r[0] for r in P.resume(work, done).collect()] == ["c"]
    assert {r[0] for r in P.resume(work, done, retry_errors=True).collect()} == {"b", "c"}
    assert P.upsert(done, spark.createDataFrame([("b", None)], "item string, err string")).count() == 2


def test_pool_forms(spark):
    nested = spark.createDataFrame([("1", "bcq", ["yes", "no"], "g")], "item string, task string, votes array<string>, greedy string")
    assert {(r["kind"], r["pos"], r["value"]) for r in P.from_nested(nested, "s", 0).collect()} == {("votes", 0, "yes"), ("votes", 1, "no"), ("samples", -1, "g")}
    flat = spark.createDataFrame([("moe_7", ["p"]), ("boe_8", None)], "key string, values array<string>")
    assert {(r["item"], r["kind"], r["value"]) for r in P.from_prefixed(flat, "s", 0).collect()} == {("7", "picks", "p"), ("8", "samples", None)}


def test_assembly(spark):
    from corvane.plans.assemble import choices

    q = "What?\nA. red car\nB. blue\nC. green\nD. none"
    items = spark.createDataFrame([("1", "v", "bcq", "Is it? Answer with", 0), ("2", "v", "bcq_openended", "Is it? Provide", 1), ("3", "v", "mcq", q, 2), ("4", "v", "open_qa", "Why?", 3), ("5", "v", "temporal_localization", "When?", 4)], "item string, video string, task string, question string, ord int")
    pools = spark.createDataFrame(
        [("base", 0, "1", "votes", 0, "no"), ("fast", 0, "2", "samples", 0, "<answer>Yes it is</answer>"), ("fast", 0, "2", "samples", 1, "no"), ("boxed", 0, "1", "votes", 0, "yes"), ("base", 0, "3", "picks", 0, "blue"), ("base", 0, "3", "picks", 1, "elsewhere"), ("fast_desc", 0, "4", "samples", 0, "it fell")],
        "source string, src_ord int, item string, kind string, pos int, value string",
    )
    base = spark.createDataFrame([("5", "0:01")], "item string, prediction string")
    pred, pool = choices(items, pools, J.stance_siblings(items), base)
    got = {r["item"]: r["prediction"] for r in pred.collect()}
    assert got == {"1": "No", "2": "Yes it is", "3": "B", "4": "it fell", "5": "0:01"}
    assert pool.first()["pool"] == ["no", "yes", "yes", "no"]


def test_compliant_assembly_and_switches(spark):
    """Expected by hand: two models' votes, orphans, further orders, draws in turn, evidence after the vote, switches."""
    from corvane.plans.assemble import compliant_answers

    q = "What?\nA. red car\nB. blue\nC. green\nD. none"
    rows = [("1", 1, "bcq", "Is it?", 0), ("2", 1, "bcq_openended", "Is it?", 1), ("3", 1, "bcq", "Was it?", 2), ("4", 1, "mcq", q, 3), ("5", 1, "mcq_openended", q, 4), ("6", 1, "open_qa", "Why?", 5),
            ("7", 1, "temporal_description", "When?", 6), ("8", 2, "scene_description", "What?", 7), ("9", 2, "bcq", "Alone?", 8), ("10", 2, "temporal_localization", "When?", 9)]
    items = spark.createDataFrame(rows, "item string, video long, task string, question string, ord long")
    votes = [("base", "1", "votes", ["no", "no", ""]), ("second", "1", "votes", ["yes"]), ("second", "2", "samples", ["<answer>Yes, a car</answer>", "no car", "no car at all"]), ("second", "3", "votes", ["no"]), ("o_second", "3", "votes", ["no", "yes"]),
             ("base", "4", "picks", ["blue", "blue"]), ("extra_base", "4", "picks", ["elsewhere"]), ("extra", "5", "picks", ["green", "green", "green"]), ("o_second", "9", "votes", ["", "yes"]), ("o_second", "1", "votes", ["yes", "yes", "yes"]),
             ("second_desc", "6", "samples", ["it rained", "it rained"]), ("second_draw", "6", "samples", ["", "the road was wet"]), ("event", "7", "samples", ["only one"]), ("second_desc", "7", "samples", ["a car turns left", "a car turns", "a car"]), ("second_draw", "8", "samples", ["a quiet street"])]
    long = [(s, i, k, n, v, None) for s, i, k, vs in votes for n, v in enumerate(vs)] + [("evidence", "2", "samples", 0, "no, there was none", "bcq_oe_no"), ("evidence", "6", "samples", 0, "wet road, it rained", "open_qa"), ("evidence", "6", "samples", 1, "other", "bcq_oe_no")]
    pools = spark.createDataFrame(long, "source string, item string, kind string, pos int, value string, task string")
    siblings = spark.createDataFrame([("1", "2"), ("2", "1"), ("4", "5"), ("5", "4")], "item string, sibling string")
    got = lambda **k: dict(map(tuple, compliant_answers(items, pools, siblings, **k).collect()))
    # 1: no no yes + yes no no of its sibling; 4: two blue against three green of its sibling's further orders.
    assert got() == {"1": "No", "2": "no, there was none", "3": "No", "4": "C", "5": "C. green", "6": "wet road, it rained", "7": "a car turns", "8": "a quiet street", "9": "Yes", "10": ""}
    # 1 and 3 agree: 1 has the lower margin (4 of 6 against 2 of 3 are equal: the first flips), so 2 keeps its text.
    flipped = got(pair_repair=True)
    assert (flipped["1"], flipped["3"], flipped["2"]) == ("Yes", "No", "no car")
    alone = got(single_model=True)  # 1: yes + yes no no, the first seen wins
    assert (alone["1"], alone["4"], alone["2"]) == ("Yes", "C", "no car")
    more = pools.unionByName(spark.createDataFrame([("event", "7", "samples", 1, "only one more", None)], pools.schema))
    assert dict(map(tuple, compliant_answers(items, more, siblings).collect()))["7"] == "only one"
    assert dict(map(tuple, compliant_answers(items, more, siblings, events=False).collect()))["7"] == "a car turns"
    assert compliant_answers(items.limit(0), pools.limit(0), siblings.limit(0)).count() == 0


def test_scenes_choose_from_all_texts(spark):
    """A scene's best text may stand behind the 48th; the whole compliant assembly chooses from the first 48, as its medoid does."""
    from corvane.plans.assemble import compliant_answers, open_recipes

    items = spark.createDataFrame([("s", 1, "scene_description", "What?", 0), ("q", 1, "open_qa", "Why?", 1)], "item string, video long, task string, question string, ord long")
    texts = [f"t{n} u{n}" for n in range(48)] + ["t0 late"] + [f"late t{n} u{n}" for n in range(60, 80)]
    rows = [("second_desc", i, "samples", n, v, None) for i in "sq" for n, v in enumerate(texts)]
    pools = spark.createDataFrame(rows, "source string, item string, kind string, pos int, value string, task string")
    got = dict(map(tuple, open_recipes(items, pools, pools.select("item", "pos", "value"), compliant=True).collect()))
    assert got == {"s": "t0 late", "q": "t0 u0"}
    none = spark.createDataFrame([], "item string, sibling string")
    assert dict(map(tuple, compliant_answers(items, pools, none).collect())) == {"s": "t0 u0", "q": "t0 u0"}


def test_generation_errors_and_resume(spark):
    from corvane.sources.generate import SCHEMA, fake_client, generate

    work = spark.createDataFrame([("1", "t", "ok"), ("2", "t", "FAIL")], "item string, task string, prompt string")
    out = generate(work, spark.createDataFrame([], SCHEMA), fake_client, n=2)
    got = {r["item"]: (len(r["samples"]), r["err"]) for r in out.collect()}
    assert got == {"1": (2, None), "2": (0, "refused")}
    assert generate(work, out, fake_client).count() == 0
    assert generate(work, out, fake_client, retry_errors=True).count() == 1


def test_readers_and_writers(spark, tmp_path):
    import json

    from corvane.sources import readers, writers

    (tmp_path / "a.json").write_text(json.dumps({"metadata": {"task": "bcq"}, "items": [{"video_id": "v", "question": "q", "answer": "a"}, {"question": "no id"}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"video_id": "w", "answer": "é"}]))
    items = readers.all_tasks(spark, {"bcq": str(tmp_path / "a.json"), "mcq": str(tmp_path / "b.json"), "gone": str(tmp_path / "c.json")})
    assert {(r["video_id"], r["task"]) for r in items.collect()} == {("v", "bcq"), ("w", "mcq")}
    pred = spark.createDataFrame([("1", 'a "b", c'), ("2", " ")], "item string, prediction string")
    assert writers.submission(pred, str(tmp_path / "out")) == 1
    assert {r["item"]: r["prediction"] for r in readers.predictions(spark, str(tmp_path / "out")).collect()}["1"] == 'a "b", c'
    assert sorted(r["x"] for r in readers.shard(spark.range(10).withColumnRenamed("id", "x"), "x", 1, 3).collect()) == [1, 4, 7]


def test_streaming_counts(spark, tmp_path):
    from corvane.streaming.votes import windowed_counts

    src = "/root/testdata/sf0.001/events.parquet"
    (tmp_path / "in").mkdir()
    import shutil

    shutil.copy(src, tmp_path / "in")
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream, "user_id", "event_type", "ts", "event_id").writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(k) from w").first()[0] == spark.read.parquet(src).count()


def test_siblings_without_keys_or_options(spark):
    """Null subjects and questions without four options have no sibling; a y that several x choose is paired with the last."""
    asked = lambda k: "Which?\n" + "\n".join(f"{x}. way {k + j}" for j, x in enumerate("ABCD"))
    rows = [("a", 1, "mcq", asked(0), 1), ("b", 1, "mcq", asked(1), 2), ("y", 1, "mcq_openended", asked(0), 3), ("z", 1, "mcq_openended", asked(1), 4),
            ("c", None, "mcq", asked(0), 5), ("d", 1, "mcq", None, 6), ("e", 1, "mcq", "Which?\nA. way 0", 7), ("f", 1, "mcq_openended", "", 8)]
    items = spark.createDataFrame(rows, "item string, video long, task string, question string, ord long")
    assert sorted(map(tuple, J.choice_siblings(items).collect())) == [("a", "y"), ("b", "y"), ("y", "b")]
    polar = items.withColumn("task", F.when(F.col("task") == "mcq", "bcq").otherwise("bcq_openended")).filter("item in ('a', 'b', 'c', 'y')")
    assert sorted(map(tuple, J.stance_siblings(polar).collect())) == [("a", "y"), ("b", "y"), ("y", "b")]
    assert J.choice_siblings(items.limit(0)).count() == 0


def test_choice_siblings_equal_all_pairs(spark):
    """Against all pairs: repeated options, a hot stem, ties in order, other numbers of common options."""
    import random

    rng, norm = random.Random(5), lambda o: o.lower()
    rows = [(f"q{k}", rng.choice([1, 1, 1, 2, None]), rng.choice(["mcq", "mcq_openended"]), [rng.choice("abcdef") for _ in "ABCD"], rng.randrange(40)) for k in range(120)]
    asked = [(i, v, t, "Which?\n" + "\n".join(f"{x}. {o}" for x, o in zip("ABCD", os)), n) for i, v, t, os, n in rows]
    items = spark.createDataFrame(asked, "item string, video long, task string, question string, ord long")
    for least in (1, 3, 4):
        first = {}
        for i, v, t, os, n in rows:
            near = [(m, j) for j, w, u, ps, m in rows if t == "mcq" and u == "mcq_openended" and v is not None and v == w and len(set(map(norm, os)) & set(map(norm, ps))) >= least]
            if near:
                first[i] = (min(near)[1], n)
        last = {}
        for x, (y, n) in first.items():
            last[y] = max(last.get(y, (-1, "")), (n, ""))
        got = J.choice_siblings(items, least=least).collect()
        assert {(r["item"], r["sibling"]) for r in got if r["item"] in first} == {(x, y) for x, (y, _) in first.items()}
        back = {r["item"]: r["sibling"] for r in got if r["item"] in last}
        assert set(back) == set(last) and all(first[x] == (y, last[y][0]) for y, x in back.items())


def test_compliant_assembly_makes_medoids_once(spark):
    """Predictions are read twice, for themselves and as a closed sibling's stance: what is written isn't chosen again. Two
    draws in turn share one shuffle, and rows without an item go."""
    from corvane.operators.vote import interleaved
    from corvane.plans.assemble import compliant_answers

    items = spark.createDataFrame([("1", 1, "bcq", "Is it?", 0), ("2", 1, "bcq_openended", "Is it?", 1)], "item string, video long, task string, question string, ord long")
    pools = spark.createDataFrame([("second", "2", "samples", 0, "no car", None)], "source string, item string, kind string, pos int, value string, task string")
    siblings = spark.createDataFrame([("1", "2"), ("2", "1")], "item string, sibling string")
    out = compliant_answers(items, pools, siblings)
    assert dict(map(tuple, out.collect())) == {"1": "No", "2": "no car"}
    scans = out._jdf.queryExecution().optimizedPlan().toString()
    assert scans.count("max_by(") == 1  # the evidence's medoid alone
    a, b = (spark.createDataFrame([(i, p, f"{n}{p}") for i, k in ps for p in range(k)], "item string, pos int, value string") for n, ps in (("a", [("x", 1), (None, 2), ("z", 1)]), ("b", [("x", 3), ("y", 1)])))
    got = sorted((r["item"], r["pos"], r["value"]) for r in interleaved(a, b).collect())
    assert got == [("x", 0, "a0"), ("x", 1, "b0"), ("x", 2, "b1"), ("x", 3, "b2"), ("y", 0, "b0"), ("z", 0, "a0")]


def test_choice_siblings_parses_each_text_once(spark):
    """Texts that many subjects share are parsed apart from the rows and broadcast; rows in their place give the same."""
    q = lambda k: "Which?\n" + "\n".join(f"{x}. way {k + n}" for n, x in enumerate("ABCD"))
    rows = [(f"{v}-{k}", v, ("mcq", "mcq_openended")[k % 2], q(k % 3), k) for v in range(4) for k in range(6)] + [("n", 1, "mcq", None, 9), ("o", 1, "mcq", "What?", 10)]
    items = spark.createDataFrame(rows, "item string, video long, task string, question string, ord int")
    shared, own = J.choice_siblings(items), J.choice_siblings(items, few=0)
    assert sorted(map(tuple, shared.collect())) == sorted(map(tuple, own.collect())) and shared.count()
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in (shared, own)]
    assert "regexp_extract_all" not in plans[0] and "regexp_extract_all" in plans[1]


def test_decisions_in_order(spark):
    """A judge overrides, then equal pairs part, then an open item follows its closed one, then blanks are filled."""
    from corvane.plans.assemble import finished

    df = lambda rows, s: spark.createDataFrame(rows, s)
    pred = df([("a", "No"), ("b", "Yes"), ("o", "some text"), ("n", None), ("m", " ")], "item string, prediction string")
    out = finished(pred, df([("g", "a", 1), ("g", "b", 2), (None, "m", 3)], "group string, item string, ord long"), df([("a", "yes"), ("b", None)], "item string, verdict string"),
                   df([("a", 0.5), ("b", 0.25)], "item string, margin_a double"), df([("o", "b")], "item string, sibling string"), df([("o", "No, it is not")], "item string, value string"), df([("n", "filled")], "item string, value string"))
    assert dict(map(tuple, out.collect())) == {"a": "Yes", "b": "No", "o": "No, it is not", "n": "filled", "m": "No"}
