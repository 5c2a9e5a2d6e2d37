"""Generators: which requests an item makes, how answers are read, order under slow and failing clients."""

import threading
import time

import pytest

Q = "Which one is it?\n\nA. a red car\nB. a blue van\nC. a dog\nD. nothing at all?\nAnswer with the letter."
SIBLING = "Which is it?\nA) the dog\nB) a van, blue\nC) nothing at all\nD) a red old car"
SCHEMA = "item string, task string, question string, video string, form string, sibling_question string"


def items(spark, n=3):
    rows = []
    for k in range(n):
        rows += [(f"b{k}", "bcq", f"Is it {k}?", "v", "plain", "Was it? Explain."), (f"o{k}", "bcq_openended", f"Why {k}?", "v", "explain", "Was it?"), (f"m{k}", "mcq", Q, "v", "plain", SIBLING), (f"x{k}", "mcq_openended", "No options here", "v", "plain", SIBLING), (f"d{k}", "open_qa", None, "v", None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(2)


def by_item(df):
    return {r["item"]: r for r in df.collect()}


def _client():
    def scripted():
        """Says yes with thoughts, names the letter behind which the blue van stands, fails where the prompt says so."""

        def ask(calls):
            out = []
            for c in calls:
                if "Is it 1" in c["prompt"]:
                    out.append(RuntimeError("refused"))
                elif "van" in c["prompt"]:
                    line = next(x for x in c["prompt"].split("\n") if "van" in x)
                    out.append([f"<think>A?</think><answer>({line[0]}) it is</answer>"] * c["n"])
                else:
                    out.append(["<answer> Yes, it is </answer>", "no", "perhaps"][: c["n"]] + ["YES"] * max(0, c["n"] - 3))
            return out

        return ask

    return scripted


scripted = _client()  # a local function, which workers get by value


def test_votes_picks_and_errors(spark):
    from corvane.plans.candidates import candidates

    got = by_item(candidates(items(spark), None, "second", scripted, attempts=1))
    assert set(got) == {f"{t}{k}" for t in "bomx" for k in range(3)}
    assert got["b0"]["votes"] == ["yes", "no", "yes", "yes"] and got["b0"]["err"] is None
    assert (got["b1"]["votes"], got["b1"]["err"], got["b1"]["done"]) == ([], "refused", True)
    assert got["o0"]["samples"] == ["Yes, it is", "no", "perhaps", "YES", "YES"]
    assert got["m0"]["picks"] == ["a blue van"] * 4 and got["x0"]["picks"] == []
    retried = candidates(items(spark), candidates(items(spark), None, "second", scripted, attempts=1), "second", scripted, attempts=1, retry_errors=True)
    assert [r["item"] for r in retried.collect()] == ["b1"]


def test_siblings_mean_the_original_options(spark):
    from corvane.plans.candidates import candidates

    got = by_item(candidates(items(spark), None, "orphans", scripted, attempts=1))
    assert got["m0"]["picks"] == ["a blue van"] * 4 and got["x0"]["picks"] == [] and got["o0"]["votes"] == ["yes", "no", "yes", "yes"]
    assert {r["form"] for r in by_item(candidates(items(spark), None, "orphans_boxed", scripted, legend="Boxes.\n", attempts=1)).values()} == {"plain"}


def test_descriptive_and_greedy(spark):
    from corvane.plans.candidates import candidates

    got = by_item(candidates(items(spark), None, "descriptive", scripted, attempts=1))
    assert set(got) == {"d0", "d1", "d2"} and len(got["d0"]["samples"]) == 12 and got["d0"]["greedy"] == "<answer> Yes, it is </answer>"
    all_ = by_item(candidates(items(spark), None, "greedy", scripted, attempts=1))
    assert len(all_) == 15 and all_["b0"]["greedy"] == "Yes, it is" and (all_["b1"]["greedy"], all_["b1"]["err"]) == ("", None)


def test_prompts(spark):
    from corvane.plans.candidates import GENERATORS, with_requests

    asked = {r["item"]: r["requests"] for r in with_requests(items(spark, 1), GENERATORS["second"]).collect()}
    assert asked["m0"][1]["prompt"] == "Which one is it?\nA. a blue van\nB. a dog\nC. nothing at all\nD. a red car\nChoose the correct option. Answer with the letter."
    assert asked["m0"][1]["meant"] == ["a blue van", "a dog", "nothing at all", "a red car"] and asked["x0"] == []
    boxed = {r["item"]: r["requests"] for r in with_requests(items(spark, 1), GENERATORS["boxed"], legend="Boxes.\n").collect()}
    assert boxed["b0"][0]["prompt"] == "Boxes.\nIs it 0?" and boxed["o0"] == []
    open_ = {r["item"]: r["requests"] for r in with_requests(items(spark, 1).withColumn("task", __import__("pyspark").sql.functions.lit("mcq_openended")), GENERATORS["open_choices"]).collect()}
    assert open_["m0"][0]["prompt"] == "Which one is it?\nA) a red car\nB) a blue van\nC) a dog\nD) nothing at all\nAnswer with the letter."


def test_an_error_ends_the_run(spark):
    from corvane.plans.candidates import GENERATORS, with_requests
    from corvane.sources.calls import answered

    with pytest.raises(Exception, match="refused"):
        answered(with_requests(items(spark), GENERATORS["second"]), scripted, attempts=1, fail_fast=True).collect()


def test_order_bound_and_retries():
    """Slow calls first, two that fail once or always: answers come in order, and few calls are open at any time."""
    from corvane.sources.calls import in_order

    lock, open_now, most, read, tried = threading.Lock(), [0], [0], [0], {}

    def ask(calls):
        k = calls[0]["k"]
        with lock:
            open_now[0] += 1
            most[0] = max(most[0], open_now[0])
            tried[k] = tried.get(k, 0) + 1
        time.sleep(0.1 if k % 40 == 0 else 0.001)
        with lock:
            open_now[0] -= 1
        if k == 7 and tried[k] < 3:
            raise ValueError("once more")
        return [RuntimeError("never")] if k == 10 else [[str(k)]]

    def rows():
        for k in range(200):
            read[0] = k
            yield k, [{"k": k}] * (k % 3)

    ahead, seen = 0, []
    for row, got in in_order(rows(), ask, workers=4, attempts=3, wait=0.001):
        ahead = max(ahead, read[0] - row)
        seen.append(row)
        assert [str(g) for g in got] == ["never"] if row == 10 else all(g == [str(row)] for g in got)
    assert seen == list(range(200)) and most[0] <= 4 and ahead <= 16 and tried[7] == 3
