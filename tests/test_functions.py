"""Hand-computed cases of the text, clock and frame functions."""

import pytest
from pyspark.sql import functions as F

from corvane.functions import clock as C
from corvane.functions import frames as N
from corvane.functions import text as T

L = F.lit
ARR = lambda *x: F.array(*(F.lit(v) for v in x))


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("make", "want"),
    [
        (lambda: T.hedge_ratio(L("It is unlikely")), 1 / 3),
        (lambda: T.hedge_ratio(L("")), 1.0),
        (lambda: T.count_pattern(L("at 1:23.4 and 10:00")), 2),
        (lambda: T.prefix_polarity(L("Nothing happened, yes")), "no"),
        (lambda: T.yes_no(L("Nothing happened, yes")), "yes"),
        (lambda: T.letter_leading(L("I think B")), "I"),
        (lambda: T.letter_standalone(L("I think B")), "B"),
        (lambda: T.letter_leading(L("the answer is b")), None),
        (lambda: T.letter_standalone(L("the answer is b")), "B"),
        (lambda: T.unwrap_then_unthink(L("x<think>t</think>y")), "xy"),
        (lambda: T.unwrap_or_whole(L("x<think>t</think>y")), "x<think>t</think>y"),
        (lambda: T.unwrap_or_unthink(L("x<think>t</think>y")), "xy"),
        (lambda: T.unwrap_then_unthink(L("t</think>y")), "t</think>y"),
        (lambda: T.unwrap_or_unthink(L("t</think>y")), "y"),
        (lambda: T.unwrap_then_unthink(L("<answer>a<think>t</think>b</answer>")), "ab"),
        (lambda: T.unwrap_or_unthink(L("<answer>a<think>t</think>b</answer>")), "a<think>t</think>b"),
        (lambda: T.option_text(L("Q\nA. red\nB. blue"), L("A")), "red"),
        (lambda: T.option_text_bracket(L("Q\nA. red\nB. blue"), L("A")), ""),
        (lambda: T.option_line(L("Q\nA. red\nB. blue"), L("B")), "blue"),
        (lambda: T.options(L("Q\nA. x\nB) y\nC. z\nD. w?\n\nmore"))["D"], "w"),
        (lambda: T.options(L("Q\nA. x\nB. y")), None),
        (lambda: T.verdict(L("It cannot be yes")), "unknown"),
        (lambda: T.jaccard(T.long_words(L("car hits truck")), T.long_words(L("truck stops"))), 1 / 3),
        (lambda: C.hundredths_clock(L("00:35:20")), 35.2),
        (lambda: C.hours_clock(L("00:35:20")), 2120.0),
        (lambda: C.first_clock(L("00:35:20")), 35.0),
        (lambda: C.clock_within(L("00:00:04"), L(5.3)), 4.0),
        (lambda: C.clock_within(L("00:35:20"), L(36.0)), 35.2),
        (lambda: C.clock_pairs(L("0:01 0:02 0:03"))[1]["e"], 3.0),
        (lambda: C.minutes_seconds(L(125.5)), "02:06"),
        (lambda: N.frame_at(L(0.1), L(25.0), L(100)), 2),
        (lambda: N.dense(L(10), L(20), 5, L(100)), [10, 12, 15, 17, 20]),
        (lambda: N.uniform(L(11), L(4)), [0, 3, 6, 10]),
        (lambda: N.uniform_rounded(L(11), 4), [0, 3, 7, 10]),
        (lambda: N.uniform_even(L(11), 4), [0, 2, 5, 8]),
        (lambda: N.resize(ARR(*range(10)), L(10), 4), [0, 2, 5, 7]),
        (lambda: N.snap_outward(ARR(0.0, 0.5, 1.0, 1.5), L(0.6), L(0.9))["e"], 1.0),
        (lambda: N.snap_nearest(ARR(0.0, 0.5, 1.0, 1.5), L(0.6), L(0.7))["e"], 1.0),
        (lambda: N.nearest(ARR(0, 10, 20), L(15)), 10),
    ],
)
def test_value(spark, make, want):
    got = one(spark, make())
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


def test_best_option(spark):
    o = F.struct(L("the red car").alias("A"), L("blue").alias("B"), L("red").alias("C"), L("x").alias("D"))
    assert one(spark, T.best_option(L("a red car"), o)) == "A"
    assert one(spark, T.best_option(L("nothing"), o)) is None


def test_python_round(spark):
    """Equal to Python's round() and its "%.2f" on ties, near ties, long fractions, negative and large numbers."""
    import random

    from corvane.functions.clock import minutes_hundredths
    from corvane.functions.rounding import python_round

    r = random.Random(6)
    xs = [0.35, 0.25, 0.125, 2.675, 1.005, 0.5, 1.5, -0.35, -2.5, 3e17, 0.1 + 0.2, 7 / 20] + [r.choice((r.random() * 10**r.randrange(6), r.randrange(10**6) / 8, r.randrange(10**5) / 1000)) * r.choice((1, -1)) for _ in range(3000)]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k int, x double")
    for row in df.select("k", "x", *(python_round(F.col("x"), d).alias(f"r{d}") for d in (1, 2, 3, 4)), minutes_hundredths(F.abs("x")).alias("clock")).collect():
        for d in (1, 2, 3, 4):
            assert row[f"r{d}"] == round(row["x"], d), (row["x"], d)
        t = abs(row["x"])
        m = int(t) // 60
        assert t > 1e9 or row["clock"] == f"{m:02d}:{t - m * 60:05.2f}", t


def test_interval_and_targets(spark):
    from corvane.functions.clock import interval_json, interval_or_clip
    from corvane.functions.frames import timed_prompt
    from corvane.functions.text import json_spaced, target

    rows = [("from 0:05 to 0:10", '{"start": "0:05", "end": "0:10"}'), ('{"start": 1, "end": 2.50, "x": [1]}', None), ('x {"start": "1", "end": "2"}', '{"start": "00:00", "end": "01:15.50"}'), ('```json\n{"start": "a\\"b", "end": null}\n```', '{"start": "a\\"b", "end": "None"}'), (None, '{"start": "00:00", "end": "01:15.50"}'), ("", '{"start": "00:00", "end": "01:15.50"}'), ('[{"start": "0:01", "end": "0:02"}]', '{"start": "0:01", "end": "0:02"}'), ("[]", '{"start": "00:00", "end": "01:15.50"}')]
    df = spark.createDataFrame([(a,) for a, _ in rows], "x string")
    got = [r[0] for r in df.select(interval_json(F.col("x"), F.lit(75.5))).collect()]
    assert all(g == w for g, (_, w) in zip(got, rows) if w) and got[1].startswith('{"start": "1", "end": "2.5')
    assert tuple(df.limit(1).select(interval_or_clip(F.col("x"), F.lit(75.5)).alias("i")).first()["i"]) == (5.0, 10.0)
    one = spark.createDataFrame([('{ "a":1.50,\n"b" : "x, y: \\"z\\"" ,"c":[1,2]}', "t")], "j string, r string")
    row = one.select(json_spaced(F.col("j")), target(F.lit("temporal_localization"), F.col("r"), F.col("j"), True), target(F.lit("open_qa"), F.lit(""), F.col("j"), True) == F.col("j")).first()
    spaced = '{"a": 1.5, "b": "x, y: \\"z\\"", "c": [1, 2]}'
    assert tuple(row) == (spaced, f"<think>t</think>\n<answer>{spaced}</answer>", True)
    prompts = spark.createDataFrame([([0, 7, 1303],), ([],)], "i array<long>").select(timed_prompt(F.col("i"), F.lit(20.0), F.lit("Q?"))).collect()
    assert prompts[0][0] == "Video duration: 01:05.15. 3 frames sampled:\n[t=00:00.00] <image>\n[t=00:00.35] <image>\n[t=01:05.15] <image>\nQ?" and prompts[1][0] == "Video duration: 00:00.00. 0 frames sampled:\n\nQ?"


def test_frames_outside_intervals(spark):
    """Against all frames listed: intervals that overlap, touch, are empty, repeat or leave the clip; clips without frames."""
    import random

    import numpy as np
    from pyspark.sql import functions as F

    from corvane.functions import frames as N

    def even(pool, n):
        n = min(n, len(pool))
        return sorted({pool[j] for j in np.linspace(0, len(pool) - 1, n).astype(int)}) if n > 0 else []

    r, rows = random.Random(1), []
    for i in range(200):
        spans = [(a, a + r.randint(-2, 40)) for a in (r.randint(-5, 210) for _ in range(r.randint(0, 4)))]
        total = r.choice([0, 1, 5, 40, 200])
        rows.append((i, total, spans, r.randint(0, 40), sorted(r.sample(range(total), min(total, r.randint(0, 40))))))
    df = spark.createDataFrame(rows, "i int, total int, spans array<struct<s:int,e:int>>, n int, idx array<bigint>")
    for x in df.select("*", N.uniform_outside(F.col("total"), F.col("spans"), F.col("n")).alias("out"), N.filled(F.col("idx"), F.col("total")).alias("full")).collect():
        assert x.out == even([f for f in range(x.total) if not any(a <= f <= z for a, z in x.spans)], x.n)
        have = list(x.idx)
        more = even([f for f in range(x.total) if f not in have], 32 - len(have))
        assert x.full == sorted(set(have + more))[:32]
    long = spark.range(1).select(N.uniform_outside(F.lit(1 << 40), F.array(F.struct(F.lit(5).alias("s"), F.lit(9).alias("e"))), F.lit(3)).alias("o")).first()["o"]
    assert long[0] == 0 and long[-1] == (1 << 40) - 1 and len(long) == 3
