"""What operator 4 goes through again, and its results where lists have several pairs."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.llm import line_dedup


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def brute(rows):
    """Removed lines by doc_id; ids are unique."""
    seen, out = [], {}
    for d, t in sorted(rows):
        gone = []
        for i, line in enumerate(t.split("\n")):
            s = frozenset(line.encode().lower().split())
            if not s:
                continue
            if any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                gone.append(i)
            seen.append(s)
        out[d] = gone
    return out


def families(seed):
    r = random.Random(seed)
    kin = [[f"w{f}_{k}" for k in range(14)] for f in range(6)]

    def line():
        words = [w for w in r.choice(kin) if r.random() > 0.06] + [f"y{r.randrange(9)}" for _ in range(r.randrange(3))]
        r.shuffle(words)
        return " ".join(words)

    ids = r.sample(range(10_000), 60)
    return [(d, "\n".join(r.choice((line(), line(), "", "the same line")) for _ in range(r.randrange(1, 6)))) for d in ids]


@pytest.mark.parametrize("tile", [3, 20_000])
def test_texts_are_listed_once(spark, monkeypatch, tile):
    """Open lists are solved from what was written with them: texts are listed once, not again for the open lines."""
    calls, listed = [], line_dedup.packed_entries
    monkeypatch.setattr(line_dedup, "packed_entries", lambda *a, **b: calls.append(1) or listed(*a, **b))
    opened, choices = [], line_dedup.all_choices
    monkeypatch.setattr(line_dedup, "all_choices", lambda *a, **b: opened.append(1) or choices(*a, **b))
    rows = families(tile)
    out = {x["doc_id"]: x["removed"] for x in line_dedup.removed_lines(docs_of(spark, rows).repartition(4), tile=tile).collect()}
    assert out == brute(rows)
    assert opened == [1] and calls == [1]


def test_copies_meet_once_a_task(spark):
    """Copies that a task has seen before, in order, don't go to the shuffle by class; those out of order do."""
    base = docs_of(spark, [(d, "the same line\nthe SAME  line\n") for d in range(200)]).repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id")
    base = base.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").alias("t"))
    rows = line_dedup.line_rows(base, line_dedup.hint_of(base), 10).filter("row is not null").cache()
    assert rows.count() == 600 and rows.filter("n > 0 and not again").count() == rows.filter("text is not null").count() == 4
    assert rows.filter("line = 0 and n_lines = 3").count() == 200
    back = docs_of(spark, [(d, "a b c") for d in range(20)]).coalesce(1).orderBy(F.desc("doc_id")).coalesce(1)
    out = {x["doc_id"]: x["removed"] for x in line_dedup.removed_lines(back).collect()}
    assert out == {d: [0] if d else [] for d in range(20)}


def test_counts_are_of_lines(spark):
    """The counts that come with the lines: each distinct word once a line that a task keeps."""
    base = docs_of(spark, [(1, "a b a"), (2, "A c\nb a"), (3, None)]).coalesce(1).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("t"))
    counts = line_dedup.count_tokens(line_dedup.line_rows(base, line_dedup.hint_of(base), 16), 16)
    assert sorted(counts[counts > 0].tolist()) == [1, 1, 2]  # "b a" is the class of "a b a"


def test_one_each():
    import numpy as np

    x = np.zeros(6, line_dedup.ENTRY)
    x["k"], x["sa"], x["hint"] = [1, 2, 2, 2, 3, 3], [5, 7, 6, 7, 9, 9], [0, 4, 1, 3, 8, 8]
    assert [tuple(r)[::4] for r in line_dedup.one_each(x).tolist()] == [(1, 0), (2, 1), (2, 3), (3, 8)]
