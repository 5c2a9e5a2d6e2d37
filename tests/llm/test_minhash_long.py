"""Signatures of long texts, and how many near pairs bands find."""

import random

import numpy as np

from corvane.llm.minhash import SIG, linked_classes, minhash_dedup, multipliers, signature
from corvane.llm.words import mix


def test_signatures_of_large_unrelated_sets_differ():
    mult = multipliers(144)
    sigs = [signature(np.sort(mix(np.random.default_rng(i).integers(0, 1 << 63, 200_000, dtype=np.uint64))), mult) for i in range(5)]
    assert all(s.dtype == SIG for s in sigs)
    assert np.mean([(sigs[i] == sigs[j]).mean() for i in range(5) for j in range(i)]) < 0.001


def test_long_unrelated_documents_meet_in_no_bucket(spark, monkeypatch):
    """24 texts of 120,000 words of their own, and a near copy of one of them."""
    from corvane.llm import common

    seen = {}
    write = common.Tables.write

    def counted(self, df, key, **options):
        out = write(self, df, key, **options)
        seen[key] = out.count()
        return out

    monkeypatch.setattr(common.Tables, "write", counted)
    texts = [" ".join(map(str, np.random.default_rng(k).integers(0, 50_000, 120_000).tolist())) for k in range(24)]
    near = texts[3].split(" ")
    near[50_000] = "other"
    df = spark.createDataFrame([*enumerate(texts), (24, " ".join(near))], "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup(df, k=3, num=85, den=100, bands=24, rows=6).collect()}
    assert got == {k: 3 if k == 24 else k for k in range(25)}
    assert seen["stars"] == 1 and seen["alive"] == 1 and seen["tiles"] == 0


def test_recall_near_the_threshold(spark):
    """Pairs just above the threshold, all of which must be linked."""
    from corvane.llm.common import Tables

    r, rows = random.Random(3), []
    for k in range(400):
        w = [f"{k}_{i}" for i in range(120)]
        rows.append((2 * k, " ".join(w)))
        for i in r.sample(range(3, 117, 6), 3):  # up to nine of 118 shingles of each side
            w[i] = f"{k}_x{i}"
        rows.append((2 * k + 1, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    _, _, comp = linked_classes(df, Tables(spark, "recall"), k=3, num=85, den=100, bands=24, rows=6)
    assert comp.count() == 800 and comp.select("comp").distinct().count() == 400
