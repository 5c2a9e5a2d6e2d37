"""The keyframe stage over a folder with whole, partial and absent sets."""

import json
import os


def test_stage(spark, tmp_path):
    from pyspark.sql import functions as F

    from corvane.plans import keyframes as K
    from corvane.sources.readers import files

    rows = [("a/w.mp4", "bcq", "Is it?", "Yes", "S"), ("a/p.mp4", "bcq", "Is it?", "No", "A"), ("a/n.mp4", "temporal_localization", "When?", '{"start": "00:04", "end": "00:05"}', None), ("gone.mp4", "bcq", "Is it?", "No", "B"), ("empty.mp4", "bcq", None, None, "B"), ("a/s.mp4", "bcq", "Is it?", "No", "B")]
    records = spark.createDataFrame(rows, "video_id string, task string, question string, answer string, tier string").withColumns({"reasoning": F.lit("r"), "init_weight": F.lit(None).cast("double")})
    videos = spark.createDataFrame([("a/w.mp4", 100, 10.0), ("a/p.mp4", 63, 10.0), ("a/n.mp4", 400, 0.0), ("empty.mp4", 0, 10.0), ("a/s.mp4", 3, 10.0)], "video_id string, total int, fps double")
    names = {r["video_id"]: r["slug"] for r in records.select("video_id", K.T.slug(F.col("video_id"), K.T.text(F.col("question"))).alias("slug")).collect()}
    for video, n, saved in (("a/w.mp4", 32, True), ("a/p.mp4", 5, True), ("a/s.mp4", 32, False)):
        d = tmp_path / names[video]
        d.mkdir()
        for k in range(n):
            (d / f"frame_{k:05d}.jpg").write_bytes(b"x")
        if saved:
            (d / "indices.json").write_text(json.dumps({"indices": list(range(0, 2 * n, 2)), "fps": 25.0}))
    folder = f"file:{tmp_path}"
    listing = files(spark, folder)
    sets = K.whole_sets(listing, K.saved_indices(spark, folder))
    assert [r["slug"] for r in sets.collect()] == [names["a/w.mp4"]]
    staged = K.stage(records, videos, sets, folder)
    got = {r["video_id"]: r for r in staged.collect()}
    assert set(got) == {"a/w.mp4", "a/p.mp4", "a/n.mp4", "a/s.mp4"}
    w = got["a/w.mp4"]
    assert w["cached"] and w["idx"] == list(range(0, 64, 2)) and w["fps"] == 25.0 and [os.path.basename(p) for p in w["images"]] == [f"frame_{k:05d}.jpg" for k in range(32)]
    n = got["a/n.mp4"]
    assert not n["cached"] and n["fps"] == 30.0 and len(n["idx"]) == 32 and sum(90 <= i <= 180 for i in n["idx"]) == 12
    assert got["a/s.mp4"]["idx"] == [0, 1, 2] and len(got["a/s.mp4"]["images"]) == 3
    todo = {(r["video_id"], os.path.basename(r["path"])): r["idx"] for r in K.missing_frames(staged, listing).collect()}
    assert len(todo) == 27 + 32 and {v for v, _ in todo} == {"a/p.mp4", "a/n.mp4"}
    assert todo["a/p.mp4", "frame_00005.jpg"] == got["a/p.mp4"]["idx"][5]
    turns = K.training_turns(staged, True).collect()
    assert len(turns) == 3 + 2 + 1 + 1 and {t["tier"] for t in turns} == {"S", "A", "B"} and {t["init_weight"] for t in turns} == {1.0}
    assert K.training_turns(staged, False).count() == 4 and turns[0]["conversations"][0]["value"].startswith("Video duration: ")


def test_sets_and_missing_frames_by_folder(spark):
    """Names that stage() doesn't give count too, one slug may lie in two folders, records that share a folder give each
    file once with its least index; a folder's names move as one number."""
    from corvane.plans import keyframes as K

    f = lambda d, ks: [f"{d}/frame_{k:05d}.jpg" for k in ks]
    paths = f("r/mixed", range(30)) + ["r/mixed/frame_x.jpg", "r/mixed/frame_00077.jpg", "r/mixed/frame_00077.jpg", "r/mixed/frame_1.png"] + f("r/p/two", range(20)) + f("r/q/two", range(12)) + f("r/less", range(31)) + f("r/more", range(33)) + f("s/twin", (0, 2)) + ["s/twin/frame_ 0001.jpg", None]
    listing = spark.createDataFrame([(p,) for p in paths], "path string").repartition(3)
    saved = spark.createDataFrame([(s, [1], 2.0) for s in ("mixed", "two", "less", "more")], "slug string, idx array<bigint>, fps double")
    got = {r["slug"]: r["images"] for r in K.whole_sets(listing, saved).select("slug", K._paths(K.F.col("held")).alias("images")).collect()}
    assert got == {"mixed": sorted(set(paths[:32])), "two": sorted(f("r/p/two", range(20)) + f("r/q/two", range(12)))}
    names = f("s/twin", range(4))
    rows = [("b", [5, 6, 7, 8], names, False), ("a", [5, 7, 7, 7], names, False), ("c", [1, 2], f("s/new", range(2)), False), ("d", [], [], False), ("w", [3], f("r/mixed", [0]), True)]
    staged = spark.createDataFrame(rows, "video_id string, idx array<bigint>, images array<string>, cached boolean")
    todo = sorted(tuple(r) for r in K.missing_frames(staged, listing).collect())
    assert todo == [("s/new/frame_00000.jpg", "c", 1), ("s/new/frame_00001.jpg", "c", 2), ("s/twin/frame_00001.jpg", "b", 6), ("s/twin/frame_00003.jpg", "a", 7)]
    assert K.frame_files(listing.filter("path like 'r/less/%'")).count() == 1
