import os

import numpy as np

from framewright.sources import files
from framewright.streaming import boxes as stream
from framewright.streaming.boxes import greedy_choices, run_complete, timed_section_counts

from test_detections import BOX, box, videos


def test_saved_boxes_round_trip(spark, tmp_path):
    df = spark.createDataFrame([box(i, i, 5.0, 5.0, video=1 + i % 2) for i in range(6)], BOX).drop("det_id")
    files.save_detections(df, str(tmp_path), "track", "declustered")
    assert files.load_detections(spark, str(tmp_path), "track", "declustered").count() == 6
    assert files.load_detections(spark, str(tmp_path), "track", "vacant").count() == 0


def test_truth_and_responses(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x_A_B.csv").write_text("A, true\n b ,Yes\nC,0\n")
    (tmp_path / "t" / "empty.csv").write_text("")
    assert {tuple(r) for r in files.read_truth(spark, str(tmp_path / "t")).collect()} == {("x_A_B", "A", True), ("x_A_B", "B", True), ("x_A_B", "C", False)}
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "x.json").write_text('[{"id": "A"}]')
    (tmp_path / "r" / "y.json").write_text("null")
    assert {tuple(r) for r in files.read_responses(spark, str(tmp_path / "r"), "gemini1.5").collect()} == {("x", "gemini1.5", '[{"id": "A"}]'), ("y", "gemini1.5", None)}


def test_frame_arrays(spark, tmp_path):
    kind = np.dtype([("bbox", "f8", 4), ("confidence", "f8"), ("class", "i8")])
    frames = np.empty(3, object)
    frames[:] = [np.zeros(0, kind), np.array([([1, 2, 3, 4], 0.5, 0)], kind), np.array([([1, 2, 3, 4], 0.5, 0), ([5, 6, 7, 8], 0.25, 1)], kind)]
    path = str(tmp_path / "a.npy")
    np.save(path, frames, allow_pickle=True)
    spark.dataSource.register(files.FrameArrays)
    rows = spark.read.format("npy_frames").option("paths", f"{path},{tmp_path}/gone.npy").option("trusted", "true").load().collect()
    assert [(r["frame_id"], r["det_ord"], r["cluster_id"]) for r in rows] == [(1, 0, -1), (2, 0, -1), (2, 1, -1)]


def _stream(spark, tmp_path, parts):
    folder = str(tmp_path / "in")
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, BOX).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(BOX).option("maxFilesPerTrigger", 1).parquet(folder)


def test_streams_equal_batch(spark, tmp_path):
    parts = [[box(i, i, 10.0 + i, 20.0) for i in range(k * 60, k * 60 + 60)] for k in range(3)]
    df = _stream(spark, tmp_path, parts)
    counts = run_complete(stream.section_counts(df, videos(spark)), str(tmp_path / "out"))
    assert {(r["section_id"], r["n_boxes"]) for r in counts.collect()} == {(0, 90), (1, 90)}
    query = greedy_choices(df).writeStream.format("memory").queryName("chosen").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("chosen").count() == 180


def test_timed_counts_plan(spark, tmp_path):
    from pyspark.sql import functions as F

    v = videos(spark).withColumn("recorded_at", F.timestamp_seconds(F.lit(0)))
    df = timed_section_counts(_stream(spark, tmp_path, [[box(i, i, 1.0, 1.0) for i in range(600)]]), v)
    query = df.writeStream.format("memory").queryName("timed").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert set(spark.table("timed").columns) == {"video_id", "window", "n_boxes"} and os.path.exists(tmp_path)


def test_videos_are_found_by_extension(spark, tmp_path):
    for name in ("b.mp4", "a.mp4", "c.txt"):
        (tmp_path / name).write_text("")
    found = files.find_videos(spark, str(tmp_path), str(tmp_path / "a.mp4"), str(tmp_path / "none")).orderBy("video_id").collect()
    assert [(r["video_id"], os.path.basename(r["path"])) for r in found] == [(0, "a.mp4"), (1, "b.mp4")]


def test_presentations_by_exact_id(spark, tmp_path):
    rows = [("v_A_B", 1, b"2", "t"), ("v_A_B", 0, b"1", "t"), ("v_A_B_C", 0, b"3", "u"), ("w", 0, None, "t")]
    place = str(tmp_path / "p")
    wanted = spark.createDataFrame([("v_A_B",), ("w",), ("v_A_B",)], "artifact_id string")
    assert files.load_presentations(wanted, place).count() == 0
    files.save_presentations(spark.createDataFrame(rows, files.PRESENTATION), place)
    assert [(r["artifact_id"], [bytes(x) for x in r["images"]], r["text"]) for r in files.load_presentations(wanted, place).collect()] == [("v_A_B", [b"1", b"2"], "t")]
