"""Detections as rows: cleaning, the dense frame spine, sections, sampling and per-frame statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.columns import area, center_x, center_y, clock, whole

SECTION_SECONDS = 3
BLOCK = 4096  #: frames that one task carries values forward over
CORNERS = ("x1", "y1", "x2", "y2")


def scan_boxes(detections: DataFrame) -> DataFrame:
    """Every row with all corners, corners in order and the defaults of a box that lacks something: confidence 0,
    class 0, cluster -1. Columns that are absent altogether get the same defaults; NaN corners count as lacking."""
    have = set(detections.columns)
    value = lambda c, kind, default: F.coalesce(F.col(c), F.lit(default)).cast(kind).alias(c) if c in have else F.lit(default).cast(kind).alias(c)
    ok = F.lit(True)
    for c in CORNERS:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c)
    return detections.where(ok & F.col("video_id").isNotNull() & F.col("frame_id").isNotNull()).select(
        *[c for c in ("det_id",) if c in have], "video_id", "frame_id", "det_ord",
        F.least("x1", "x2").alias("x1"), F.least("y1", "y2").alias("y1"), F.greatest("x1", "x2").alias("x2"), F.greatest("y1", "y2").alias("y2"),
        value("confidence", "double", 0.0), value("class_id", "int", 0), value("cluster_id", "int", -1),
    )


def distinct_boxes(detections: DataFrame) -> DataFrame:
    """``scan_boxes`` with repeated rows read once."""
    return scan_boxes(detections).distinct()


def box_geometry(boxes: DataFrame) -> DataFrame:
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return boxes.select("det_id", F.round(center_x(), 4).alias("cx"), F.round(center_y(), 4).alias("cy"), F.round(w, 4).alias("w"), F.round(h, 4).alias("h"), F.round(area(), 4).alias("area"))


def box_center_int(boxes: DataFrame) -> DataFrame:
    return boxes.select("det_id", whole(center_x()).alias("cx"), whole(center_y()).alias("cy"))


def frame_spine(frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """Every frame with its boxes in order, or one row of nulls where it has none."""
    return frames.select("video_id", "frame_id").join(boxes, ["video_id", "frame_id"], "left")


def pack_frames(boxes: DataFrame) -> DataFrame:
    """(video_id, frame_id, boxes): the boxes of a frame as one array, by det_ord."""
    box = F.struct("det_ord", *CORNERS, "confidence", "class_id", "cluster_id")
    return boxes.groupBy("video_id", "frame_id").agg(F.array_sort(F.collect_list(box)).alias("boxes"))


def unpack_frames(packed: DataFrame) -> DataFrame:
    return packed.select("video_id", "frame_id", F.explode("boxes").alias("b")).select("video_id", "frame_id", "b.*")


def frame_count(frames: DataFrame) -> DataFrame:
    return frames.groupBy("video_id").agg(F.count("*").alias("n_frames"))


def section_length(fps: Column, seconds: int = SECTION_SECONDS) -> Column:
    return F.lit(seconds) * fps


def section_of(frame: Column, fps: Column, seconds: int = SECTION_SECONDS) -> Column:
    return F.floor(frame / section_length(fps, seconds)).cast("long")


def sections(frames: DataFrame, videos: DataFrame, seconds: int = SECTION_SECONDS) -> DataFrame:
    """(video_id, section_id, start_frame, end_frame): tumbling sections, the end exclusive, with a tail for what is left.

    A video shorter than one section is one section.
    """
    length = frame_count(frames).join(videos.select("video_id", "fps"), "video_id")
    step = section_length(F.col("fps"), seconds)
    rows = length.select("video_id", "n_frames", step.alias("step"), F.explode(F.sequence(F.lit(0), F.floor((F.col("n_frames") - 1) / step).cast("int"))).alias("s"))
    return rows.select("video_id", F.col("s").cast("long").alias("section_id"), (F.col("s") * F.col("step")).cast("long").alias("start_frame"), F.least((F.col("s") + 1) * F.col("step"), "n_frames").cast("long").alias("end_frame"))


def with_section(rows: DataFrame, videos: DataFrame, seconds: int = SECTION_SECONDS) -> DataFrame:
    return rows.join(videos.select("video_id", "fps"), "video_id").withColumn("section_id", section_of(F.col("frame_id"), F.col("fps"), seconds)).drop("fps")


def sample_frames(sections_: DataFrame, k: int = 5) -> DataFrame:
    """(…, sample_no, frame_id): the last frame of each of k equal parts; sections with fewer frames give none."""
    part = F.explode(F.sequence(F.lit(1), F.lit(k))).alias("i")
    rows = sections_.where(F.col("end_frame") - F.col("start_frame") >= k).select("*", part)
    at = F.floor((F.col("start_frame") * k + F.col("i") * (F.col("end_frame") - F.col("start_frame"))) / k) - 1
    return rows.select("video_id", "section_id", (F.col("i") - 1).cast("int").alias("sample_no"), at.cast("long").alias("frame_id"))


def sample_centers(sections_: DataFrame, k: int = 5) -> DataFrame:
    """The middle frame of each of k equal parts."""
    rows = sections_.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i"))
    at = F.floor((F.col("start_frame") * 2 * k + (2 * F.col("i") + 1) * (F.col("end_frame") - F.col("start_frame"))) / (2 * k))
    return rows.select("video_id", "section_id", F.col("i").cast("int").alias("sample_no"), at.cast("long").alias("frame_id"))


def sample_occupied(sections_: DataFrame, boxes: DataFrame) -> DataFrame:
    """The first frame with a box at or after the middle of a section, which may lie behind its end.

    As-of search by union: the section middles and the occupied frames are put in one order, and the next
    occupied frame is carried backwards block by block.
    """
    middles = sections_.select("video_id", F.floor((F.col("start_frame") + F.col("end_frame")) / 2).cast("long").alias("frame_id"), "section_id", F.lit(None).cast("long").alias("hit"))
    occupied = boxes.select("video_id", "frame_id").distinct().select("video_id", "frame_id", F.lit(None).cast("long").alias("section_id"), F.col("frame_id").alias("hit"))
    both = middles.unionByName(occupied).withColumn("block", F.floor(F.col("frame_id") / BLOCK))
    within = Window.partitionBy("video_id", "block").orderBy(F.col("frame_id").desc(), F.col("hit").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    heads = both.groupBy("video_id", "block").agg(F.min("hit").alias("head"))
    later = heads.withColumn("follows", F.min("head").over(Window.partitionBy("video_id").orderBy("block").rowsBetween(1, Window.unboundedFollowing))).drop("head")
    seen = both.withColumn("own", F.last("hit", ignorenulls=True).over(within)).where("section_id is not null")
    return seen.join(later, ["video_id", "block"]).select("video_id", "section_id", F.coalesce("own", "follows").alias("frame_id")).where("frame_id is not null")


def split_sections(sections_: DataFrame, k: int = 3) -> DataFrame:
    """k parts of each section, [i*L/k, (i+1)*L/k) in whole frames of the section."""
    rows = sections_.select("*", (F.col("end_frame") - F.col("start_frame")).alias("l"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i"))
    edge = lambda i: F.floor(i * F.col("l") / k).cast("long")
    return rows.select("video_id", "section_id", F.col("i").cast("int").alias("part_no"), edge(F.col("i")).alias("first"), edge(F.col("i") + 1).alias("end"))


def carry_forward(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The last value that is not null at or before each row, carried over blocks of BLOCK orders so that a long
    key is spread over many tasks."""
    blocked = rows.withColumn("_block", F.floor(F.col(order) / BLOCK))
    ends = blocked.groupBy(key, "_block").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_{c}") for c in columns])
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(key, "_block", *[F.last(f"_{c}", ignorenulls=True).over(before).alias(f"_{c}") for c in columns])
    within = Window.partitionBy(key, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = blocked.join(carried, [key, "_block"])
    for c in columns:
        filled = filled.withColumn(c, F.coalesce(F.last(c, ignorenulls=True).over(within), F.col(f"_{c}")))
    return filled.drop("_block", *[f"_{c}" for c in columns])


def frame_means(boxes: DataFrame) -> DataFrame:
    """(video_id, frame_id, mean_area, poi_x, poi_y): mean area; mean of the whole centers, without fraction."""
    mean = lambda c: whole(F.avg(whole(c)))
    return boxes.groupBy("video_id", "frame_id").agg(F.avg(area()).alias("mean_area"), mean(center_x()).alias("poi_x"), mean(center_y()).alias("poi_y"))


def carried_interests(frames: DataFrame, boxes: DataFrame, default_point: tuple[int, int] = (960, 720), default_area: float = 100.0) -> DataFrame:
    """(video_id, frame_id, poi_x, poi_y, aoi) of every frame, the last seen where it has no box, or the defaults."""
    seen = frames.select("video_id", "frame_id").join(frame_means(boxes), ["video_id", "frame_id"], "left")
    filled = carry_forward(seen, "video_id", "frame_id", ["poi_x", "poi_y", "mean_area"])
    return filled.select("video_id", "frame_id", F.coalesce("poi_x", F.lit(default_point[0])).alias("poi_x"), F.coalesce("poi_y", F.lit(default_point[1])).alias("poi_y"), F.coalesce("mean_area", F.lit(default_area)).alias("aoi"))


def artifact_ids(labelled: DataFrame, videos: DataFrame, millis: bool = True) -> DataFrame:
    """(video_id, section_id, artifact_id) of (video_id, section_id, start_frame, end_frame, labels): name, clock
    times and, with milliseconds, the labels in order. Without them ids can collide."""
    v = videos.select("video_id", "video_name", "fps")
    times = [clock(F.col(c), F.col("fps"), millis) for c in ("start_frame", "end_frame")]
    parts = [F.array("video_name", *times), "labels"] if millis else [F.array("video_name", *times)]
    return labelled.join(v, "video_id").select("video_id", "section_id", F.array_join(F.concat(*parts), "_").alias("artifact_id"))


def from_predictions(predictions: DataFrame) -> DataFrame:
    """Boxes of a detector's output, (video_id, frame_id, predictions) with an array of (bbox, score, category) structs,
    ``bbox`` being x1, y1, x2, y2: one row each, in the order of the array, without a cluster (-1). Frames with a null or
    empty array have no rows."""
    each = predictions.select("video_id", "frame_id", F.posexplode("predictions").alias("det_ord", "p"))
    at = lambda i: F.get("p.bbox", F.lit(i)).cast("double")
    return each.select("video_id", "frame_id", "det_ord", at(0).alias("x1"), at(1).alias("y1"), at(2).alias("x2"), at(3).alias("y2"), F.coalesce(F.col("p.score").cast("double"), F.lit(0.0)).alias("confidence"), F.coalesce(F.col("p.category").cast("int"), F.lit(0)).alias("class_id"), F.lit(-1).alias("cluster_id"))
