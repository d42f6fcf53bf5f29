"""The two end-to-end plans: from detections to filtered detections, and from detections to a crop plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.columns import cluster_letter
from framewright.operators import boxes as B
from framewright.operators import clustering, crop, labelling, sections
from framewright.session import cut
from framewright.sources.tables import table


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


def section_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct boxes with section_id and rel_frame."""
    videos = load(spark, sf_dir, "videos")
    placed = B.with_section(B.distinct_boxes(load(spark, sf_dir, "detections")), videos)
    length = videos.select("video_id", B.section_length(F.col("fps")).alias("length"))
    return placed.join(length, "video_id").withColumn("rel_frame", F.col("frame_id") - F.col("section_id") * F.col("length")).drop("length")


def crop_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections to crop windows: spine, means per frame, carried interests, zoom and window."""
    points = B.carried_interests(load(spark, sf_dir, "frames"), B.distinct_boxes(load(spark, sf_dir, "detections")))
    return crop.crop_windows(points.join(load(spark, sf_dir, "videos").select("video_id", "width", "height"), "video_id"))


def declustered(boxes: DataFrame, videos: DataFrame) -> DataFrame:
    """The boxes left when static clusters are removed (all, where there is none)."""
    labels = clustering.cluster_videos(boxes, videos)
    return boxes.join(labels.where("label = -1").select("det_id"), "det_id", "left_semi")


def relevant_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole filter: play clusters per section, noise dropped; sections with several clusters keep those that
    their recorded answer does not call secondary (all, where there is no answer that can be read); boxes in zones
    of earlier sections dropped.

    An answer is that to the section's full artifact id, labels included. A section's zone is that of the secondary
    cluster which its answer names last; labels that no cluster has are passed over.
    """
    videos = load(spark, sf_dir, "videos")
    boxes = section_boxes(spark, sf_dir).drop("cluster_id")
    play = clustering.cluster_sections(boxes.withColumn("cluster_id", F.lit(-1)), videos).select("det_id", F.col("label").alias("cluster_id"))
    labelled = cut(boxes.join(play, "det_id").where("cluster_id <> -1"))
    letters = F.transform(F.array_sort(F.collect_set("cluster_id")), cluster_letter)
    crowded = labelled.groupBy("video_id", "section_id").agg(letters.alias("labels")).where("size(labels) > 1")
    ids = B.artifact_ids(crowded.join(B.sections(load(spark, sf_dir, "frames"), videos), ["video_id", "section_id"]), videos)
    answers = ids.join(labelling.latest_places(load(spark, sf_dir, "responses")), "artifact_id").select("video_id", "section_id", (F.ascii("label") - 65).alias("cluster_id"), "is_primary", "place")
    marked = labelled.join(answers, ["video_id", "section_id", "cluster_id"], "left")
    secondary = marked.where("not is_primary")
    last = secondary.groupBy("video_id", "section_id").agg(F.max_by("cluster_id", "place").alias("cluster_id"))
    zones = sections.zones(secondary.join(last, ["video_id", "section_id", "cluster_id"], "left_semi"))
    primary = marked.where("is_primary is null or is_primary").drop("is_primary", "place")
    return sections.outside_earlier_zones(primary, zones)
