"""Queries of the detection operators, each over its whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.functions.columns import cluster_letter, zoom_of_area
from framewright.operators import boxes as B
from framewright.operators import clustering, crop, labelling, sections, smoothing, tracking
from framewright.plans import pipelines
from framewright.plans.pipelines import load, section_boxes
from framewright.session import shared_place
from framewright.streaming import boxes as stream

R = 4  #: digits to which averages are rounded


def _boxes(spark, d):
    return B.scan_boxes(load(spark, d, "detections"))


def _distinct(spark, d):
    return B.distinct_boxes(load(spark, d, "detections"))


def _sections(spark, d):
    return B.sections(load(spark, d, "frames"), load(spark, d, "videos"))


def _stats(spark, d):
    return sections.cluster_stats(section_boxes(spark, d))


def _rounded(df, *columns, digits=R):
    """Rounded after a push of a billionth, so that ties do not hang on the order of a sum."""
    return df.withColumns({c: F.round(F.col(c) + 1e-9, digits) for c in columns})


def scan_detections(spark, d):
    return _boxes(spark, d)


def frame_pack_unpack(spark, d):
    return B.unpack_frames(B.pack_frames(_distinct(spark, d)))


def frame_count(spark, d):
    return B.frame_count(load(spark, d, "frames"))


def box_geometry(spark, d):
    return B.box_geometry(_boxes(spark, d))


def box_center_int(spark, d):
    return B.box_center_int(_boxes(spark, d))


def conf_filter(spark, d):
    return B.scan_boxes(load(spark, d, "detections").where("confidence >= 0.5")).select("det_id", "confidence")


def declustered_filter(spark, d):
    return B.scan_boxes(load(spark, d, "detections").where("cluster_id is null or cluster_id = -1")).select("det_id", "video_id", "frame_id")


def frame_cap(spark, d):
    return _boxes(spark, d).where("frame_id < 100").select("det_id", "video_id", "frame_id")


def frame_spine(spark, d):
    return B.frame_spine(load(spark, d, "frames"), _distinct(spark, d)).select("video_id", "frame_id", F.coalesce("det_id", F.lit(-1)).alias("det_id"), F.coalesce("det_ord", F.lit(-1)).alias("det_ord"))


def frame_mean_area(spark, d):
    return _rounded(B.frame_means(_distinct(spark, d)).select("video_id", "frame_id", "mean_area"), "mean_area")


def frame_mean_center(spark, d):
    return B.frame_means(_distinct(spark, d)).select("video_id", "frame_id", "poi_x", "poi_y")


def locf_interest(spark, d):
    return _rounded(B.carried_interests(load(spark, d, "frames"), _distinct(spark, d)), "aoi")


def zoom_from_area(spark, d):
    seen = load(spark, d, "interests").where("aoi is not null and not isnan(aoi)").select("video_id", "frame_id", F.round(zoom_of_area(F.col("aoi")), 6).alias("zoom"))
    return seen.distinct()


def crop_window(spark, d):
    seen = load(spark, d, "interests").distinct()
    return crop.crop_windows(seen.join(load(spark, d, "videos").select("video_id", "width", "height"), "video_id")).drop("zoom")


def crop_plan(spark, d):
    return pipelines.crop_plan(spark, d).drop("zoom")


def sectionize(spark, d):
    return _sections(spark, d)


def section_counts(spark, d):
    counts = sections.section_counts(section_boxes(spark, d))
    return counts.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("video_id", "section_id")})  # -1 stands for all


def sample_frames(spark, d):
    return B.sample_frames(_sections(spark, d))


def sample_centers(spark, d):
    return B.sample_centers(_sections(spark, d))


def sample_occupied(spark, d):
    return B.sample_occupied(_sections(spark, d), _distinct(spark, d))


def section_split(spark, d):
    return B.split_sections(_sections(spark, d))


def _labelled_sections(spark, d):
    stats = _stats(spark, d)
    labels = stats.groupBy("video_id", "section_id").agg(F.transform(F.array_sort(F.collect_list("cluster_id")), cluster_letter).alias("labels"))
    return labels.join(_sections(spark, d), ["video_id", "section_id"])


def artifact_id(spark, d):
    return B.artifact_ids(_labelled_sections(spark, d), load(spark, d, "videos"))


def artifact_id_v1(spark, d):
    return B.artifact_ids(_sections(spark, d).withColumn("labels", F.array().cast("array<string>")), load(spark, d, "videos"), millis=False)


def artifact_distinct(spark, d):
    return load(spark, d, "responses").groupBy("artifact_id").agg(F.min("response_id").alias("first_response"))


def cluster_label(spark, d):
    return _boxes(spark, d).select("cluster_id", cluster_letter(F.col("cluster_id")).alias("box_label")).distinct()


def cluster_features(spark, d):
    columns = ["fx", "fy", "fw", "fh", "ft"]
    return _rounded(clustering.section_features(section_boxes(spark, d), load(spark, d, "videos")).select("det_id", *columns), *columns, digits=6)


def cluster_features_v1(spark, d):
    return clustering.section_features_v1(section_boxes(spark, d))


def small_cluster_cleanup(spark, d):
    return sections.drop_small_clusters(section_boxes(spark, d)).select("det_id", "cluster_id")


def cluster_metadata(spark, d):
    return _rounded(_stats(spark, d), "centroid_x", "centroid_y", "median_size")


def cluster_color(spark, d):
    return sections.colored_clusters(_stats(spark, d), load(spark, d, "palette")).select("video_id", "section_id", "cluster_id", "color_name")


def cluster_metadata_text(spark, d):
    return sections.metadata_text(sections.colored_clusters(_stats(spark, d), load(spark, d, "palette")))


def cluster_metadata_text_v1(spark, d):
    return sections.metadata_text(sections.colored_clusters(_stats(spark, d), load(spark, d, "palette")), "v1")


def cluster_metadata_text_v2(spark, d):
    return sections.metadata_text(sections.colored_clusters(_stats(spark, d), load(spark, d, "palette")), "v2")


def shuffled_color(spark, d):
    """The picture of a section is stood in for by its artifact id, since the tables hold none."""
    ids = artifact_id(spark, d).select("video_id", "section_id", F.encode("artifact_id", "UTF-8").alias("image"))
    return sections.shuffled_colors(_stats(spark, d), load(spark, d, "palette"), ids).select("video_id", "section_id", "cluster_id", "color_name")


def detection_label(spark, d):
    letter = F.when(F.col("cluster_id") >= 0, F.concat(F.lit(" ["), cluster_letter(F.col("cluster_id")), F.lit("]"))).otherwise("")
    return _boxes(spark, d).select("det_id", F.concat(F.format_string("%.3f", "confidence"), letter).alias("label"))


def cluster_interval_overlap(spark, d):
    return sections.interval_overlaps(_stats(spark, d))


def section_overlaps(spark, d):
    return sections.section_overlaps(_stats(spark, d))


def overlap_topk(spark, d):
    return sections.overlap_ranking(sections.interval_overlaps(_stats(spark, d)))


def zone_build(spark, d):
    return _rounded(sections.zones(section_boxes(spark, d)), "min_area", "max_area", digits=3)


def _zones(spark, d):
    """The zone of the last cluster of each section."""
    boxes = section_boxes(spark, d).where("cluster_id <> -1")
    last = boxes.groupBy("video_id", "section_id").agg(F.max("cluster_id").alias("cluster_id"))
    return sections.zones(boxes.join(last, ["video_id", "section_id", "cluster_id"], "left_semi"))


def ignore_zone_antijoin(spark, d):
    return sections.outside_earlier_zones(section_boxes(spark, d), _zones(spark, d)).select("det_id")


def mask_antijoin(spark, d):
    """The mask is every pixel on which the center of a box of class 2 lies; all boxes are held against it."""
    mask = _boxes(spark, d).where("class_id = 2").select(F.expr("cast((x1 + x2) / 2 as long)").alias("x"), F.expr("cast((y1 + y2) / 2 as long)").alias("y"))
    return sections.outside_mask(_distinct(spark, d), mask).select("det_id")


def vlm_parse(spark, d):
    return labelling.label_rows(load(spark, d, "responses"))


def vlm_join(spark, d):
    asked = labelling.truth_labels(load(spark, d, "area_labels")).select("artifact_id").distinct()
    joined = asked.join(labelling.latest_labels(load(spark, d, "responses")), "artifact_id", "left")
    return joined.select("artifact_id", F.coalesce("label", F.lit("")).alias("label"), F.coalesce(F.col("is_primary").cast("string"), F.lit("")).alias("is_primary"))


def vlm_cache_miss(spark, d):
    return labelling.cache_misses(load(spark, d, "responses"), load(spark, d, "responses"))


def parse_ground_truth(spark, d):
    return labelling.truth_labels(load(spark, d, "area_labels"))


def score_artifacts(spark, d):
    return labelling.artifact_scores(labelling.truth_labels(load(spark, d, "area_labels")), labelling.latest_labels(load(spark, d, "responses")))


def score_overall(spark, d):
    return labelling.overall_score(load(spark, d, "responses"), score_artifacts(spark, d))


def letter_bias(spark, d):
    return labelling.letter_bias(labelling.label_rows(load(spark, d, "responses")))


def color_bias(spark, d):
    return labelling.color_bias(labelling.label_rows(load(spark, d, "responses")), load(spark, d, "responses"))


def eps_neighbors(spark, d):
    at = clustering.static_points(_distinct(spark, d), load(spark, d, "videos"), 250)
    places = at.groupBy("video_id", "px", "py").agg(F.count("*").alias("n"), F.min("det_id").alias("p"))
    return clustering.eps_neighbors(places, clustering.STATIC_EPS * clustering.PIXELS_PER_UNIT).groupBy("video_id", F.col("a").alias("p")).agg(F.sum("n_b").alias("neighbors"))


def dbscan_play(spark, d):
    return clustering.cluster_sections(section_boxes(spark, d), load(spark, d, "videos"))


def dbscan_static(spark, d):
    return clustering.cluster_videos(_distinct(spark, d), load(spark, d, "videos"))


def declustered_boxes(spark, d):
    return pipelines.declustered(_distinct(spark, d), load(spark, d, "videos")).select("det_id")


def relevant_boxes(spark, d):
    return pipelines.relevant_boxes(spark, d).select("det_id", "video_id", "section_id", "cluster_id")


def merge_clusters(spark, d):
    return clustering.merge_clusters(_distinct(spark, d))


def nms_tiles(spark, d):
    return clustering.suppress_tiles(_distinct(spark, d))


def _area_series(spark, d):
    filled = B.carried_interests(load(spark, d, "frames"), _distinct(spark, d))
    return filled.select("video_id", F.col("frame_id").alias("place"), F.col("poi_x").cast("double").alias("poi_x"), F.col("poi_y").cast("double").alias("poi_y"), F.col("aoi").alias("aoi"))


def gaussian_smooth(spark, d):
    columns = ["poi_x", "poi_y", "aoi"]
    return _rounded(smoothing.smooth(_area_series(spark, d), "video_id", columns, smoothing.gaussian_kernel()), *columns, digits=3)


def gaussian_smooth_int(spark, d):
    return smoothing.smooth(_area_series(spark, d), "video_id", ["poi_x", "poi_y", "aoi"], smoothing.gaussian_kernel(), whole_numbers=True)


def skewed_smooth(spark, d):
    return _rounded(smoothing.smooth(_area_series(spark, d), "video_id", ["aoi"], smoothing.skewed_kernel()), "aoi", digits=3)


def joint_smooth(spark, d):
    series = _area_series(spark, d).withColumnRenamed("place", "frame_id").join(load(spark, d, "videos").select("video_id", "video_name"), "video_id")
    joint = smoothing.joint_places(series, ["video_name", "video_id", "frame_id"]).withColumn("all", F.lit(0))
    smooth = smoothing.smooth(joint.select("all", "place", "poi_x", "poi_y", "aoi"), "all", ["poi_x", "poi_y", "aoi"], smoothing.gaussian_kernel())
    back = joint.select("place", "video_id", "frame_id").join(smooth.drop("all"), "place").drop("place")
    return _rounded(back, "poi_x", "poi_y", "aoi", digits=3)


def _packed(spark, d):
    return tracking.packed_frames(load(spark, d, "frames"), _distinct(spark, d))


def spline_chunks(spark, d):
    return tracking.chunk_bounds(_packed(spark, d))


def greedy_select(spark, d):
    return tracking.greedy_track(_packed(spark, d))


def interest_track(spark, d):
    return tracking.interest_track(_packed(spark, d))


def spline_track(spark, d):
    return _rounded(tracking.spline_track(_packed(spark, d)), "poi_x", "poi_y", digits=3)


def tile_merge(spark, d):
    """Boxes cut into tiles and put back: the part of each box in each tile, shifted to the tile and back, and parts merged
    into the boxes around them."""
    held = _distinct(spark, d).join(load(spark, d, "videos").select("video_id", "width", "height"), "video_id")
    parts = crop.cut_by_tiles(held).withColumn("det_id", F.col("det_id") * 10_000 + F.col("tile_no"))  # a part's own id
    return _rounded(clustering.merge_tiles(parts), "x1", "y1", "x2", "y2", "confidence")


def encoded_labels(spark, d):
    return _boxes(spark, d).select("cluster_id", F.base64(F.encode(cluster_letter(F.col("cluster_id")), "UTF-8")).alias("encoded"), F.sha2(F.col("cluster_id").cast("string"), 256).alias("digest"), F.md5(F.col("cluster_id").cast("string")).alias("check")).distinct()


def heatmap_poi(spark, d):
    # by frame from the beginning: one shuffle of the detections instead of one for repeated rows and one for frames
    detections = load(spark, d, "detections").repartition("video_id", "frame_id")
    return tracking.heatmap_track(tracking.packed_frames(load(spark, d, "frames"), B.distinct_boxes(detections)))


def heatmap_disc(spark, d):
    return tracking.heatmap_track(_packed(spark, d), levels=4096, stamp="disc", influence=4.0)


def heatmap_argmax(spark, d):
    """The fullest cell of 100 pixels of each video, the first by row and column of equals."""
    cells = _distinct(spark, d).groupBy("video_id", F.expr("cast((y1 + y2) / 200 as long)").alias("row"), F.expr("cast((x1 + x2) / 200 as long)").alias("col")).agg(F.count("*").alias("n"))
    best = cells.groupBy("video_id").agg(F.max(F.struct("n", (-F.col("row")).alias("r"), (-F.col("col")).alias("c"))).alias("m"))
    return best.select("video_id", (-F.col("m.r")).alias("row"), (-F.col("m.c")).alias("col"), F.col("m.n").alias("n"))


def kalman_track(spark, d):
    return _rounded(tracking.kalman_track(_packed(spark, d)), "x", "y", "vx", "vy", digits=3)


def cluster_heading(spark, d):
    return _rounded(tracking.cluster_headings(section_boxes(spark, d)), "heading")


def label_placement(spark, d):
    return sections.label_places(section_boxes(spark, d), load(spark, d, "videos"))


def tile_boxes(spark, d):
    return crop.tile_boxes(load(spark, d, "videos").select("width", "height").distinct())


def stream_section_counts(spark, d):
    counts = stream.section_counts(stream.read_stream(spark, d, "detections"), load(spark, d, "videos"))
    return stream.run_complete(counts, shared_place(spark))


QUERIES = {
    f.__name__: f
    for f in (
        scan_detections, frame_pack_unpack, frame_count, box_geometry, box_center_int, conf_filter, declustered_filter, frame_cap, frame_spine, frame_mean_area,
        frame_mean_center, locf_interest, zoom_from_area, crop_window, crop_plan, sectionize, section_counts, sample_frames, sample_centers, sample_occupied,
        section_split, artifact_id, artifact_id_v1, artifact_distinct, cluster_label, cluster_features, cluster_features_v1, small_cluster_cleanup, cluster_metadata,
        cluster_color, cluster_metadata_text, detection_label, cluster_interval_overlap, section_overlaps, overlap_topk, zone_build, ignore_zone_antijoin,
        mask_antijoin, vlm_parse, vlm_join, vlm_cache_miss, parse_ground_truth, score_artifacts, score_overall, letter_bias, color_bias, eps_neighbors, dbscan_play,
        dbscan_static, declustered_boxes, relevant_boxes, merge_clusters, nms_tiles, gaussian_smooth, gaussian_smooth_int, skewed_smooth, joint_smooth, spline_chunks,
        greedy_select, interest_track, heatmap_poi, heatmap_argmax, kalman_track, cluster_heading, label_placement, tile_boxes,
        stream_section_counts, spline_track, tile_merge, encoded_labels, cluster_metadata_text_v1, cluster_metadata_text_v2, shuffled_color, heatmap_disc,
    )
}
