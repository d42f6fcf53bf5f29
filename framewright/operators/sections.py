"""Clusters within sections: statistics, intervals, overlaps, zones and what zones remove."""

from __future__ import annotations

import hashlib
import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.columns import area, center_x, center_y, cluster_letter, whole

CLUSTER = ["video_id", "section_id", "cluster_id"]
MIN_FRAMES = 15  #: shortest interval and overlap that count
MIN_SHARE = 0.5  #: overlap against the shorter of the two intervals


def cluster_stats(boxes: DataFrame, fps: int = 30) -> DataFrame:
    """One row per cluster of a section (noise left out): size, mean center and area, first and last frame.

    ``median_size`` is the mean area, as it always was under that name. Frames count from the section's start;
    milliseconds are frame * 1000 div ``fps``. ``boxes`` has section_id and rel_frame.
    """
    ms = lambda c: F.floor(c * 1000 / fps).cast("long")
    return (
        boxes.where("cluster_id <> -1")
        .groupBy(*CLUSTER)
        .agg(F.avg(center_x()).alias("centroid_x"), F.avg(center_y()).alias("centroid_y"), F.avg(area()).alias("median_size"), F.count("*").alias("cluster_size"), F.min("rel_frame").alias("start"), F.max("rel_frame").alias("end"))
        .withColumn("box_label", cluster_letter(F.col("cluster_id")))
        .withColumn("start_ms", ms(F.col("start")))
        .withColumn("end_ms", ms(F.col("end")))
    )


def section_counts(boxes: DataFrame) -> DataFrame:
    """Boxes and clustered boxes per section, per video (section null) and in all (both null)."""
    return boxes.rollup("video_id", "section_id").agg(F.count("*").alias("n_boxes"), F.count_if(F.col("cluster_id") != -1).alias("n_clustered"))


def drop_small_clusters(boxes: DataFrame, least: int = 15) -> DataFrame:
    """Clusters of a section with fewer than ``least`` boxes become noise. Sizes are counted before the join, so a
    large cluster is no large task."""
    sizes = boxes.groupBy(*CLUSTER).agg(F.count("*").alias("n"))
    return boxes.join(sizes, CLUSTER).withColumn("cluster_id", F.when(F.col("n") < least, -1).otherwise(F.col("cluster_id"))).drop("n")


def colored_clusters(stats: DataFrame, palette: DataFrame) -> DataFrame:
    """The clusters of a section in order get the colors of the palette in turn."""
    n = palette_size(palette)
    place = stats.withColumn("place", F.row_number().over(Window.partitionBy("video_id", "section_id").orderBy("cluster_id")) - 1)
    turns = place.withColumn("idx", F.pmod("place", F.lit(n)).cast("int"))
    return turns.join(F.broadcast(palette.select("idx", "color_name")), "idx").drop("idx", "place")


def palette_order(n: int, image: bytes, clusters: list[int]) -> list[int]:
    """The order of ``n`` colors that hangs on an image's bytes and a section's clusters: a shuffle by the standard
    generator, seeded with the SHA-256 of the image and the cluster ids modulo 256, modulo 2^32."""
    digest = hashlib.sha256(image + bytes(c % 256 for c in clusters)).hexdigest()
    order = list(range(n))
    random.Random(int(digest, 16) % 2**32).shuffle(order)
    return order


def shuffled_colors(stats: DataFrame, palette: DataFrame, images: DataFrame) -> DataFrame:
    """The clusters of each section with a color in turn from the palette as its image shuffles it.

    ``images`` is (video_id, section_id, image), the first picture of a section; sections without one get the plain
    order. The palette's size is checked (``palette_size``); its colors count by their ``idx``.
    """
    n = palette_size(palette)
    own = stats.groupBy("video_id", "section_id").agg(F.array_sort(F.collect_set("cluster_id")).alias("clusters")).join(images, ["video_id", "section_id"], "left")
    turns = "video_id int, section_id long, cluster_id int, place int"

    def shuffle(batches):
        for batch in batches:
            out = []
            for video, section, clusters, image in zip(batch["video_id"], batch["section_id"], batch["clusters"], batch["image"]):
                ids = [int(c) for c in clusters]
                order = palette_order(n, bytes(image), ids) if isinstance(image, (bytes, bytearray)) else list(range(n))
                out += [(video, section, c, order[i % n]) for i, c in enumerate(ids)]
            yield pd.DataFrame(out, columns=["video_id", "section_id", "cluster_id", "place"])

    ranked = palette.select("color_name", (F.row_number().over(Window.orderBy("idx")) - 1).alias("place"))  # palette_size bounds it
    turned = own.select("video_id", "section_id", "clusters", "image").mapInPandas(shuffle, turns)
    return stats.join(turned, CLUSTER).join(F.broadcast(ranked), "place").drop("place")


def palette_size(palette: DataFrame, limit: int = 1000) -> int:
    """The number of colors; a palette beyond ``limit`` is refused, since it is broadcast."""
    n = palette.limit(limit + 1).count()
    if not 0 < n <= limit:
        raise ValueError(f"a palette has 1 to {limit} colors, not {n}")
    return n


METADATA_HEADS = {
    "v1": "id, centroid x, centroid y, mean detection (square pixels), cluster size, start time, end time, color",
    "v2": "id, cluster size, start time, end time, color",
    "v3": "id, color",
}  #: fixed values: the header lines of the three forms


def metadata_text(colored: DataFrame, version: str = "v3") -> DataFrame:
    """(video_id, section_id, text): a header and the lines of each cluster, by label.

    ``v3`` has one short line, ``v1`` one with the cluster's statistics, ``v2`` a line of sizes and times and then
    that of ``v1``, as it always wrote. Ties are rounded up, so that they do not hang on the order of a sum.
    """
    time = lambda ms: F.format_string("00:%02d.%03d", F.floor(F.col(ms) / 1000), F.col(ms) % 1000)
    nearest = lambda c, parts: F.floor((F.col(c) + 1e-9) * parts + 0.5)
    short = F.concat_ws(", ", "box_label", "color_name")
    lines = [short]
    if version != "v3":
        times = [time("start_ms"), time("end_ms"), F.col("color_name")]
        size = F.col("cluster_size").cast("string")
        full = F.concat_ws(", ", "box_label", nearest("centroid_x", 1).cast("string"), nearest("centroid_y", 1).cast("string"), F.format_string("%.2fsp", nearest("median_size", 100) / 100), size, *times)
        lines = [full] if version == "v1" else [F.concat_ws(", ", "box_label", size, *times), full]
    line = F.struct("cluster_id", F.concat_ws("\n", *lines).alias("line"))
    sorted_lines = F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"])
    return colored.groupBy("video_id", "section_id").agg(F.concat_ws("\n", F.concat(F.array(F.lit(METADATA_HEADS[version])), sorted_lines)).alias("text"))


def interval_overlaps(stats: DataFrame) -> DataFrame:
    """Pairs of clusters of a section whose intervals overlap by half of the shorter and MIN_FRAMES at least.

    The end of an interval is exclusive here. The join is on the section, which holds few clusters.
    """
    side = lambda k: stats.select("video_id", "section_id", F.col("cluster_id").alias(f"cluster_{k}"), F.col("start").alias(f"s{k}"), (F.col("end") + 1).alias(f"e{k}"))
    overlap = F.least("e1", "e2") - F.greatest("s1", "s2")
    shorter = F.least(F.col("e1") - F.col("s1"), F.col("e2") - F.col("s2"))
    pairs = side(1).join(side(2), ["video_id", "section_id"]).where("cluster_1 < cluster_2 and s1 < e2 and e1 > s2").withColumn("overlap", overlap)
    return pairs.where((F.col("overlap") >= shorter * MIN_SHARE) & (shorter >= MIN_FRAMES) & (F.col("overlap") >= MIN_FRAMES)).select("video_id", "section_id", "cluster_1", "cluster_2", "overlap")


def section_overlaps(stats: DataFrame) -> DataFrame:
    """Sections with more than one cluster: all their clusters as one group."""
    return stats.groupBy("video_id", "section_id").agg(F.array_sort(F.collect_set("cluster_id")).alias("c")).where("size(c) > 1").select("video_id", "section_id", F.size("c").alias("n_clusters"), F.array_join("c", "_").alias("clusters"))


def overlap_ranking(overlaps: DataFrame, k: int = 20) -> DataFrame:
    """The k sections with the largest total overlap; a top-k report, ties by video and section."""
    total = overlaps.groupBy("video_id", "section_id").agg(F.sum("overlap").alias("total_overlap"))
    return total.orderBy(F.col("total_overlap").desc(), "video_id", "section_id").limit(k)


def zones(boxes: DataFrame) -> DataFrame:
    """(…, x_lo, x_hi, y_lo, y_hi, min_area, max_area): the zone of each cluster of a section.

    Boxes beyond two population deviations of the mean in center or area are trimmed; the zone spans the whole
    pixels of the centers that are left, its areas are the mean plus and minus two deviations.
    """
    v = {"cx": center_x(), "cy": center_y(), "ar": area()}
    rows = boxes.where("cluster_id <> -1").select(*CLUSTER, *[e.alias(k) for k, e in v.items()])
    spread = rows.groupBy(*CLUSTER).agg(*[f(k).alias(f"{n}_{k}") for k in v for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))])
    kept = rows.join(spread, CLUSTER)
    for k in v:
        kept = kept.where(F.abs(F.col(k) - F.col(f"m_{k}")) <= 2 * F.col(f"s_{k}") + 1e-9)
    return kept.groupBy(*CLUSTER).agg(
        whole(F.min("cx")).alias("x_lo"), whole(F.max("cx")).alias("x_hi"), whole(F.min("cy")).alias("y_lo"), whole(F.max("cy")).alias("y_hi"),
        F.max(F.col("m_ar") - 2 * F.col("s_ar")).alias("min_area"), F.max(F.col("m_ar") + 2 * F.col("s_ar")).alias("max_area"),
    )


ZONE_CELL = 256  #: pixels of the coarse cells that zones and boxes are joined by


def outside_earlier_zones(boxes: DataFrame, zones_: DataFrame) -> DataFrame:
    """The boxes that no zone of an earlier section of their video holds.

    Zones are spread over coarse cells of the picture, and the join is on video and cell with the rest as a
    residual, so a video with very many boxes is spread by place. A null area bound is no bound.
    """
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / ZONE_CELL), F.floor(F.col(hi) / ZONE_CELL)))
    z = zones_.select("video_id", F.col("section_id").alias("z_section"), "x_lo", "x_hi", "y_lo", "y_hi", "min_area", "max_area", span("x_lo", "x_hi").alias("gx")).withColumn("gy", span("y_lo", "y_hi"))
    b = boxes.withColumn("icx", whole(center_x())).withColumn("icy", whole(center_y())).withColumn("_area", area())
    b = b.withColumn("gx", F.floor(F.col("icx") / ZONE_CELL)).withColumn("gy", F.floor(F.col("icy") / ZONE_CELL))
    inside = F.expr("b.video_id = z.video_id and b.gx = z.gx and b.gy = z.gy and z_section < section_id and icx between x_lo and x_hi and icy between y_lo and y_hi and (min_area is null or _area >= min_area) and (max_area is null or _area <= max_area)")
    return b.alias("b").join(z.alias("z"), inside, "left_anti").drop("icx", "icy", "_area", "gx", "gy")


def outside_mask(boxes: DataFrame, mask_pixels: DataFrame) -> DataFrame:
    """The boxes whose whole center is no pixel (x, y) of the mask."""
    b = boxes.withColumn("x", whole(center_x())).withColumn("y", whole(center_y()))
    return b.join(mask_pixels.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).distinct(), ["x", "y"], "left_anti").drop("x", "y")


def label_places(boxes: DataFrame, videos: DataFrame, box_width: int = 60, box_height: int = 40) -> DataFrame:
    """(…, x, y): where a label of the given size goes beside each cluster of a section.

    Candidate places form a grid over the cluster's padded bounds; the one nearest the centroid wins that
    touches no box of the cluster and lies within the picture, else the centroid itself.
    """
    c = boxes.where("cluster_id <> -1").join(videos.select("video_id", "width", "height"), "video_id")
    bounds = c.groupBy(*CLUSTER, "width", "height").agg(
        F.avg(center_x()).alias("mx"), F.avg(center_y()).alias("my"),
        F.greatest(F.min("x1") - box_width, F.lit(0)).alias("l"), F.greatest(F.min("y1") - box_height, F.lit(0)).alias("t"),
        F.least(F.max("x2") + box_width, F.col("width")).alias("r"), F.least(F.max("y2") + box_height, F.col("height")).alias("b"),
    )
    steps = lambda lo, hi, size: F.sequence(whole(F.col(lo)), F.greatest(whole(F.col(hi)) - 1, whole(F.col(lo))), F.lit(size).cast("long"))
    grid = bounds.where("cast(l as long) < cast(r as long) and cast(t as long) < cast(b as long)").select(*CLUSTER, "width", "height", "mx", "my", F.explode(steps("t", "b", box_height)).alias("y"), "l", "r").select("*", F.explode(steps("l", "r", box_width)).alias("x"))
    fits = grid.where(f"x + {box_width} <= width and y + {box_height} <= height")
    taken = fits.alias("g").join(c.alias("c"), F.expr(f"g.video_id = c.video_id and g.section_id = c.section_id and g.cluster_id = c.cluster_id and c.x1 < x + {box_width} and c.x2 > x and c.y1 < y + {box_height} and c.y2 > y"), "left_anti")
    away = F.pow(F.col("x") + box_width / 2 - F.col("mx"), 2) + F.pow(F.col("y") + box_height / 2 - F.col("my"), 2)
    best = taken.groupBy(*CLUSTER).agg(F.min(F.struct(F.round(away, 6).alias("d"), "y", "x")).alias("m"))
    return bounds.join(best, CLUSTER, "left").select(*CLUSTER, F.coalesce("m.x", whole(F.col("mx"))).alias("x"), F.coalesce("m.y", whole(F.col("my"))).alias("y"))
