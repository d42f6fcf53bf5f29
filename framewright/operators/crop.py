"""Crop windows around the point of interest, and tiles of an image."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions.columns import whole, zoom_of_area

RENDER_WIDTH, RENDER_HEIGHT = 1280, 720


def crop_windows(points: DataFrame, left: int = 0, right: int = 0, top: int = 0, bottom: int = 0) -> DataFrame:
    """(video_id, frame_id, zoom, x1, y1, x2, y2) of rows with poi_x, poi_y, aoi, width and height.

    Half sizes are cut to whole pixels, the rest goes to the far side; of two limits that conflict the upper
    one wins. Rows without a point or area (null or NaN) have no window; points far outside the picture are clamped like any other.
    """
    z = F.col("zoom")
    inside = lambda v: whole(F.greatest(F.least(v, F.lit(1e9)), F.lit(-1e9)))  # noqa: E731  # beyond any picture
    padded = points.where("poi_x is not null and poi_y is not null and aoi is not null and not isnan(poi_x) and not isnan(poi_y) and not isnan(aoi)").withColumn("zoom", zoom_of_area(F.col("aoi"))).select(
        "video_id", "frame_id", "zoom", "width", "height", inside(F.col("poi_x")).alias("px"), inside(F.col("poi_y")).alias("py"),
        whole(RENDER_WIDTH / z / 2).alias("pl"), whole(RENDER_HEIGHT / z / 2).alias("pt"),
    ).withColumn("pr", whole(RENDER_WIDTH / z - F.col("pl"))).withColumn("pb", whole(RENDER_HEIGHT / z - F.col("pt")))
    x = F.least(F.col("width") - F.col("pr") - right, F.greatest(F.col("pl") + left, F.col("px")))
    y = F.least(F.col("height") - F.col("pb") - bottom, F.greatest(F.col("pt") + top, F.col("py")))
    held = padded.withColumn("x", x).withColumn("y", y)
    return held.select("video_id", "frame_id", F.round("zoom", 6).alias("zoom"), (F.col("x") - F.col("pl")).alias("x1"), (F.col("y") - F.col("pt")).alias("y1"), (F.col("x") + F.col("pr")).alias("x2"), (F.col("y") + F.col("pb")).alias("y2"))


def tile_boxes(images: DataFrame, size: int = 640, overlap: float = 0.2) -> DataFrame:
    """(…, tile_no, x1, y1, x2, y2): overlapping tiles that cover an image of (width, height), row by row; the last
    of a row or column is drawn back to the edge, an image smaller than a tile is one."""
    step = size - int(overlap * size)
    count = lambda side: F.greatest(F.ceil((F.col(side) - size) / step), F.lit(0)).cast("int") + 1
    rows = images.select("*", count("width").alias("nx"), F.explode(F.sequence(F.lit(0), count("height") - 1)).alias("r")).select("*", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("c"))
    low = lambda i, side: F.greatest(F.least(F.col(i) * step, F.col(side) - size), F.lit(0))
    placed = rows.select("*", low("c", "width").alias("x1"), low("r", "height").alias("y1"))
    return placed.select("width", "height", (F.col("r") * F.col("nx") + F.col("c")).alias("tile_no"), "x1", "y1", F.least(F.col("x1") + size, "width").alias("x2"), F.least(F.col("y1") + size, "height").alias("y2"))


def to_image(boxes: DataFrame, left: str, top: str) -> DataFrame:
    """Boxes of a tile shifted to their place in the image."""
    return boxes.withColumns({"x1": F.col("x1") + F.col(left), "x2": F.col("x2") + F.col(left), "y1": F.col("y1") + F.col(top), "y2": F.col("y2") + F.col(top)})


def cut_by_tiles(boxes: DataFrame, size: int = 640, overlap: float = 0.2) -> DataFrame:
    """(…, tile_no, x1, y1, x2, y2) of boxes with width and height of their image: the part of each box in each tile
    that it reaches into, as ``tile_boxes`` lays the tiles out.

    The tiles of a box are found by arithmetic, so no box is held against all of them.
    """
    step = size - int(overlap * size)
    count = lambda side: F.greatest(F.ceil((F.col(side) - size) / step), F.lit(0)).cast("int") + 1
    span = lambda lo, hi, side: F.explode(F.sequence(F.least(F.greatest(F.floor((F.col(lo) - size) / step), F.lit(0)).cast("int"), count(side) - 1), F.least(F.greatest(F.floor(F.col(hi) / step).cast("int") + 1, F.lit(0)), count(side) - 1)))
    low = lambda i, side: F.greatest(F.least(F.col(i) * step, F.col(side) - size), F.lit(0))
    held = boxes.withColumn("_r", span("y1", "y2", "height")).withColumn("_c", span("x1", "x2", "width"))
    held = held.withColumn("_l", low("_c", "width")).withColumn("_t", low("_r", "height"))
    part = held.withColumns({
        "tile_no": F.col("_r") * count("width") + F.col("_c"),
        "x1": F.greatest("x1", "_l"), "y1": F.greatest("y1", "_t"),
        "x2": F.least("x2", F.least(F.col("_l") + size, "width")), "y2": F.least("y2", F.least(F.col("_t") + size, "height")),
    })
    return part.where("x2 > x1 and y2 > y1").drop("_r", "_c", "_l", "_t")
