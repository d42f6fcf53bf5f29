"""Column expressions on boxes, frames and labels; all run inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def center_x() -> Column:
    return (F.col("x1") + F.col("x2")) / 2


def center_y() -> Column:
    return (F.col("y1") + F.col("y2")) / 2


def area() -> Column:
    return (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))


def whole(value: Column) -> Column:
    """The value without its fraction, towards zero."""
    return value.cast("long")


def cluster_letter(cluster: Column) -> Column:
    """0 as A, 1 as B and so on by code point; noise (-1) is '@'."""
    return F.char((cluster + 65).cast("long"))


def clock(frame: Column, fps: Column, millis: bool = True) -> Column:
    """Minutes and seconds of a frame as MM-SS.mmm, or as MM-SS; milliseconds are cut, not rounded."""
    ms = F.floor(frame * 1000 / fps)
    minutes, seconds = F.floor(ms / 60000), F.floor(ms / 1000) % 60
    return F.format_string("%02d-%02d.%03d", minutes, seconds, ms % 1000) if millis else F.format_string("%02d-%02d", minutes, seconds)


def zoom_of_area(aoi: Column, min_area: float = 50.0, max_area: float = 300.0, min_zoom: float = 1.2, max_zoom: float = 2.0) -> Column:
    """Small areas are zoomed in on: linear from ``max_zoom`` at ``min_area`` down to ``min_zoom`` at ``max_area``."""
    clamped = F.greatest(F.least(aoi, F.lit(max_area)), F.lit(min_area))
    return F.lit(max_zoom) - (clamped - min_area) / (max_area - min_area) * (max_zoom - min_zoom)
