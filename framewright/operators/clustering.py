"""Density clustering of detections: within sections (``play``) and over whole videos (``static``), and its features.

Labels are numbered by the first core box of each cluster in order of (frame_id, det_ord); a border box belongs
to the lowest-numbered cluster it reaches; -1 is noise.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.columns import area, center_x, center_y
from framewright.operators.graph import components
from framewright.session import cut

PLAY_EPS, PLAY_SAMPLES, TEMPORAL_FACTOR = 0.25, 5, 1.4
STATIC_EPS, STATIC_SAMPLES = 0.02, 300
PIXELS_PER_UNIT = 1_000_000  #: normalised coordinates are compared as whole millionths


def dbscan(points: np.ndarray, eps: float, min_samples: int) -> np.ndarray:
    """Labels of points in their order; neighbours are looked up in a grid over the first two coordinates."""
    n = len(points)
    if n < 2:
        return np.full(n, -1)
    cell = np.floor(points[:, :2] / eps).astype(np.int64)
    cell -= cell.min(axis=0)
    code = cell[:, 0] * (cell[:, 1].max() + 3) + cell[:, 1]
    width = cell[:, 1].max() + 3
    order = np.argsort(code, kind="stable")
    sorted_code = code[order]
    near: list[np.ndarray] = []
    for i in range(n):
        parts = []
        for dx in (-1, 0, 1):
            at = code[i] + dx * width
            parts.append(order[np.searchsorted(sorted_code, at - 1) : np.searchsorted(sorted_code, at + 1, side="right")])
        around = np.concatenate(parts)
        near.append(around[((points[around] - points[i]) ** 2).sum(axis=1) <= eps * eps * (1 + 1e-12)])
    core = np.array([len(x) >= min_samples for x in near])
    label = np.full(n, -1)
    number = 0
    for i in range(n):
        if not core[i] or label[i] >= 0:
            continue
        label[i], todo = number, [i]
        while todo:
            for j in near[todo.pop()]:
                if label[j] < 0:
                    label[j] = number
                    if core[j]:
                        todo.append(j)
        number += 1
    return label


def section_features(boxes: DataFrame, videos: DataFrame, temporal: float = TEMPORAL_FACTOR, spatial: float = 1.0) -> DataFrame:
    """The boxes with centers and sizes as shares of the picture (fx, fy, fw, fh) times ``spatial`` and ``ft``, the frame
    scaled to the range of the section's boxes (0 if they are of one frame) times ``temporal``."""
    span = boxes.groupBy("video_id", "section_id").agg(F.min("frame_id").alias("lo"), F.max("frame_id").alias("hi"))
    rows = boxes.join(span, ["video_id", "section_id"]).join(videos.select("video_id", "width", "height"), "video_id")
    ft = F.when(F.col("hi") > F.col("lo"), (F.col("frame_id") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0) * temporal
    part = lambda value, side, name: (value / F.col(side) if spatial == 1 else value / F.col(side) * spatial).alias(name)
    return rows.select(
        *boxes.columns, part(center_x(), "width", "fx"), part(center_y(), "height", "fy"),
        part(F.col("x2") - F.col("x1"), "width", "fw"), part(F.col("y2") - F.col("y1"), "height", "fh"), ft.alias("ft"),
    )


def section_features_v1(boxes: DataFrame) -> DataFrame:
    """The first feature set: standardised center and area, and the frame scaled to -2..2; what does not vary is 0."""
    v = {"zx": center_x(), "zy": center_y(), "za": area()}
    rows = boxes.select("det_id", "video_id", "section_id", "frame_id", *[e.alias(k) for k, e in v.items()])
    facts = [f(k).alias(f"{n}_{k}") for k in v for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))]
    spread = rows.groupBy("video_id", "section_id").agg(F.min("frame_id").alias("lo"), F.max("frame_id").alias("hi"), *facts)
    joined = rows.join(spread, ["video_id", "section_id"])
    z = [F.round(F.when(F.col(f"s_{k}") > 1e-9, (F.col(k) - F.col(f"m_{k}")) / F.col(f"s_{k}")).otherwise(0.0), 4).alias(k) for k in v]
    ft = F.when(F.col("hi") > F.col("lo"), (F.col("frame_id") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0) * 4 - 2
    return joined.select("det_id", *z, F.round(ft, 6).alias("ft"))


def cluster_sections(boxes: DataFrame, videos: DataFrame, eps: float = PLAY_EPS, min_samples: int = PLAY_SAMPLES, temporal: float = TEMPORAL_FACTOR, spatial: float = 1.0) -> DataFrame:
    """(det_id, video_id, section_id, label): ``play`` clustering. A section spans few seconds, so a group is small."""
    columns = ["fx", "fy", "fw", "fh", "ft"]
    features = section_features(boxes, videos, temporal, spatial).select("det_id", "video_id", "section_id", "frame_id", "det_ord", *columns)

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["frame_id", "det_ord", "det_id"], kind="stable")
        return rows[["det_id", "video_id", "section_id"]].assign(label=dbscan(rows[columns].to_numpy(), eps, min_samples).astype("int32"))

    return features.groupBy("video_id", "section_id").applyInPandas(lambda rows: cluster(rows), "det_id long, video_id int, section_id long, label int")


def eps_neighbors(points: DataFrame, eps: float) -> DataFrame:
    """(video_id, a, b, n_b): for each distinct point the points within ``eps``, itself included, with their counts.

    ``points`` is (video_id, p, px, py, n) with whole-numbered coordinates, distinct by place. Points meet in grid
    cells as wide as ``eps``; a point looks into the nine cells around its own.
    """
    cell = [F.floor(F.col(c) / int(eps)) for c in ("px", "py")]
    held = points.select("*", cell[0].alias("gx"), cell[1].alias("gy"))
    around = F.array(*[F.struct((F.col("gx") + i).alias("gx"), (F.col("gy") + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    asking = held.select("video_id", F.col("p").alias("a"), F.col("px").alias("ax"), F.col("py").alias("ay"), F.explode(around).alias("g")).select("video_id", "a", "ax", "ay", "g.*")
    other = held.select("video_id", "gx", "gy", F.col("p").alias("b"), F.col("px").alias("bx"), F.col("py").alias("by"), F.col("n").alias("n_b"))
    near = asking.join(other, ["video_id", "gx", "gy"])
    return near.where((F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by")) <= int(eps) * int(eps)).select("video_id", "a", "b", "n_b")


def static_points(boxes: DataFrame, videos: DataFrame, resolution: int) -> DataFrame:
    """Box centers as shares of the picture in millionths, rounded to ``resolution``, each place once with its count."""
    unit = lambda c, side: (F.round(c / F.col(side) * PIXELS_PER_UNIT / resolution) * resolution).cast("long")
    at = boxes.join(videos.select("video_id", "width", "height"), "video_id").select("video_id", "det_id", "frame_id", "det_ord", unit(center_x(), "width").alias("px"), unit(center_y(), "height").alias("py"))
    return at.withColumn("rank", F.struct("frame_id", "det_ord", "det_id"))


def _near(side: DataFrame, cells: DataFrame, squared: int) -> DataFrame:
    """(…, sure): each row of ``side`` (video_id, px, py, gx, gy, …) with every cell at most two away that holds points
    within the distance, ``sure`` if all its points are; otherwise that hangs on the points."""
    around = F.explode(F.array(*[F.struct((F.col("gx") + i).alias("hx"), (F.col("gy") + j).alias("hy")) for i in range(-2, 3) for j in range(-2, 3)])).alias("h")
    asking = side.select("*", around).select("*", "h.*").drop("h", "gx", "gy")
    met = asking.join(cells.withColumnsRenamed({"gx": "hx", "gy": "hy"}), ["video_id", "hx", "hy"])
    off = lambda c: F.greatest(F.col(f"lo_{c}") - F.col(f"p{c}"), F.col(f"p{c}") - F.col(f"hi_{c}"), F.lit(0))
    far = lambda c: F.greatest(F.col(f"hi_{c}") - F.col(f"p{c}"), F.col(f"p{c}") - F.col(f"lo_{c}"))
    return met.where(off("x") * off("x") + off("y") * off("y") <= squared).withColumn("sure", far("x") * far("x") + far("y") * far("y") <= squared)


def _within(a: str, b: str, squared: int) -> Column:
    dx, dy = F.col(f"{a}x") - F.col(f"{b}x"), F.col(f"{a}y") - F.col(f"{b}y")
    return dx * dx + dy * dy <= squared


def cluster_videos(boxes: DataFrame, videos: DataFrame, eps: float = STATIC_EPS, min_samples: int = STATIC_SAMPLES, resolution: int = 250) -> DataFrame:
    """(det_id, label): ``static`` clustering of whole videos by center.

    Centers are rounded to ``resolution`` millionths of the picture (half a pixel at 1920; 1 is the exact way) and
    counted by place before anything is compared, so a static object of any number of boxes is a few places. Places
    lie in cells of eps / sqrt 2, within which all are neighbours: a cell with ``min_samples`` boxes is core as a
    whole. Places of other cells are held against the extents of the cells around them, and against single places
    only where those leave it open; so are pairs of core cells, unless they are already of one cluster. No pairs of
    neighbours are stored, and no task holds a video.
    """
    squared = int(eps * PIXELS_PER_UNIT) ** 2
    side = int(eps * PIXELS_PER_UNIT / 2**0.5)
    cell, at_cell = ["video_id", "gx", "gy"], [F.floor(F.col(f"p{c}") / side).alias(f"g{c}") for c in "xy"]
    extents = [f(f"p{c}").alias(f"{k}_{c}") for c in "xy" for k, f in (("lo", F.min), ("hi", F.max))]
    at = cut(static_points(boxes, videos, resolution))
    places = at.groupBy("video_id", "px", "py").agg(F.count("*").alias("n"), F.min("rank").alias("rank"))
    places = cut(places.select("*", *at_cell))
    cells = cut(places.groupBy(*cell).agg(F.sum("n").alias("boxes"), *extents))
    held = places.join(cells.select(*cell, "boxes"), cell)
    sparse = held.where(F.col("boxes") < min_samples).select(*cell, "px", "py", "rank")
    points = places.select("video_id", F.col("gx").alias("hx"), F.col("gy").alias("hy"), F.col("px").alias("qx"), F.col("py").alias("qy"), "n")
    around = F.explode(F.array(*[F.struct((F.col("gx") + i).alias("gx"), (F.col("gy") + j).alias("gy")) for i in range(-2, 3) for j in range(-2, 3)])).alias("h")
    spread = lambda df, *more: df.select("video_id", *more, around).select("video_id", *more, "h.*")  # noqa: E731  # over the cells that can hold a neighbour
    busy = spread(cells, "boxes").groupBy(*cell).agg(F.sum("boxes").alias("boxes")).where(F.col("boxes") >= min_samples).select(*cell)
    asked = sparse.join(busy, cell, "left_semi")
    seen = _near(asked, cells, squared).select("video_id", "px", "py", "hx", "hy", "boxes", "sure")
    single = seen.where("not sure").join(points, ["video_id", "hx", "hy"]).where(_within("p", "q", squared)).select("video_id", "px", "py", "n")
    counts = seen.where("sure").select("video_id", "px", "py", F.col("boxes").alias("n")).unionByName(single).groupBy("video_id", "px", "py").agg(F.sum("n").alias("n"))
    crowded = cut(counts.where(F.col("n") >= min_samples).select("video_id", "px", "py"))
    core = cut(held.where(F.col("boxes") >= min_samples).select(*cell, "px", "py", "rank").unionByName(asked.join(crowded, ["video_id", "px", "py"], "left_semi")))
    nodes = cut(core.groupBy(*cell).agg(F.min("rank").alias("rank"), *extents).withColumn("node", F.col("rank.det_id")))
    # pairs of core cells, each once
    half = F.explode(F.array(*[F.struct((F.col("gx") + i).alias("hx"), (F.col("gy") + j).alias("hy")) for i in range(3) for j in range(-2, 3) if i or j > 0])).alias("h")
    mine = nodes.select("video_id", "gx", "gy", F.col("node").alias("a"), *[F.col(f"{k}_{c}").alias(f"a{k}_{c}") for k in ("lo", "hi") for c in "xy"], half).select("*", "h.*").drop("h")
    yours = nodes.select("video_id", F.col("gx").alias("hx"), F.col("gy").alias("hy"), F.col("node").alias("b"), *[F.col(f"{k}_{c}").alias(f"b{k}_{c}") for k in ("lo", "hi") for c in "xy"])
    gap = lambda c: F.greatest(F.col(f"blo_{c}") - F.col(f"ahi_{c}"), F.col(f"alo_{c}") - F.col(f"bhi_{c}"), F.lit(0))
    span = lambda c: F.greatest(F.col(f"bhi_{c}") - F.col(f"alo_{c}"), F.col(f"ahi_{c}") - F.col(f"blo_{c}"))
    met = mine.join(yours, ["video_id", "hx", "hy"]).where(gap("x") * gap("x") + gap("y") * gap("y") <= squared)
    met = cut(met.select("video_id", "gx", "gy", "hx", "hy", "a", "b", (span("x") * span("x") + span("y") * span("y") <= squared).alias("sure")))
    roots = cut(components(met.where("sure").select("video_id", "a", "b"), nodes.select("video_id", "node")))
    of = lambda s: roots.select("video_id", F.col("node").alias(s), F.col("root").alias(f"r{s}"))
    unsure = met.where("not sure").join(of("a"), ["video_id", "a"]).join(of("b"), ["video_id", "b"]).where("ra <> rb").select("video_id", "gx", "gy", "hx", "hy", "ra", "rb")
    left = core.select("video_id", "gx", "gy", "px", "py")
    right = core.select("video_id", F.col("gx").alias("hx"), F.col("gy").alias("hy"), F.col("px").alias("qx"), F.col("py").alias("qy"))
    touching = unsure.join(left, cell).join(right, ["video_id", "hx", "hy"]).where(_within("p", "q", squared)).select("video_id", F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
    touching = cut(touching)
    whole = roots.withColumnRenamed("root", "cluster")
    if not touching.isEmpty():
        joined = components(touching, roots.select("video_id", F.col("root").alias("node")).distinct())
        whole = roots.join(joined.select("video_id", F.col("node").alias("root"), F.col("root").alias("cluster")), ["video_id", "root"]).select("video_id", "node", "cluster")
    known = nodes.join(whole, ["video_id", "node"])
    first = known.groupBy("video_id", "cluster").agg(F.min("rank").alias("rank"))
    numbered = first.select("video_id", "cluster", (F.row_number().over(Window.partitionBy("video_id").orderBy("rank")) - 1).cast("int").alias("label"))
    labelled = cut(known.join(numbered, ["video_id", "cluster"]).select(*cell, "label", "lo_x", "hi_x", "lo_y", "hi_y"))
    inner = core.join(labelled.select(*cell, "label"), cell).select("video_id", "px", "py", "label")
    rest = sparse.join(spread(nodes).distinct(), cell, "left_semi").join(crowded, ["video_id", "px", "py"], "left_anti").select(*cell, "px", "py")
    reached = _near(rest, labelled, squared).select("video_id", "px", "py", "hx", "hy", "label", "sure")
    one = reached.where("not sure").join(right, ["video_id", "hx", "hy"]).where(_within("p", "q", squared)).select("video_id", "px", "py", "label")
    border = reached.where("sure").select("video_id", "px", "py", "label").unionByName(one).groupBy("video_id", "px", "py").agg(F.min("label").alias("label"))
    return at.join(inner.unionByName(border), ["video_id", "px", "py"], "left").select("det_id", F.coalesce("label", F.lit(-1)).alias("label"))


def merge_clusters(boxes: DataFrame) -> DataFrame:
    """(video_id, frame_id, merged): a frame's clustered boxes, by cluster and then in their own order."""
    b = F.struct("cluster_id", "det_ord", "det_id")
    return boxes.where("cluster_id <> -1").groupBy("video_id", "frame_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(b)), lambda x: x["det_id"].cast("string")), ",").alias("merged"))


def suppress_tiles(boxes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(det_id, kept_by): greedy merging of a frame's boxes of one class by intersection over the smaller area.

    Boxes are taken by falling confidence (ties by det_ord); a later box whose match with a kept one exceeds
    ``threshold`` is merged into the first such. Frames are packed to arrays, so no group is set up for each.
    """
    box = F.struct((-F.col("confidence")).alias("c"), "det_ord", "det_id", "class_id", F.array("x1", "y1", "x2", "y2").alias("xy"))
    packed = boxes.groupBy("video_id", "frame_id").agg(F.array_sort(F.collect_list(box)).alias("b")).select(F.transform("b", lambda x: x["det_id"]).alias("ids"), F.transform("b", lambda x: x["class_id"]).alias("classes"), F.flatten(F.transform("b", lambda x: x["xy"])).alias("xy"))

    def merge(batches):
        for batch in batches:
            ids_out, by_out = [], []
            for ids, cls, flat in zip(batch["ids"], batch["classes"], batch["xy"]):
                xy = np.asarray(flat, float).reshape(-1, 4)
                size = (xy[:, 2] - xy[:, 0]) * (xy[:, 3] - xy[:, 1])
                kept = np.zeros(0, int)
                for i in range(len(ids)):
                    w = np.minimum(xy[i, 2], xy[kept, 2]) - np.maximum(xy[i, 0], xy[kept, 0])
                    h = np.minimum(xy[i, 3], xy[kept, 3]) - np.maximum(xy[i, 1], xy[kept, 1])
                    hit = np.flatnonzero((cls[kept] == cls[i]) & (w > 0) & (h > 0) & (w * h > threshold * np.minimum(size[i], size[kept])))
                    ids_out.append(ids[i])
                    if len(hit):
                        by_out.append(ids[kept[hit[0]]])
                    else:
                        kept = np.append(kept, i)
                        by_out.append(ids[i])
            yield pd.DataFrame({"det_id": ids_out, "kept_by": by_out}, dtype="int64")

    return packed.mapInPandas(merge, "det_id long, kept_by long")


def merge_tiles(boxes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(det_id, video_id, frame_id, x1, y1, x2, y2, confidence, class_id, n_merged): each kept box of ``suppress_tiles``
    as the box around all that were merged into it, with their greatest confidence."""
    kept = boxes.join(suppress_tiles(boxes, threshold), "det_id")
    around = [f(c).alias(c) for c, f in (("x1", F.min), ("y1", F.min), ("x2", F.max), ("y2", F.max), ("confidence", F.max), ("class_id", F.min))]
    return kept.groupBy(F.col("kept_by").alias("det_id"), "video_id", "frame_id").agg(*around, F.count("*").alias("n_merged"))
