"""Sequential per-video folds over frames: greedy choice, interest track, heat map, Kalman track, headings.

A fold's input is repartitioned by video and sorted by frame, and runs as a generator over batches of rows, so a
video of any length passes through a task without being held in it (the Kalman smoother reads the filter's written
estimates backwards in the same way).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.operators import heat
from framewright.session import cut

CHUNK_FRAMES, OVERLAP_FRAMES = 64, 16
PLACEHOLDER = (960.0, 540.0)
PLACEHOLDER_AREA = 100.0
EMPTY_WEIGHT = 1e-10


def packed_frames(frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """(video_id, frame_id, boxes): every frame with the coordinates of its boxes in order, [] where it has none."""
    box = F.struct("det_ord", "det_id", "x1", "y1", "x2", "y2")
    packed = boxes.groupBy("video_id", "frame_id").agg(F.array_sort(F.collect_list(box)).alias("b"))
    flat = F.flatten(F.transform("b", lambda x: F.array(x["x1"], x["y1"], x["x2"], x["y2"])))
    return frames.select("video_id", "frame_id").join(packed, ["video_id", "frame_id"], "left").select("video_id", "frame_id", F.coalesce(flat, F.array().cast("array<double>")).alias("boxes"))


def fold(packed: DataFrame, step: Callable[[], Callable], schema: str, tasks: int | None = None) -> DataFrame:
    """Rows of ``schema`` from a fold over each video's frames in order. ``step()`` begins a video and returns a
    function from (frame_id, boxes of shape (n, 4)) to rows without the video; called with None at its end. The videos
    are spread over ``tasks``, or as many as their size suggests."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schema.split(", ")]
        video, advance = None, None
        for batch in batches:
            out = []
            for v, frame, boxes in zip(batch["video_id"], batch["frame_id"], batch["boxes"]):
                if v != video:
                    if advance:
                        out += [(video, *r) for r in advance(None, None)]
                    video, advance = v, step()
                out += [(v, *r) for r in advance(frame, np.asarray(boxes, float).reshape(-1, 4))]
            yield pd.DataFrame(out, columns=names)
        if advance:
            yield pd.DataFrame([(video, *r) for r in advance(None, None)], columns=names)

    ordered = packed.repartition(*([tasks] if tasks else []), "video_id").sortWithinPartitions("video_id", "frame_id")
    return ordered.mapInPandas(run, schema)


def choose(boxes: np.ndarray, last: tuple | None) -> tuple:
    """(center, area) chosen in a frame: each box is held against the one accepted before it in the same frame
    (at first against ``last``), and accepted if it is nearer than the nearest so far. Not the nearest to ``last``."""
    least, center, size = np.inf, last, None
    for x1, y1, x2, y2 in boxes:
        c = ((x1 + x2) / 2, (y1 + y2) / 2)
        d = 0.0 if center is None else float(np.hypot(c[0] - center[0], c[1] - center[1]))
        if d < least:
            least, center, size = d, c, (x2 - x1) * (y2 - y1)
    return center, size


def nearest(boxes: np.ndarray, last: tuple | None) -> tuple:
    """(center, area) of the box nearest to ``last``, the first of equals; the first box if there is no ``last``."""
    centers = np.column_stack([(boxes[:, 0] + boxes[:, 2]) / 2, (boxes[:, 1] + boxes[:, 3]) / 2])
    k = 0 if last is None else int(np.argmin(((centers - np.array(last)) ** 2).sum(axis=1)))
    return (float(centers[k, 0]), float(centers[k, 1])), float((boxes[k, 2] - boxes[k, 0]) * (boxes[k, 3] - boxes[k, 1]))


def greedy_track(packed: DataFrame, mode: str = "faithful") -> DataFrame:
    """(video_id, frame_id, cx, cy, area) of the box chosen in each frame that has one; ``mode`` 'faithful' or 'nearest'."""
    pick = {"faithful": choose, "nearest": nearest}[mode]

    def step():
        last = [None]

        def advance(frame, boxes):
            if frame is None or not len(boxes):
                return []
            last[0], size = pick(boxes, last[0])
            return [(frame, last[0][0], last[0][1], size)]

        return advance

    return fold(packed, step, "video_id int, frame_id long, cx double, cy double, area double")


def linear_spline(y: np.ndarray, w: np.ndarray, s: float) -> np.ndarray:
    """A smoothing spline of degree 1 at 0..n-1 with the sum of (w * residual)^2 at most ``s``.

    Each round adds a knot to the half of the spans with the greatest weighted residuals, at the greatest residual
    within, until the least-squares polyline meets the bound; this is the documented smoothing condition, by an
    own choice of knots.
    """
    n = len(y)
    x = np.arange(n, dtype=float)
    knots = [0, n - 1] if n > 1 else [0]
    while True:
        at = np.array(knots, float)
        basis = np.zeros((n, len(at)))
        if len(at) == 1:
            basis[:, 0] = 1
        else:
            span = np.clip(np.searchsorted(at, x, side="right") - 1, 0, len(at) - 2)
            t = (x - at[span]) / (at[span + 1] - at[span])
            basis[np.arange(n), span], basis[np.arange(n), span + 1] = 1 - t, t
        values = np.linalg.lstsq(basis * w[:, None], y * w, rcond=None)[0]
        fitted = basis @ values
        miss = (w * (y - fitted)) ** 2
        if miss.sum() <= s or len(knots) >= n:
            return fitted
        spans = [a for a in range(len(knots) - 1) if knots[a + 1] - knots[a] > 1]
        if not spans:
            return fitted
        sums = np.array([miss[knots[a] : knots[a + 1] + 1].sum() for a in spans])
        worst = [spans[i] for i in np.argsort(-sums, kind="stable")[: max(1, len(spans) // 2)]]
        knots = sorted({*knots, *(knots[a] + 1 + int(np.argmax(miss[knots[a] + 1 : knots[a + 1]])) for a in worst)})


def chunk_bounds(packed: DataFrame) -> DataFrame:
    """(video_id, chunk_no, first, end): a chunk ends behind the first occupied frame at which it has CHUNK_FRAMES
    frames, or with the video; the next begins there."""

    def step():
        state = {"first": None, "n": 0, "no": 0, "last": None}

        def advance(frame, boxes):
            if frame is None:
                return [(state["no"], state["first"], state["last"] + 1)] if state["n"] else []
            if state["n"] == 0:
                state["first"] = frame
            state["n"] += 1
            state["last"] = frame
            if state["n"] >= CHUNK_FRAMES and len(boxes):
                row = (state["no"], state["first"], frame + 1)
                state["no"], state["n"] = state["no"] + 1, 0
                return [row]
            return []

        return advance

    return fold(packed, step, "video_id int, chunk_no int, first long, end long")


def _smoothed_chunks(packed: DataFrame, values: int, whole: bool, schema: str, placeholder: tuple[float, float], placeholder_area: float) -> DataFrame:
    def step():
        tail: list[np.ndarray] = []
        chunk: list[tuple] = []

        def flush():
            nonlocal tail
            start = tail[-OVERLAP_FRAMES:]
            last = (tail[-1][0], tail[-1][1]) if tail else None
            rows, weight = list(start), [1.0] * len(start)
            for _, boxes in chunk:
                if len(boxes):
                    last, size = choose(boxes, last)
                    rows.append(np.array([*last, size][:values]))
                    weight.append(1.0)
                else:
                    rows.append(np.array([*placeholder, placeholder_area][:values]))
                    weight.append(EMPTY_WEIGHT)
            y, w = np.array(rows), np.array(weight)
            smooth = np.column_stack([linear_spline(y[:, c], w, float(len(w))) for c in range(values)])[len(start) :]
            tail = (tail + list(smooth))[-OVERLAP_FRAMES:]
            out = [(frame, *(int(v) if whole else float(v) for v in p)) for (frame, _), p in zip(chunk, smooth)]
            chunk.clear()
            return out

        def advance(frame, boxes):
            if frame is None:
                return flush() if chunk else []
            chunk.append((frame, boxes))
            return flush() if len(chunk) >= CHUNK_FRAMES and len(boxes) else []

        return advance

    return fold(packed, step, schema)


def interest_track(packed: DataFrame, placeholder: tuple[float, float] = PLACEHOLDER, placeholder_area: float = PLACEHOLDER_AREA) -> DataFrame:
    """(video_id, frame_id, poi_x, poi_y, aoi) in whole numbers: chosen boxes smoothed chunk by chunk.

    A chunk (see ``chunk_bounds``) is smoothed together with the last OVERLAP_FRAMES smoothed values before it;
    frames without boxes enter as a placeholder of almost no weight. The first choice of a chunk starts from the
    last smoothed point.
    """
    return _smoothed_chunks(packed, 3, True, "video_id int, frame_id long, poi_x long, poi_y long, aoi long", placeholder, placeholder_area)


def spline_track(packed: DataFrame, placeholder: tuple[float, float] = PLACEHOLDER) -> DataFrame:
    """(video_id, frame_id, poi_x, poi_y): as ``interest_track``, without the area and with fractions."""
    return _smoothed_chunks(packed, 2, False, "video_id int, frame_id long, poi_x double, poi_y double", placeholder, PLACEHOLDER_AREA)


def heatmap_track(packed: DataFrame, width: int = 1920, height: int = 1440, influence: float = 400.0, levels: int = 1024, rate: int = 256, attack: int = 4, stamp: str = "bell") -> DataFrame:
    """(video_id, frame_id, x, y, value): the hottest pixel of a decaying heat map, first in row order of equals.

    Each frame the map decays by v - (v / (levels - 1))^attack * rate, and every box stamps a Gaussian (``bell``) or a
    filled circle (``disc``, as annotations use it with 16 * rate levels) of ``influence`` times the area of its
    longer side's square. An all-cold map keeps the last point, at first the middle. The result is that of the whole
    map; ``heat`` says which of its pixels are computed.
    """
    tasks = 4 * packed.sparkSession.sparkContext.defaultParallelism  # by number: little data, much work
    return fold(packed, heat.hottest(width, height, influence, levels, rate, attack, stamp), "video_id int, frame_id long, x int, y int, value int", tasks)


def kalman_forward(packed: DataFrame, fps: float = 30.0) -> DataFrame:
    """(video_id, frame_id, state, spread): the filter's estimate (x, y and their speeds) after each frame and its
    covariance, row by row.

    A frame with boxes updates by the one nearest the last estimate, without predicting; a frame without boxes
    predicts, without updating.
    """
    f, q = _motion(fps)
    h, r = np.eye(2, 4), np.eye(2) * 0.001

    def step():
        x, p, last = np.zeros(4), np.eye(4), None

        def advance(frame, boxes):
            nonlocal x, p, last
            if frame is None:
                return []
            if len(boxes):
                z = np.array(nearest(boxes, last)[0])
                gain = p @ h.T @ np.linalg.inv(h @ p @ h.T + r)
                x = x + gain @ (z - h @ x)
                keep = np.eye(4) - gain @ h
                p = keep @ p @ keep.T + gain @ r @ gain.T
            else:
                x, p = f @ x, f @ p @ f.T + q
            last = (x[0], x[1])
            return [(frame, x.tolist(), p.ravel().tolist())]

        return advance

    return fold(packed, step, "video_id int, frame_id long, state array<double>, spread array<double>")


def _motion(fps: float) -> tuple[np.ndarray, np.ndarray]:
    f = np.eye(4)
    f[0, 2] = f[1, 3] = 1 / fps
    return f, np.eye(4)


def kalman_track(packed: DataFrame, fps: float = 30.0) -> DataFrame:
    """(video_id, frame_id, x, y, vx, vy): positions and speeds by a Kalman filter and a backward smoother.

    The filter's estimates (``kalman_forward``) are written to the checkpoint folder, and the smoother reads them from
    a video's last frame to its first, holding the one after it only: exact for videos of any length.
    """
    f, q = _motion(fps)

    def smooth(batches):
        video, after_x, after_p = None, None, None
        for batch in batches:
            out = []
            for v, frame, state, spread in zip(batch["video_id"], batch["frame_id"], batch["state"], batch["spread"]):
                x, p = np.array(state), np.array(spread).reshape(4, 4)
                if v == video:
                    ahead = f @ p @ f.T + q
                    gain = p @ f.T @ np.linalg.inv(ahead)
                    x = x + gain @ (after_x - f @ x)
                    p = p + gain @ (after_p - ahead) @ gain.T
                video, after_x, after_p = v, x, p
                out.append((v, frame, *map(float, x)))
            yield pd.DataFrame(out, columns=["video_id", "frame_id", "x", "y", "vx", "vy"])

    back = cut(kalman_forward(packed, fps)).repartition("video_id").sortWithinPartitions("video_id", F.col("frame_id").desc())
    return back.mapInPandas(smooth, "video_id int, frame_id long, x double, y double, vx double, vy double")


def cluster_headings(boxes: DataFrame) -> DataFrame:
    """(video_id, section_id, cluster_id, heading): the mean direction of a cluster's frame centers in radians.

    A direction counts between the last counted center and one that differs from it in both coordinates; the
    last frame is left out. Directions are weighted by their nearness to their median; none give 0. A group is
    a cluster within a section.
    """
    key = ["video_id", "section_id", "cluster_id"]
    centers = boxes.where("cluster_id <> -1").groupBy(*key, "frame_id").agg(F.avg((F.col("x1") + F.col("x2")) / 2).alias("cx"), F.avg((F.col("y1") + F.col("y2")) / 2).alias("cy"))

    def heading(rows: pd.DataFrame) -> pd.DataFrame:
        c = rows.sort_values("frame_id")[["cx", "cy"]].to_numpy()
        last, angles = 0, []
        for i in range(1, len(c) - 1):
            if c[i, 0] != c[last, 0] and c[i, 1] != c[last, 1]:
                angles.append(np.arctan2(c[i, 1] - c[last, 1], c[i, 0] - c[last, 0]))
                last = i
        a = np.array(angles)
        mean = float(np.average(a, weights=1 / (np.abs(a - np.median(a)) + 1e-10))) if len(a) else 0.0
        return rows[key].head(1).assign(heading=mean)

    return centers.groupBy(*key).applyInPandas(lambda rows: heading(rows), "video_id int, section_id long, cluster_id int, heading double")
