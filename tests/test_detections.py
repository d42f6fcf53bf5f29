"""Detection operators against plain versions, and on awkward inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions.columns import cluster_letter
from framewright.operators import boxes as B
from framewright.operators import clustering, crop, sections, smoothing, tracking

BOX = "det_id long, video_id int, frame_id long, det_ord int, x1 double, y1 double, x2 double, y2 double, confidence double, class_id int, cluster_id int"


def box(i, frame, x, y, size=10.0, video=1, cluster=-1, conf=0.9):
    return (i, video, frame, 0, x - size / 2, y - size / 2, x + size / 2, y + size / 2, conf, 0, cluster)


def videos(spark):
    return spark.createDataFrame([(1, "a.mp4", 1920, 1080, 30), (2, "b.mp4", 640, 360, 30)], "video_id int, video_name string, width int, height int, fps int")


def plain_dbscan(p, eps, k):
    near = [np.flatnonzero(((p - q) ** 2).sum(axis=1) <= eps * eps) for q in p]
    core, label, n = [len(x) >= k for x in near], [-1] * len(p), 0
    for i in range(len(p)):
        if core[i] and label[i] < 0:
            todo, label[i] = [i], n
            while todo:
                for j in near[todo.pop()]:
                    if label[j] < 0:
                        label[j] = n
                        if core[j]:
                            todo.append(j)
            n += 1
    return label


def test_dbscan_equals_plain():
    rng = np.random.default_rng(0)
    for d in (2, 5):
        p = np.vstack([rng.normal(c, 0.05, (40, d)) for c in (0.2, 0.5, 0.9)] + [rng.random((30, d))])
        rng.shuffle(p)
        assert clustering.dbscan(p, 0.12, 5).tolist() == plain_dbscan(p, 0.12, 5)
    assert clustering.dbscan(np.zeros((1, 2)), 1, 1).tolist() == [-1]


def test_static_clusters_equal_plain(spark):
    rng = np.random.default_rng(2)
    at = np.vstack([rng.normal((400, 300), 3, (60, 2)), rng.normal((1200, 700), 3, (50, 2)), rng.uniform((0, 0), (1900, 1000), (60, 2))])
    rng.shuffle(at)
    rows = [box(i + 1, i, x, y) for i, (x, y) in enumerate(at.tolist())]
    found = clustering.cluster_videos(spark.createDataFrame(rows, BOX), videos(spark), min_samples=20).collect()
    rounded = np.rint(at / (1920, 1080) * 1e6 / 250) * 250
    want = plain_dbscan(rounded, 20000, 20)
    assert {r["det_id"]: r["label"] for r in found} == {i + 1: v for i, v in enumerate(want)}


def test_choice_depends_on_order():
    two = np.array([[0, 0, 2, 2], [100, 100, 102, 102.0]])
    assert tracking.choose(two, (95.0, 95.0))[0] == (1.0, 1.0)  # the second is held against the first, not against the last point
    assert tracking.nearest(two, (95.0, 95.0))[0] == (101.0, 101.0)


def test_kernels():
    assert abs(smoothing.gaussian_kernel().sum() - 1) < 1e-12 and len(smoothing.gaussian_kernel()) == 321
    assert smoothing.mirrored(np.array([-1, -2, 0, 2, 3, 4, 7]), 3).tolist() == [0, 1, 0, 2, 2, 1, 1]


def test_smoothing_over_blocks(spark):
    rng = np.random.default_rng(5)
    y = rng.random(700)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(y)], "k int, place long, v double")
    kernel = smoothing.gaussian_kernel(10)
    want = np.convolve(y[smoothing.mirrored(np.arange(-40, 740), 700)], kernel, mode="valid")
    block, smoothing.BLOCK = smoothing.BLOCK, 128
    try:
        found = {r["place"]: r["v"] for r in smoothing.smooth(df, "k", ["v"], kernel).collect()}
    finally:
        smoothing.BLOCK = block
    assert np.allclose([found[i] for i in range(700)], want)
    flat = smoothing.smooth(df.withColumn("v", F.lit(7.0)), "k", ["v"], kernel)
    assert {round(r["v"], 9) for r in flat.collect()} == {7.0}


def test_spline_keeps_its_bound():
    rng = np.random.default_rng(1)
    y, w = np.cumsum(rng.normal(0, 5, 80)), np.ones(80)
    for s in (80.0, 10.0):
        assert ((tracking.linear_spline(y, w, s) - y) ** 2).sum() <= s + 1e-6
    assert np.allclose(tracking.linear_spline(y, w, 0.0), y)
    line = np.arange(50.0)
    assert np.allclose(tracking.linear_spline(line, np.ones(50), 50.0), line)


def test_folds_on_awkward_frames(spark):
    frames = spark.createDataFrame([(v, i) for v in (1, 2) for i in range(130)], "video_id int, frame_id long")
    some = spark.createDataFrame([box(i + 1, i, 100.0 + i, 200.0) for i in range(0, 130, 3)], BOX)
    packed = tracking.packed_frames(frames, some)
    assert packed.count() == 260
    chunks = [tuple(r) for r in tracking.chunk_bounds(packed).orderBy("video_id", "chunk_no").collect()]
    assert chunks == [(1, 0, 0, 64), (1, 1, 64, 130), (2, 0, 0, 130)] or sum(e - f for _, _, f, e in chunks) == 260
    assert tracking.interest_track(packed).count() == 260
    assert tracking.heatmap_track(packed).where("video_id = 2").select("x", "y", "value").distinct().count() == 1
    assert tracking.kalman_track(packed).count() == 260
    assert tracking.greedy_track(packed).count() == some.count()


def test_kalman_is_the_smoother_of_the_whole_video(spark):
    rng = np.random.default_rng(4)
    frames = spark.createDataFrame([(1, i) for i in range(2500)], "video_id int, frame_id long")
    some = spark.createDataFrame([box(i + 1, i, float(500 + 3 * i + rng.normal()), float(300 + rng.normal())) for i in range(2500) if i % 4 and not 900 < i < 1300], BOX)
    packed = tracking.packed_frames(frames, some)
    found = np.array([[r["x"], r["y"], r["vx"], r["vy"]] for r in tracking.kalman_track(packed).orderBy("frame_id").collect()])
    boxes = {r["frame_id"]: np.asarray(r["boxes"], float).reshape(-1, 4) for r in packed.collect()}
    f = np.eye(4)
    f[0, 2] = f[1, 3] = 1 / 30
    xs, ps, x, p = [], [], np.zeros(4), np.eye(4)
    for i in range(2500):
        if len(boxes[i]):
            z = (boxes[i][0, :2] + boxes[i][0, 2:]) / 2
            gain = p[:, :2] @ np.linalg.inv(p[:2, :2] + np.eye(2) * 0.001)
            x, p = x + gain @ (z - x[:2]), p - gain @ p[:2]
        else:
            x, p = f @ x, f @ p @ f.T + np.eye(4)
        xs.append(x)
        ps.append(p)
    for i in range(2498, -1, -1):
        ahead = f @ ps[i] @ f.T + np.eye(4)
        gain = ps[i] @ f.T @ np.linalg.inv(ahead)
        xs[i], ps[i] = xs[i] + gain @ (xs[i + 1] - f @ xs[i]), ps[i] + gain @ (ps[i + 1] - ahead) @ gain.T
    assert np.abs(found - np.array(xs)).max() < 1e-5


def test_sections_of_short_videos(spark):
    frames = spark.createDataFrame([(1, i) for i in range(200)] + [(2, 0)], "video_id int, frame_id long")
    found = {tuple(r) for r in B.sections(frames, videos(spark)).collect()}
    assert found == {(1, 0, 0, 90), (1, 1, 90, 180), (1, 2, 180, 200), (2, 0, 0, 1)}


def test_letters(spark):
    df = spark.createDataFrame([(-1,), (0,), (25,), (26,)], "c int")
    assert [r[0] for r in df.select(cluster_letter(F.col("c"))).collect()] == ["@", "A", "Z", "["]


def test_crop_stays_inside(spark):
    pts = spark.createDataFrame([(1, i, x, y, a, 1920, 1080) for i, (x, y, a) in enumerate([(0.0, 0.0, 10.0), (1919.0, 1079.0, 1e6), (960.0, 540.0, 175.0)])] + [(1, 9, None, 1.0, 1.0, 1920, 1080)], "video_id int, frame_id long, poi_x double, poi_y double, aoi double, width int, height int")
    for r in crop.crop_windows(pts).collect():
        assert 0 <= r["x1"] < r["x2"] <= 1920 and 0 <= r["y1"] < r["y2"] <= 1080
    assert crop.crop_windows(pts).count() == 3


def test_carry_forward_over_blocks(spark):
    rows = [(1, i, float(i) if i % 50 == 3 else None) for i in range(300)]
    block, B.BLOCK = B.BLOCK, 16
    try:
        found = {r["i"]: r["v"] for r in B.carry_forward(spark.createDataFrame(rows, "k int, i long, v double"), "k", "i", ["v"]).collect()}
    finally:
        B.BLOCK = block
    assert all(found[i] == (None if i < 3 else float((i - 3) // 50 * 50 + 3)) for i in range(300))


def test_dirty_boxes(spark):
    rows = [box(1, 0, 5.0, 5.0), box(1, 0, 5.0, 5.0), (2, 1, 0, 0, 9.0, 9.0, 1.0, 1.0, None, None, None), (3, 1, 0, 0, None, 1.0, 2.0, 2.0, 0.5, 1, 1), (4, 1, 0, 0, float("nan"), 1.0, 2.0, 2.0, 0.5, 1, 1)]
    found = B.distinct_boxes(spark.createDataFrame(rows, BOX)).orderBy("det_id").collect()
    assert [r["det_id"] for r in found] == [1, 2]
    assert tuple(found[1])[4:] == (1.0, 1.0, 9.0, 9.0, 0.0, 0, -1)
    bare = B.scan_boxes(spark.createDataFrame(rows, BOX).drop("cluster_id", "confidence"))
    assert {r["cluster_id"] for r in bare.collect()} == {-1}


def test_zones_are_strictly_earlier(spark):
    schema = BOX + ", section_id long"
    b = spark.createDataFrame([(*box(1, 0, 100.0, 100.0), 0), (*box(2, 95, 100.0, 100.0), 1), (*box(3, 96, 500.0, 100.0), 1)], schema)
    z = spark.createDataFrame([(1, 0, 90, 110, 90, 110, None, None)], "video_id int, section_id long, x_lo long, x_hi long, y_lo long, y_hi long, min_area double, max_area double")
    assert {r["det_id"] for r in sections.outside_earlier_zones(b, z).collect()} == {1, 3}


@pytest.mark.parametrize("f", [B.distinct_boxes, B.frame_means, B.pack_frames, clustering.suppress_tiles])
def test_empty_tables(spark, f):
    empty = spark.createDataFrame([], BOX)
    assert f(empty if f is B.distinct_boxes else B.distinct_boxes(empty)).count() == 0


def test_service_is_asked_for_what_is_missing(spark):
    from framewright.operators import labelling

    artifacts = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "artifact_id string")
    stored = spark.createDataFrame([("a", "{}"), ("b", None)], "artifact_id string, body string")
    client = lambda x: {"b": "[]"}[x]
    assert {tuple(r) for r in labelling.ask_missing(artifacts, stored, client, "v").collect()} == {("b", "v", "[]"), ("c", "v", None)}


def test_palette_order_hangs_on_image_and_clusters(spark):
    import hashlib
    import random

    order = sections.palette_order(8, b"x", [0, 1])
    expected = list(range(8))
    random.Random(int(hashlib.sha256(b"x" + bytes([0, 1])).hexdigest(), 16) % 2**32).shuffle(expected)
    assert order == expected != sections.palette_order(8, b"y", [0, 1]) and sections.palette_order(8, b"x", [-1, 2]) != order
    palette = spark.createDataFrame([(i, c) for i, c in enumerate("abcdefgh")], "idx int, color_name string")
    stats = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (2, 0, 5)], "video_id int, section_id long, cluster_id int")
    images = spark.createDataFrame([(1, 0, bytearray(b"x"))], "video_id int, section_id long, image binary")
    found = {tuple(r) for r in sections.shuffled_colors(stats, palette, images).select("video_id", "cluster_id", "color_name").collect()}
    assert found == {(1, 0, "abcdefgh"[order[0]]), (1, 1, "abcdefgh"[order[1]]), (2, 5, "a")}


def test_parts_in_tiles_merge_to_the_whole_box(spark):
    from framewright.operators import crop

    rows = [(1, 1, 0, 0, 500.0, 100.0, 700.0, 300.0, 0.9, 0, -1, 1920, 1080), (2, 1, 0, 1, 1850.0, 1000.0, 1920.0, 1080.0, 0.4, 1, -1, 1920, 1080), (3, 1, 1, 0, 5.0, 5.0, 9.0, 9.0, 0.5, 0, -1, 300, 200)]
    df = spark.createDataFrame(rows, BOX + ", width int, height int")
    parts = crop.cut_by_tiles(df)
    assert parts.where("det_id = 1").count() == 2 and parts.where("x1 < 0 or y1 < 0 or x2 > width or y2 > height").count() == 0
    whole = clustering.merge_tiles(parts.withColumn("det_id", F.col("det_id") * 100 + F.col("tile_no")))
    assert {(r["x1"], r["y1"], r["x2"], r["y2"], r["class_id"]) for r in whole.collect()} == {(500.0, 100.0, 700.0, 300.0, 0), (1850.0, 1000.0, 1920.0, 1080.0, 1), (5.0, 5.0, 9.0, 9.0, 0)}


def test_detector_output(spark):
    rows = [(1, 0, [([1.0, 2.0, 3.0, 4.0], 0.5, 7), ([5.0, 6.0, 7.0, 8.0], None, None)]), (1, 1, []), (1, 2, None)]
    found = B.from_predictions(spark.createDataFrame(rows, "video_id int, frame_id long, predictions array<struct<bbox:array<double>,score:double,category:int>>"))
    assert [tuple(r) for r in found.orderBy("det_ord").collect()] == [(1, 0, 0, 1.0, 2.0, 3.0, 4.0, 0.5, 7, -1), (1, 0, 1, 5.0, 6.0, 7.0, 8.0, 0.0, 0, -1)]


def test_two_words_of_color(spark):
    from framewright.operators import labelling

    labels = spark.createDataFrame([(1, "A", True), (1, "B", False)], "response_id long, label string, is_primary boolean")
    prompts = spark.createDataFrame([(1, "id, color\nA, Dark Green\nB, Sky")], "response_id long, prompt string")
    assert {tuple(r) for r in labelling.color_bias(labels, prompts).collect()} == {("Dark Green", 1, 0), ("Sky", 0, 1)}


def test_labels_of_awkward_answers(spark):
    from framewright.operators import labelling

    texts = {
        1: '```json\n[{"id": " a", "primary": true}, {"id": "A", "primary": false}]\n```', 2: "no list", 3: "] [", 4: None, 5: "[]", 6: '[{"id": "A"}]', 7: '[[{"id": "A", "primary": true}]]',
        8: '{"areas": [{"id": "B", "primary": true}]}', 9: '[{"id": "A", "primary": "x"}]', 10: '{"areas": [{"id": "C", "focus": true, "distance": 2}, {"id": "A", "focus": false}]}',
    }
    df = spark.createDataFrame(list(texts.items()), "i int, t string")
    found = {r["i"]: r["labels"] for r in labelling.with_labels(df, "t").collect()}
    assert found == {1: {"A": False}, 2: None, 3: None, 4: None, 5: {}, 6: None, 7: None, 8: {"B": True}, 9: None, 10: {"C": True, "A": False}}
    assert [r["places"] for r in labelling.with_labels(df, "t").where("i = 10").collect()] == [["C", "A"]]


def test_heatmap_has_the_pixels_of_the_whole_map(spark):
    frames = spark.createDataFrame([(1, i) for i in range(8)], "video_id int, frame_id long")
    places = {1: [(603.0, 407.0), (1901.0, 1433.0)], 2: [(611.0, 409.0)], 6: [(15.0, 9.0)]}
    packed = tracking.packed_frames(frames, spark.createDataFrame([box(1, f, x, y) for f, v in places.items() for x, y in v], BOX))
    boxes = {r["frame_id"]: np.asarray(r["boxes"], float).reshape(-1, 4) for r in packed.collect()}
    heat, point, expected = np.zeros((1440, 1920)), (960, 720), []
    for f in range(8):
        heat = np.floor(heat - heat**4 / 1023**4 * 256)
        for x1, y1, x2, y2 in boxes[f]:
            side, cx, cy = max(x2 - x1, y2 - y1), (x1 + x2) / 2, (y1 + y2) / 2
            pad = side * 19 / 2
            l, t, r, b = int(max(cx - side / 2 - pad, 0)), int(max(cy - side / 2 - pad, 0)), int(min(cx + side / 2 + pad, 1920)), int(min(cy + side / 2 + pad, 1440))
            bell = lambda a, b, c: np.exp(-((np.arange(a, b) - c) ** 2) / (2 * (pad / 3.5) ** 2))
            heat[t:b, l:r] += np.floor(bell(t, b, cy)[:, None] * bell(l, r, cx) * 256)
        heat = np.clip(heat, 0, 1023)
        if heat.max():
            point = tuple(int(k) for k in np.unravel_index(np.argmax(heat), heat.shape))[::-1]
        expected.append((f, *point, int(heat.max())))
    assert [tuple(r)[1:] for r in tracking.heatmap_track(packed).orderBy("frame_id").collect()] == expected


def whole_map(frames, width, height, influence, levels, rate, attack, stamp):
    """(x, y, value) of each frame's hottest pixel by the map with all its pixels."""
    value = np.arange(levels)
    decayed = np.clip(value - value**attack / (levels - 1) ** attack * rate, 0, levels - 1).astype(int)
    heat, point, out = np.zeros((height, width), int), (width // 2, height // 2), []
    for boxes in frames:
        heat = decayed[heat]
        for x1, y1, x2, y2 in boxes:
            side, cx, cy = max(x2 - x1, y2 - y1), (x1 + x2) / 2, (y1 + y2) / 2
            pad = side * (influence**0.5 - 1) / 2
            reach = side / 2 + pad
            x, y = np.arange(int(max(cx - reach, 0)), int(min(cx + reach, width))), np.arange(int(max(cy - reach, 0)), int(min(cy + reach, height)))
            if pad <= 0 or not len(x) or not len(y):
                continue
            if stamp == "bell":
                spread = 2 * (pad / 3.5) ** 2
                stamped = np.floor(np.exp(-((y - cy) ** 2) / spread)[:, None] * np.exp(-((x - cx) ** 2) / spread) * rate).astype(int)
            else:
                stamped = rate * (((y - y[0] - len(y) // 2) ** 2)[:, None] + (x - x[0] - len(x) // 2) ** 2 <= int(reach) ** 2)
            heat[y[0] : y[-1] + 1, x[0] : x[-1] + 1] += stamped
        heat = np.minimum(heat, levels - 1)
        if heat.max():
            point = tuple(int(k) for k in np.unravel_index(np.argmax(heat), heat.shape))[::-1]
        out.append((*point, int(heat.max())))
    return out


def moving_boxes(rng, frames, width, height):
    """Boxes of a few objects, some at rest and some moving, with pauses in which the map cools, and boxes that reach over the edges."""
    at, speed = rng.uniform(-20, [width + 20, height + 20], (6, 2)), rng.normal(0, 1.5, (6, 2)) * rng.integers(0, 2, (6, 1))
    sizes, out = rng.uniform(3, 16, (6, 2)), []
    for i in range(frames):
        seen = [] if 200 < i % 900 < 620 else [k for k in range(6) if rng.random() < (0.5 if i % 300 < 150 else 0.05)]
        out.append(np.array([[*(at[k] + speed[k] * (i % 100)), *(at[k] + speed[k] * (i % 100) + sizes[k])] for k in seen], float).reshape(-1, 4))
    return out


@pytest.mark.parametrize(("stamp", "influence", "levels", "rate"), [("bell", 400.0, 1024, 256), ("bell", 30.0, 200, 60), ("disc", 4.0, 4096, 256), ("disc", 9.0, 64, 16)])
def test_pixels_left_out_of_the_heatmap_change_nothing(stamp, influence, levels, rate):
    from framewright.operators import heat

    for seed in range(3):
        frames = moving_boxes(np.random.default_rng(seed), 1300, 210, 150)
        advance, rows = heat.hottest(210, 150, influence, levels, rate, 4, stamp)(), []
        for i, boxes in enumerate(frames):
            rows += advance(i, boxes)
        rows += advance(None, None)
        assert rows == [(i, *r) for i, r in enumerate(whole_map(frames, 210, 150, influence, levels, rate, 4, stamp))]


@pytest.mark.parametrize(("stamp", "influence", "levels"), [("disc", 4.0, 4096), ("bell", 400.0, 1024)])
def test_heatmap_is_done_in_time(stamp, influence, levels):
    """A frame's cost doesn't follow the map: 20 ms a frame and more where each pixel is decayed and searched."""
    import time

    from framewright.operators import heat

    boxes = np.array([[100.0 + 400 * k, 80 + 300 * k, 124 + 400 * k, 104 + 300 * k] for k in range(4)])
    advance, began, rows = heat.hottest(1920, 1440, influence, levels, 256, 4, stamp)(), time.process_time(), []
    for i in range(1500):
        rows += advance(i, boxes[: i % 5])
    rows += advance(None, None)
    assert len(rows) == 1500 and time.process_time() - began < 12


def test_heatmap_of_many_moving_boxes_is_done_in_time():
    """The hottest pixel jumps between moving objects: many blocks are computed, each for a few frames. Held against the
    whole map, as machines differ: about 20 times as fast, 5 to 8 times where numpy's loops are as short as a block."""
    import time

    from framewright.operators import heat

    rng = np.random.default_rng(5)
    at, speed = rng.uniform(200, [1700, 1200], (7, 2)), rng.normal(0, 1.5, (7, 2))
    places = [at + speed * (i % 200) + rng.normal(0, 3, (7, 2)) for i in range(500)]
    frames, took = [np.hstack([p, p + rng.uniform(20, 34, (7, 1))]) for p in places], [time.process_time()]
    expected = whole_map(frames[:50], 1920, 1440, 400.0, 1024, 256, 4, "bell")
    took.append(time.process_time())
    advance, rows = heat.hottest(1920, 1440, 400.0, 1024, 256, 4, "bell")(), []
    for i, boxes in enumerate(frames):
        rows += advance(i, boxes)
    rows += advance(None, None)
    took.append(time.process_time())
    assert [r[1:] for r in rows[:50]] == expected and len(rows) == 500
    assert (took[2] - took[1]) / 500 < (took[1] - took[0]) / 50 / 10


def test_heatmap_shuffles_detections_by_frame_only(spark, sf_dir):
    from framewright.plans import reference_queries as queries

    found = queries.heatmap_poi(spark, sf_dir)
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not [line for line in plan if "Exchange" in line and "x1" in line]
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in tracking.heatmap_track(queries._packed(spark, sf_dir)).collect()}


def test_heatmap_is_spread_over_tasks(spark):
    packed = tracking.packed_frames(spark.createDataFrame([(v, 0) for v in range(64)], "video_id int, frame_id long"), spark.createDataFrame([box(1, 0, 100.0, 200.0)], BOX))
    got = tracking.heatmap_track(packed).withColumn("task", F.spark_partition_id()).select("task").distinct().count()
    assert got > 4
