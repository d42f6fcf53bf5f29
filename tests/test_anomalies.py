import numpy as np

from framewright.operators import anomalies

INTERESTS = "video_id int, frame_id long, poi_x double, poi_y double, aoi double, metric string"
VIDEOS = "video_id int, width int, height int, kind string"


def series(n=600, seed=1):
    rng = np.random.default_rng(seed)
    x = 600 + np.cumsum(rng.normal(0, 1.5, n))
    y = 300 + np.cumsum(rng.normal(0, 1.0, n))
    a = 200 + np.cumsum(rng.normal(0, 0.8, n))
    return np.round(np.column_stack([x, y, a]), 2)


def run(spark, values, video=1):
    rows = [(video, i, *(None if v is None else float(v) for v in r), "m") for i, r in enumerate(values) if r is not None]
    found = anomalies.implausible_readings(spark.createDataFrame(rows + rows[:5], INTERESTS), spark.createDataFrame([(1, 1280, 720, "k")], VIDEOS))
    return {(r["frame_id"], r["metric"], r["kind"]) for r in found.collect()}


def test_each_kind(spark):
    v = series().tolist()
    v[50][:2] = [-1.0, 300.0]
    v[60][2] = float("nan")
    v[70][2] = 0.0
    for i in range(100, 120):
        v[i][:2] = v[100][:2]
    for i in (200, 201):
        v[i][2] += 150
    v[300][:2] = [v[300][0] + 200, v[300][1]]
    for i in range(400, 600):
        v[i][2] += 500
    v[450] = [None, None, None]
    want = {(50, "poi", "impossible"), (60, "aoi", "impossible"), (70, "aoi", "impossible"), (200, "aoi", "spike"), (201, "aoi", "spike"), (300, "poi", "spike")}
    want |= {(i, "poi", "stuck") for i in range(100, 120)}
    assert run(spark, v) == want


def test_blocks_do_not_matter(spark):
    v = series(900, 7).tolist()
    for i in range(190, 260):
        v[i][2] = v[190][2]
    v[256][:2] = [v[256][0] + 150, v[256][1]]
    v[511][2] += 90
    whole = run(spark, v)
    block, anomalies.BLOCK = anomalies.BLOCK, 128
    try:
        assert run(spark, v) == whole
    finally:
        anomalies.BLOCK = block
    assert {(i, "aoi", "stuck") for i in range(190, 260)} <= whole and (256, "poi", "spike") in whole and (511, "aoi", "spike") in whole


def test_sparse_sources(spark):
    """Readings in every third frame only: steps are those of the source's own spacing."""
    v = [r if i % 3 == 0 else None for i, r in enumerate(np.repeat(series(300, 4), 3, axis=0).tolist())]
    v[300] = [v[300][0] + 300, *v[300][1:]]
    assert run(spark, v) == {(300, "poi", "spike")}


def test_long_holds_may_be_normal(spark):
    v = np.round(series(900, 3) / 20) * 20
    assert not {k for _, _, k in run(spark, v.tolist())} & {"stuck"}


def test_small_inputs(spark):
    assert run(spark, [[1.0, 1.0, 5.0]]) == set()
    empty = anomalies.implausible_readings(spark.createDataFrame([], INTERESTS), spark.createDataFrame([], VIDEOS))
    assert empty.count() == 0


def test_gesd_finds_planted_outliers():
    rng = np.random.default_rng(0)
    x = rng.normal(size=500)
    x[[10, 20, 30]] += 12
    assert set(np.flatnonzero(anomalies.gesd(x))) == {10, 20, 30}
