import numpy as np
import pytest

from framewright.llm import similarity

SCHEMA = "det_id long, video_id int, x1 double, y1 double, x2 double, y2 double, confidence double, node long, root string"


def brute(rows):
    out = set()
    seen = {r[0]: r for r in rows if None not in r[:6]}
    for video in {r[1] for r in seen.values()}:
        own = sorted(r for r in seen.values() if r[1] == video)
        p = [[min(r[2], r[4]), min(r[3], r[5]), max(r[2], r[4]), max(r[3], r[5])] for r in own]
        v = np.column_stack([np.rint(np.array(p) * 1000) / 20000, np.rint(np.array([r[6] or 0.0 for r in own]) * 1000) / 200])
        root = list(range(len(own)))

        def find(a):
            while root[a] != a:
                root[a] = root[root[a]]
                a = root[a]
            return a

        for i in range(len(own)):
            for j in np.flatnonzero(np.abs(v[i + 1 :] - v[i]).max(axis=1) <= 1):
                a, b = find(i), find(i + 1 + j)
                root[max(a, b)] = min(a, b)
        out |= {(own[find(i)][0], own[i][0]) for i in range(len(own)) if find(i) != i}
    return out


def run(spark, rows):
    return {tuple(r) for r in similarity.similarity_groups(spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)).collect()}


@pytest.mark.parametrize("spread", [60, 150, 400])
def test_equals_brute_force(spark, spread):
    rng = np.random.default_rng(spread)
    rows = []
    for i in range(400):
        x, y = (float(v) for v in rng.integers(0, spread, 2))
        rows.append((i + 1, 1 + i % 2, x, y, x + float(rng.integers(0, 40)), y + float(rng.integers(0, 40)), float(rng.integers(0, 10)) / 10))
    assert run(spark, rows) == brute(rows)


def test_borders_and_dirt(spark):
    rows = [
        (1, 1, 0.0, 0.0, 10.0, 10.0, 0.2), (2, 1, 20.0, 20.0, 30.0, 30.0, 0.4), (3, 1, 40.1, 20.0, 50.0, 30.0, 0.4), (4, 1, 30.0, 30.0, 20.0, 20.0, 0.4),
        (5, 1, None, 0.0, 1.0, 1.0, 0.2), (6, 2, 0.0, 0.0, 10.0, 10.0, 0.2), (7, 1, 0.0, 0.0, 10.0, 10.0, None), (2, 1, 20.0, 20.0, 30.0, 30.0, 0.4),
    ]
    assert run(spark, rows) == {(1, 2), (1, 4), (1, 7)} == brute(rows)


def test_empty_and_hot(spark):
    assert run(spark, []) == set()
    hot = [(i, 1, 5.0, 5.0, 9.0, 9.0, 0.5) for i in range(1, 1500)] + [(2000 + i, 1, 100.0 * i, 900.0, 100.0 * i + 5, 905.0, 0.5) for i in range(5)]
    assert run(spark, hot) == {(1, i) for i in range(2, 1500)}


def test_summary_counts_every_row_and_splits_chains(spark):
    chain = [(i, 1, 18.0 * i, 0.0, 18.0 * i + 5, 5.0, 0.5) for i in range(1, 8)]
    df = spark.createDataFrame([(*r, 0, "") for r in chain], SCHEMA)
    groups = similarity.group_summary(df).collect()
    assert sum(r["size"] for r in groups) == 7 and len(groups) > 1
    assert all(r["medoid_det_id"] == r["typical"][0] for r in groups)


def test_summary_sizes_are_those_of_the_groups(spark):
    """Each detection is counted once however often its row is repeated, and splits take medoids by falling priority."""
    rng = np.random.default_rng(5)
    rows = [(i, 1 + i % 2, float(x), 10.0, float(x) + 30, 40.0, 0.5) for i, x in enumerate(rng.integers(0, 900, 120), 1)]
    df = spark.createDataFrame([(*r, 0, "") for r in [*rows, *rows[:40]]], SCHEMA)
    groups = similarity.group_summary(df, loose=2.0).collect()
    at = {r[0]: r[2] for r in rows}
    assert sum(r["size"] for r in groups) == 120
    for r in groups:  # no two medoids of a video are within the limit of one another
        assert not [q for q in groups if q["video_id"] == r["video_id"] and q["medoid_det_id"] != r["medoid_det_id"] and abs(at[q["medoid_det_id"]] - at[r["medoid_det_id"]]) < 20]
        assert all(abs(at[x] - at[r["medoid_det_id"]]) <= 60 for x in r["typical"])
