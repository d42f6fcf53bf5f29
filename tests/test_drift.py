import datetime as dt
import json

import numpy as np

from framewright.operators import drift

SCHEMA = "file_id long, family string, written_at timestamp, line_no int, record_json string, drift string"


def table(spark, files, family="f"):
    rows = []
    for i, records in enumerate(files):
        for k, r in enumerate(records):
            rows.append((i + 1, family, dt.datetime(2024, 1, 1 + i), k, r if r is None or isinstance(r, str) else json.dumps(r), "extra"))
    return spark.createDataFrame(rows, SCHEMA)


def run(spark, files):
    return {tuple(r) for r in drift.schema_changes(table(spark, files)).collect()}


def test_kinds(spark):
    base = [{"size": 100 + i, "label": "A", "start": 5 * i, "camera": {"side": "left", "tilt": i}} for i in range(6)]
    renamed = [{"n_boxes": 120 + i, "label": "B", "start": 4 * i, "camera": {"side": "right", "tilt": i}} for i in range(6)]
    unlike = [{"confidence": 0.1 * (i + 1), "label": "B", "start": 4 * i, "camera": {"side": "right"}} for i in range(6)]
    retyped = [{"confidence": str(0.1 * (i + 1)), "label": "B", "start": None, "camera": {"side": "right"}, "note": None} for i in range(6)]
    back = [{"confidence": "0.3", "label": "B", "start": "7", "note": None} for _ in range(6)]
    found = run(spark, [base, renamed, unlike, retyped, back])
    assert found == {
        (2, "n_boxes", "renamed"), (3, "n_boxes", "removed"), (3, "confidence", "added"), (3, "camera.tilt", "removed"),
        (4, "confidence", "retyped"), (4, "note", "added"), (5, "start", "retyped"), (5, "camera", "removed"),
    }


def test_types_are_carried_over_chunks_and_names(spark):
    files = [[{"a": 1, "b": "x"}], [{"a": None, "b": "y"}], [{"a": None}], [{"a": "1"}], [{"a": "2", "b": 3}]]
    want = {(3, "b", "removed"), (4, "a", "retyped"), (5, "b", "added"), (5, "b", "retyped")}
    assert run(spark, files) == want
    files += [[{"a": "3"}]] * 4 + [[{"a": 4}]]
    want |= {(6, "b", "removed"), (10, "a", "retyped")}
    sizes, drift.CHUNK, drift.FAN = (drift.CHUNK, drift.FAN), 1, 2  # several levels of the scan
    try:
        assert run(spark, files) == want
    finally:
        drift.CHUNK, drift.FAN = sizes


def test_object_renamed_with_children(spark):
    one = [{"color": {"title": "Sky", "rgb": [1, 2, 3]}}] * 4
    two = [{"tint": {"title": "Sky", "rgb": [1, 2, 3], "hex": "aabbcc"}}] * 4
    assert run(spark, [one, two]) == {(2, "tint", "renamed"), (2, "tint.hex", "added")}


def test_unreadable_and_empty(spark):
    assert run(spark, [[{"a": 1}, '{"a": ', None, "3", "[1]", "NaN"], [{"a": 2}, {"a": 2}]]) == set()
    assert run(spark, [["{", None], [{"a": 1}]]) == {(2, "a", "added")}
    assert drift.schema_changes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert drift.consistent_records(spark.createDataFrame([], SCHEMA)).count() == 0


def test_consistent_table(spark):
    one = [{"artifact_id": f"cam_{i}.mp4", "size": 100 + i} for i in range(5)]
    two = [{"section_key": f"cam_{i}.mp4", "size": str(100 + i)} for i in range(5)]
    rows = drift.consistent_records(table(spark, [one, one, two])).collect()
    assert len(rows) == 15 and {r["f_artifact_id"] for r in rows} == {f"cam_{i}.mp4" for i in range(5)}
    assert {r["f_size"] for r in rows} == {100.0 + i for i in range(5)} and all(r["rest"] == {} for r in rows)


def test_two_names_in_one_record(spark):
    """Families that rename colour to color do not merge the two in a family that has both; nothing is lost."""
    colour, color = [{"colour": "Sky", "n": 1}] * 3, [{"color": "Sky", "n": 2}] * 3
    df = table(spark, [colour, color], "a").unionByName(table(spark, [colour, color], "b"))
    both = [{"colour": "Sky", "color": "Teal", "n": None, "deep": {"x": [1, {"y": 2}]}, "ok": True}, {"colour": "Lime", "n": "many"}]
    rows = drift.consistent_records(df.unionByName(table(spark, [both], "c"))).collect()
    got = {(r["family"], r["file_id"], r["line_no"]): r for r in rows}
    assert len(rows) == 14 and {r["f_color"] for k, r in got.items() if k[0] in "ab"} | {r["f_colour"] for k, r in got.items() if k[0] in "ab"} == {"Sky", None}
    c = got["c", 1, 0]
    assert (c["f_colour"], c["f_color"], c["f_n"], c["null_fields"], c["f_ok"], c["f_deep_x"]) == ("Sky", "Teal", None, ["n"], True, '[1, {"y": 2}]')
    assert got["c", 1, 1]["rest"] == {"n": "many"}


def test_names_of_chunks_and_reused_names(spark):
    """A field keeps its first name over chunks; a path that a rename has set free is another field later."""
    files = [[{"mean": 1.5, "k": 1}], [{"average": 1.25, "k": 2}], [{"average": 2.5, "k": 3}], [{"average": 2.25, "mean": "text here", "k": 3}]]
    sizes, drift.CHUNK = drift.CHUNK, 1
    try:
        rows = {r["file_id"]: r for r in drift.consistent_records(table(spark, files)).collect()}
    finally:
        drift.CHUNK = sizes
    assert [rows[i]["f_mean"] for i in (1, 2, 3, 4)] == [1.5, 1.25, 2.5, 2.25]
    assert [v for k, v in rows[4].asDict().items() if k.startswith("f_mean_")] == ["text here"]


def test_moves_are_part_of_the_cheapest_script():
    kinds = {"number": {"n": 3, "whole": 3, "log": 6.0}}
    old = {"camera": {"object": {"n": 3}}, "camera\x1ftilt": kinds, "a": kinds}
    new = {"camera": {"object": {"n": 3}}, "tilt": kinds, "a": kinds}
    assert drift.edit_script(old, new) == ({"camera\x1ftilt": "tilt"}, [], [])


def test_deep_texts_are_read():
    from framewright.functions.jsontext import write_json

    depth = 20_000
    text = '{"a":[' * depth + "1" + "]}" * depth
    value, n = drift.read_json(text), 0
    assert write_json(value).replace(" ", "") == text
    while isinstance(value, dict):
        value, n = value["a"][0], n + 1
    assert n == depth and value == 1
    for bad in ('{"a":[' * depth, text + "1", text + "]", '{"a":[' * depth + "NaN" + "]}" * depth, '{"a" [' * depth + "]}" * depth):
        assert drift.read_json(bad) is None


def test_assignment_is_cheapest():
    from itertools import permutations

    rng = np.random.default_rng(3)
    for _ in range(20):
        c = rng.random((4, 6))
        best = min(sum(c[i, p[i]] for i in range(4)) for p in permutations(range(6), 4))
        assert abs(sum(c[i, j] for i, j in drift.assign(c)) - best) < 1e-9
