import json
import re

from framewright.operators import nested

SCHEMA = "response_id long, body string, node_path string"


def run(spark, bodies):
    rows = [(i + 1, b if b is None or isinstance(b, str) else json.dumps(b), "x") for i, b in enumerate(bodies)]
    return {tuple(r) for r in nested.nested_places(spark.createDataFrame(rows + rows[:1], SCHEMA)).collect()}


def test_paths_and_parents(spark):
    inner = json.dumps({"areas": [{"id": "A", "evidence": [{"f": 1}]}]})
    body = {"choices": [{"message": {"content": [{"text": '[{"id": 1}]'}], "tool_calls": [None, {"function": {"arguments": inner}}]}}]}
    top = "choices[0].message.tool_calls[1]"
    assert run(spark, [body]) == {
        (1, "choices[0]", ""), (1, "choices[0].message.content[0]", "choices[0]"), (1, top, "choices[0]"),
        (1, f"{top}.function.arguments.areas[0]", top), (1, f"{top}.function.arguments.areas[0].evidence[0]", f"{top}.function.arguments.areas[0]"),
    }


def test_bare_lists_and_bad_texts(spark):
    found = run(spark, [[{"a": [[{"b": 1}]]}], None, "{", "", "3", '{"arguments": "no json"}', [1, None], '{"x": NaN}'])
    assert found == {(1, "[0]", ""), (1, "[0].a[0][0]", "[0]")}


def test_empty(spark):
    assert nested.nested_places(spark.createDataFrame([], SCHEMA)).count() == 0


def test_deep_records(spark):
    body = '{"a":[' * 300 + '{"z":1}' + "]}" * 300
    assert len(run(spark, [body])) == 300


def test_equal_objects_are_stored_once(spark):
    rows = [(1, '[{"a":1,"b":[{"c":2}]},{"b":[{"c":2}],"a":1}]', ""), (2, '[{"b":[{"c":2}],"a":1}]', "")]
    bridge = nested.occurrences(spark.createDataFrame(rows, SCHEMA), "response_id", "body")
    assert bridge.count() == 6
    stored = [(r["form"], r["n_places"]) for r in nested.objects(bridge).collect()]
    assert stored == [("object", 3)] * 2
    ids = {r["object_id"] for r in bridge.collect()}
    assert {r["parent_id"] for r in bridge.where("kind = 'b'").collect()} < ids


def test_flat_tables(spark):
    body = {"id": "r", "usage": {"tokens": 3}, "choices": [{"index": 0, "message": {"role": "x", "content": [{"type": "text", "box": [1, 2]}]}, "empty": None}]}
    rows = nested.flat_tables(spark.createDataFrame([(1, json.dumps(body), "")], SCHEMA), "response_id", "body").collect()
    assert {(r["kind"], r["node_path"], r["parent_path"], tuple(sorted(r["fields"].items()))) for r in rows} == {
        ("record", "", None, (("id", "r"), ("usage.tokens", "3"))),
        ("choices", "choices[0]", "", (("index", "0"), ("message.role", "x"))),
        ("content", "choices[0].message.content[0]", "choices[0]", (("box", "[1, 2]"), ("type", "text"))),
    }


def test_every_hash_can_be_resolved(spark):
    body = {"usage": {"n": 1}, "choices": [{"message": {"role": "x", "tags": ["a", None], "arguments": '{"k": [[{"z": 2}]]}'}}]}
    bridge = nested.occurrences(spark.createDataFrame([(1, json.dumps(body), ""), (2, "[[], {}]", "")], SCHEMA), "response_id", "body", every=True)
    rows, stored = bridge.collect(), {r["object_id"]: r["canonical"] for r in nested.objects(bridge).collect()}

    def whole(object_id):
        return json.loads(re.sub(r"#([0-9a-f]{32})", lambda m: json.dumps(whole(m[1])), stored[object_id]))

    body["choices"][0]["message"]["arguments"] = {"k": [[{"z": 2}]]}
    assert [whole(r["object_id"]) for r in rows if r["container_id"] is None] == [body, [[], {}]]
    places = {(r["node_path"], r["kind"], r["ordinal"], r["form"]) for r in rows if r["record_id"] == 1}
    assert {("", "", None, "object"), ("usage", "usage", None, "object"), ("choices", "choices", None, "array"), ("choices[0].message.arguments.k[0]", "k", 0, "array")} < places
    assert len(places) == 10 and {r["container_id"] for r in rows} - {None} <= set(stored)


def test_records_can_be_rebuilt_from_objects(spark):
    shared = {"x": [1, {"y": None}], "z": "ü"}
    bodies = [{"choices": [{"message": shared, "n": 1.5}], "other": shared, "empty": {}, "list": [[], [shared]]}, [shared, 3], {"arguments": json.dumps(shared)}]
    bridge = nested.occurrences(spark.createDataFrame([(i, json.dumps(b), "x") for i, b in enumerate(bodies)], SCHEMA), "response_id", "body", every=True)
    stored = nested.objects(bridge).collect()
    canonical = {r["object_id"]: r["canonical"] for r in stored}
    assert len(canonical) == len(stored)  # each once, under whatever keys it stands

    def rebuild(object_id):
        return json.loads(re.sub(r"#([0-9a-f]{32})", lambda m: json.dumps(rebuild(m[1])), canonical[object_id]))

    roots = {r["record_id"]: r["object_id"] for r in bridge.where("container_id is null").collect()}
    assert [rebuild(roots[i]) for i in range(3)] == [bodies[0], bodies[1], {"arguments": shared}]
