"""Deeply nested JSON records as related flat tables with Merkle identities.

Every object is canonicalised bottom-up (sorted keys, child objects and arrays replaced by their hashes) and
hashed; equal objects have equal hashes wherever they stand. ``occurrences`` is the bridge: one row per place
with its path, ordinal, own hash and that of the object around it, and with ``every`` also one for each object under
a key and each array, so that every hash in a canonical form can be looked up. ``objects`` stores each distinct
object once.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.operators.drift import read_json

_OCCURRENCES = "record_id long, node_path string, parent_path string, kind string, ordinal int, object_id string, parent_id string, canonical string"
_EVERY = f"{_OCCURRENCES}, form string, container_id string"


def _scalar(value: object) -> str:
    return json.dumps(value, ensure_ascii=True)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:32]


def _clean(text: str | None) -> str | None:
    """Text that can be stored: lone surrogates become question marks."""
    return text if text is None or text.isascii() else text.encode("utf-8", "replace").decode()


def walk(record: object, every: bool = False) -> list[tuple]:
    """(path, path of the nearest array-element object around it, kind, ordinal, hash, hash of that parent,
    canonical form, hash of the object or array it stands in directly, the object itself) of each object that is an
    element of an array, in order of place; with ``every`` of every object and array, the record among them.

    ``kind`` is the key of the array it stands in ('' for a bare list), or the key it stands under itself. Strings under a key ``arguments`` are
    entered if they are JSON objects or arrays. The walk keeps its own stack, so depth is bounded by memory.
    """
    rows: list[list] = []
    hashes: dict[int, str] = {}
    todo: list[tuple] = [(record, "", "", None, "", None, None)]
    order: list[tuple] = []
    while todo:
        value, path, key, index, parent_path, parent_row, container = todo.pop()
        row = None
        element = index is not None and isinstance(value, dict)
        if element or (every and isinstance(value, (dict, list))):
            row = len(rows)
            rows.append([path, parent_path, key, index, None, parent_row, None, container, value])
        if isinstance(value, dict):
            order.append((value, row))
            inner_path, inner_row = (path, row) if element else (parent_path, parent_row)
            for k in reversed(list(value)):
                v = value[k]
                if k == "arguments" and isinstance(v, str):
                    inside = read_json(v)
                    if not isinstance(inside, (dict, list)):
                        continue
                    value[k] = v = inside
                if isinstance(v, (dict, list)):
                    todo.append((v, f"{path}.{k}" if path else k, k, None, inner_path, inner_row, row))
        elif isinstance(value, list):
            order.append((value, row))
            for i in range(len(value) - 1, -1, -1):
                if isinstance(value[i], (dict, list)):
                    todo.append((value[i], f"{path}[{i}]", key, i, parent_path, parent_row, row))
    for value, row in reversed(order):
        if isinstance(value, dict):
            body = "{" + ",".join(f"{_scalar(k)}:{hashes[id(v)] if isinstance(v, (dict, list)) else _scalar(v)}" for k, v in sorted(value.items())) + "}"
        else:
            body = "[" + ",".join(hashes[id(v)] if isinstance(v, (dict, list)) else _scalar(v) for v in value) + "]"
        hashes[id(value)] = f"#{_digest(body)}"
        if row is not None:
            rows[row][4], rows[row][6] = hashes[id(value)][1:], body
    hash_of = lambda row: rows[row][4] if row is not None else None
    return [(p, pp, k, i, h, hash_of(pr), c, hash_of(at), v) for p, pp, k, i, h, pr, c, at, v in rows]


def occurrences(records: DataFrame, id_column: str, json_column: str, every: bool = False) -> DataFrame:
    """The bridge table of all readable records: every array-element object with its place and its parent's.

    With ``every``, each object and array has a row, told apart by ``form``, with the hash of what it stands in
    directly (``container_id``, null for the record itself); those under a key have no ordinal and the key as kind.
    Repeated rows of an id are read once (the largest text, should they differ). Null ids and null or
    unreadable texts have no objects; an empty table gives an empty result; other columns are ignored.
    """
    one = records.where(F.col(id_column).isNotNull() & F.col(json_column).isNotNull()).groupBy(F.col(id_column).cast("long").alias("record_id")).agg(F.max(json_column).alias("body"))

    def flatten(batches):
        for batch in batches:
            out = []
            for record_id, body in zip(batch["record_id"], batch["body"]):
                for p, pp, k, i, h, ph, c, at, node in walk(read_json(body), every):
                    row = (record_id, _clean(p), _clean(pp), _clean(k), i, h, ph, _clean(c))
                    out.append((*row, "array" if isinstance(node, list) else "object", at) if every else row)
            frame = pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])
            yield frame.astype({"record_id": "int64", "ordinal": "Int32"})

    schema = _EVERY if every else _OCCURRENCES
    return one.mapInPandas(flatten, schema)


def _scalars(node: dict) -> dict[str, str]:
    """The fields of an object that are no objects of their own table: scalars and arrays without objects, those of
    objects directly inside it under dotted names. Null fields are left out."""
    out: dict[str, str] = {}
    todo = [(node, "")]
    while todo:
        value, prefix = todo.pop()
        for k, v in value.items():
            if isinstance(v, dict):
                todo.append((v, f"{prefix}{k}."))
            elif isinstance(v, list):
                if not any(isinstance(x, (dict, list)) for x in v):
                    out[prefix + k] = _scalar(v)
            elif v is not None:
                out[prefix + k] = v if isinstance(v, str) else _scalar(v)
    return out


_FLAT = "record_id long, node_path string, parent_path string, kind string, ordinal int, fields string"


def flat_tables(records: DataFrame, id_column: str, json_column: str) -> DataFrame:
    """(record_id, node_path, parent_path, kind, ordinal, fields): one table for each kind of object, told apart by
    ``kind`` (the key of the array the objects stand in), with their own fields as text.

    The record itself, if it is an object, is the row with an empty path and the kind ``record``; otherwise as
    ``occurrences``.
    """
    one = records.where(F.col(id_column).isNotNull() & F.col(json_column).isNotNull()).groupBy(F.col(id_column).cast("long").alias("record_id")).agg(F.max(json_column).alias("body"))

    def flatten(batches):
        for batch in batches:
            out = []
            for record_id, body in zip(batch["record_id"], batch["body"]):
                record = read_json(body)
                places = walk(record)
                if isinstance(record, dict):
                    out.append((record_id, "", None, "record", None, _clean(json.dumps(_scalars(record)))))
                out += [(record_id, _clean(p), _clean(pp), _clean(k), i, json.dumps(_scalars(node))) for p, pp, k, i, *_, node in places]
            frame = pd.DataFrame(out, columns=[x.split()[0] for x in _FLAT.split(", ")])
            yield frame.astype({"record_id": "int64", "ordinal": "Int32"})

    return one.mapInPandas(flatten, _FLAT).withColumn("fields", F.from_json("fields", "map<string,string>"))


def objects(bridge: DataFrame) -> DataFrame:
    """(object_id, form, canonical, n_places): each distinct object and array once, wherever and under whatever keys it
    stands; places, keys (``kind``) and ordinals are on the bridge. Of a bridge with ``every``, each '#hash' in a canonical
    form is the id of another row, so any record can be rebuilt from its root.

    Counting before the shuffle keeps an object that fills a third of all places from weighing on one task.
    """
    form = F.when(F.startswith("canonical", F.lit("[")), "array").otherwise("object")
    return bridge.groupBy("object_id", form.alias("form"), "canonical").agg(F.count("*").alias("n_places"))


def nested_places(responses: DataFrame) -> DataFrame:
    """(response_id, node_path, parent_path) of every object that is an element of an array in a body."""
    return occurrences(responses, "response_id", "body").select(F.col("record_id").alias("response_id"), "node_path", "parent_path")
