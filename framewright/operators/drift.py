"""Schemas that drift between the files of a family.

Each file's schema is a tree of keys (arrays are not entered). Between successive files of a family the
cheapest edit script is found. A key that both files have under matched objects stays, at no cost. Of the keys that
end and begin below any matched objects one minimum-cost assignment decides which are renamed, which are moved
(the same name below another object) and which are deleted and added; objects it matches are entered in turn. A
rename costs the distance between the kinds of values plus a little for the distance of the names, a move that of the
kinds and MOVE_COST. Siblings are unordered and keys unique, so no general tree edit algorithm is needed.

Files of a family are taken in the order of ``written_at``, then ``file_id``, and numbered by counts of hours. They
are worked on in chunks of ``CHUNK`` files with the last file of the chunk before as a halo. What a chunk cannot
know (the types a field had before it, and the name it began with) comes from a prefix scan over what the chunks
leave behind: summaries of FAN chunks are composed, those of FAN such groups again, and the known fields are
handed down the same way, so no task holds a family, however many files it has.

The scripts are compiled into one projection per file, from the paths in it to canonical names.
"""

from __future__ import annotations

import math
import re
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.jsontext import read_json, write_json
from framewright.operators.graph import components
from framewright.session import cut

CHUNK = 128  #: files of a family handled together
FAN = 128  #: chunks, or groups of chunks, whose summaries are composed together
RENAME_LIMIT = 0.5  #: greatest distance between kinds of values that a rename may have, more for names alike
NAME_WEIGHT = 0.2  #: what names wholly unlike cost, and names wholly alike are worth
MOVE_COST = 0.3
FAMILIES = 2  #: families that must agree on a rename before it joins names of other families
MAX_COLUMNS = 500  #: typed columns of the consistent table; fields beyond the most frequent ones are kept in its map
SEP = "\x1f"


def _type_of(value: object) -> str | None:
    if value is None:
        return None
    return {bool: "boolean", int: "number", float: "number", str: "string", list: "array", dict: "object"}[type(value)]


_NUMERIC = re.compile(r"\s*[-+]?\d+(\.\d+)?\s*")
_DIGIT = re.compile(r"\d")


def _count(kinds: dict, value: object) -> None:
    """Adds one value to the statistics of its JSON type, which add up over values and parts."""
    kind = type(value)
    if kind is str:
        into = kinds.get("string")
        if into is None:
            into = kinds["string"] = {"n": 0, "numeric": 0, "space": 0, "digit": 0, "upper": 0, "length": 0.0, "log": 0.0, "whole": 0}
        into["n"] += 1
        into["length"] += math.log1p(len(value))
        into["upper"] += value[:1].isupper()
        digit = _DIGIT.search(value) is not None
        if " " in value and " " in value.strip():
            into["space"] += 1
        elif digit:
            into["digit"] += 1
        if digit and len(value) < 40 and _NUMERIC.fullmatch(value):
            into["numeric"] += 1
            into["log"] += math.log10(1 + abs(float(value)))
            into["whole"] += "." not in value
    elif kind is int or kind is float:
        into = kinds.get("number")
        if into is None:
            into = kinds["number"] = {"n": 0, "whole": 0, "log": 0.0}
        into["n"] += 1
        into["whole"] += kind is int
        into["log"] += math.log10(1 + min(abs(value), 10**300))
    else:
        name = "boolean" if kind is bool else "array" if kind is list else "object"
        into = kinds.setdefault(name, {"n": 0})
        into["n"] += 1
        if kind is list:
            into["length"] = into.get("length", 0) + math.log1p(len(value))
            for x in value[:1]:
                first = f"of {_type_of(x)}"
                into[first] = into.get(first, 0) + 1
        elif kind is dict:
            for k in value:
                into["key " + k] = into.get("key " + k, 0) + 1


def _add_record(schema: dict, record: dict) -> None:
    todo = [("", record)]
    while todo:
        prefix, fields = todo.pop()
        for key, value in fields.items():
            path = prefix + key
            kinds = schema.get(path)
            if kinds is None:
                kinds = schema[path] = {}
            if value is not None:
                _count(kinds, value)
                if type(value) is dict:
                    todo.append((path + SEP, value))


def _merge(parts: list[str]) -> dict:
    if len(parts) == 1:
        return read_json(parts[0])
    schema: dict = {}
    for part in map(read_json, parts):
        for path, kinds in part.items():
            have = schema.setdefault(path, {})
            for name, kind in kinds.items():
                into = have.setdefault(name, {})
                for k, v in kind.items():
                    into[k] = into.get(k, 0) + v
    return schema


def kind_distance(a: dict, b: dict) -> float:
    """0 (alike) to 1 (unlike) between the kinds of values of two fields."""
    both = set(a) & set(b)
    if not both:
        return 0.5 if not a or not b else 1.0
    worst = 0.0
    for name in both:
        x, y = a[name], b[name]
        mean = lambda k: abs(x.get(k, 0) / x["n"] - y.get(k, 0) / y["n"])  # noqa: B023, E731
        if name == "number" or (name == "string" and x.get("numeric", 0) == x["n"] and y.get("numeric", 0) == y["n"]):
            d = 0.6 * min(1.0, mean("log") / 1.5) + 0.4 * mean("whole")
        elif name == "string":
            parts = [mean("numeric"), mean("space"), mean("digit"), mean("upper"), min(1.0, mean("length") / 1.5)]
            d = 0.6 * max(parts) + 0.4 * sum(parts) / len(parts)
        elif name == "array":
            d = max([min(1.0, mean("length") / 1.5)] + [mean(k) for k in {*x, *y} if k.startswith("of ")])
        elif name == "object":
            keys = {k for k in {*x, *y} if k.startswith("key ")}
            d = 1 - len([k for k in keys if k in x and k in y]) / max(len(keys), 1)
        else:
            d = 0.0
        worst = max(worst, d)
    return worst


@lru_cache(maxsize=1 << 16)
def name_distance(a: str, b: str) -> float:
    words = lambda x: " ".join(re.findall(r"[a-z]+|\d+", re.sub(r"([a-z])([A-Z])", r"\1 \2", x).lower()))
    return 1 - SequenceMatcher(None, words(a), words(b)).ratio()


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Minimum-cost assignment of rows to columns (shortest augmenting paths); every row gets a column, rows <= columns."""
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j = i, 0
        least, way, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            done[j] = True
            reduced = cost[match[j] - 1] - u[match[j]] - v[1:]
            better = ~done[1:] & (reduced < least[1:])
            least[1:][better] = reduced[better]
            way[1:][better] = j
            free = np.where(done, np.inf, least)
            free[0] = np.inf
            k = int(np.argmin(free))
            delta = free[k]
            u[match[done]] += delta
            v[done] -= delta
            least[~done] -= delta
            j = k
            if match[j] == 0:
                break
        while j:
            match[j] = match[way[j]]
            j = way[j]
    return [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]


def _children(schema: dict) -> dict[str, dict[str, str]]:
    """parent path -> {key: path} of each object's fields; the record itself is ''."""
    out: dict[str, dict[str, str]] = {}
    for path in schema:
        parent, _, key = path.rpartition(SEP)
        out.setdefault(parent, {})[key] = path
    return out


def edit_script(old: dict, new: dict) -> tuple[dict[str, str], list[str], list[str]]:
    """The cheapest script between two schemas: {old path: new path} of what is renamed, moved or carried along below
    such an object, what is deleted and what is added; fields of objects that only one of them has are in none."""
    if old.keys() == new.keys():
        return {}, [], []
    left, right = _children(old), _children(new)
    kept: dict[str, str] = {}
    ended: list[str] = []
    begun: list[str] = []
    todo = [("", "")]
    while todo:
        while todo:
            a, b = todo.pop()
            mine, yours = left.get(a, {}), right.get(b, {})
            for key in mine.keys() & yours.keys():
                kept[mine[key]] = yours[key]
                if "object" in old[mine[key]] and "object" in new[yours[key]]:
                    todo.append((mine[key], yours[key]))
            ended += [mine[k] for k in mine.keys() - yours.keys()]
            begun += [yours[k] for k in yours.keys() - mine.keys()]
        for x, y in _renames(old, new, kept, sorted(ended), sorted(begun)).items():
            kept[x] = y
            ended.remove(x)
            begun.remove(y)
            if "object" in old[x] and "object" in new[y]:
                todo.append((x, y))
    return {x: y for x, y in kept.items() if x != y}, sorted(ended), sorted(begun)


def _renames(old: dict, new: dict, kept: dict[str, str], ended: list[str], begun: list[str]) -> dict[str, str]:
    """The cheapest assignment of keys that end to keys that begin, those left out being deleted and added."""
    if not ended or not begun:
        return {}
    n, m = len(ended), len(begun)
    give_up = RENAME_LIMIT + NAME_WEIGHT  # what deleting the one and adding the other costs
    cost = np.full((n, m + n), give_up)
    for i, x in enumerate(ended):
        above, _, mine = x.rpartition(SEP)
        for j, y in enumerate(begun):
            below, _, yours = y.rpartition(SEP)
            names = name_distance(mine, yours)
            kinds = kind_distance(old[x], new[y]) if old[x] and new[y] else names
            if (not above and not below) or kept.get(above) == below:
                cost[i, j] = kinds + NAME_WEIGHT * names if kinds <= RENAME_LIMIT + NAME_WEIGHT * (1 - names) else 10.0
            else:
                cost[i, j] = kinds + MOVE_COST if mine == yours and kinds + MOVE_COST <= RENAME_LIMIT and set(old[x]) & set(new[y]) else 10.0
    return {ended[i]: begun[j] for i, j in assign(cost) if j < m and cost[i, j] < give_up}


def _partial_schemas(batches):
    for rows in batches:
        schemas: dict = {}
        for family, file_id, at, text in zip(rows["family"], rows["file_id"], rows["written_at"], rows["record_json"]):
            entry = schemas.get((family, file_id))
            if entry is None:
                entry = schemas[family, file_id] = [at, {}]
            elif at < entry[0] or (entry[0] != entry[0] and at == at):
                entry[0] = at  # the earliest; rows without a time do not count
            record = read_json(text)
            if isinstance(record, dict):
                _add_record(entry[1], record)
        out = [(family, file_id, at, write_json(schema)) for (family, file_id), (at, schema) in schemas.items()]
        yield pd.DataFrame(out, columns=["family", "file_id", "written_at", "part"]).astype({"file_id": "int64", "written_at": "datetime64[us]"})


def file_schemas(records: DataFrame) -> DataFrame:
    """(family, file_id, seq, files, parts): the schema of each file, in parts, its place in its family from 0, and how
    many files that has. Files are counted by hour, so a task numbers the files of an hour, not of a family."""
    schema = f"family string, file_id long, written_at {dict(records.dtypes)['written_at']}, part string"
    parts = records.select("family", "file_id", "written_at", "record_json").where("family is not null and file_id is not null").mapInPandas(_partial_schemas, schema)
    files = cut(parts.groupBy("family", "file_id").agg(F.min("written_at").alias("written_at"), F.collect_set("part").alias("parts")))
    hour = F.coalesce(F.floor(F.unix_micros(F.col("written_at").cast("timestamp")) / 3_600_000_000), F.lit(-(1 << 40))).alias("hour")
    held = files.select("family", "file_id", "written_at", hour)
    counts = held.groupBy("family", "hour").agg(F.count("*").alias("c"))
    whole = Window.partitionBy("family")
    before = counts.select("family", "hour", (F.sum("c").over(whole.orderBy("hour")) - F.col("c")).alias("start"), F.sum("c").over(whole).alias("files"))
    within = held.select("family", "file_id", "hour", (F.row_number().over(Window.partitionBy("family", "hour").orderBy("written_at", "file_id")) - 1).alias("i"))
    place = within.join(before, ["family", "hour"]).select("family", "file_id", (F.col("start") + F.col("i")).alias("seq"), "files")
    return files.join(place, ["family", "file_id"]).select("family", "file_id", "seq", "files", "parts")


_EVENTS = "family string, chunk long, seq long, file_id long, what string, old_path string, field_path string, types string, root string"
_FRESH = "\x1e"  # joins a path that a rename has set free to the file of the rename, and so tells a later field there from the earlier one


def _chunk_events(batches, fields: bool, size: int):
    """Edit scripts of chunks of files, in order. Beside the drift: 'first' rows hold the types of a field whose
    earlier types lie before the chunk, 'state' rows what the chunk leaves behind of each field, and, with ``fields``,
    'field' rows each path of each file.

    ``root`` is the path a field had before the chunk, as '<path', or a new one where a field that was renamed away
    left its path to another.
    """
    out: list[tuple] = []
    group, one, before = None, True, None
    state: dict[str, tuple[str, str]] = {}  # path -> (types last seen in this chunk or '', root)

    def leave():
        if group and not one:
            out.extend((*group, 0, 0, "state", "", path, types, root) for path, (types, root) in state.items())

    def frame():
        return pd.DataFrame(out, columns=[x.split()[0] for x in _EVENTS.split(", ")]).astype({"chunk": "int64", "seq": "int64", "file_id": "int64"})

    for batch in batches:
        out = []
        for family, at, seq, files, file_id, parts in zip(batch["family"], batch["at"], batch["seq"], batch["files"], batch["file_id"], batch["parts"]):
            if (family, at) != group:
                leave()
                group, one, before, state = (family, at), files <= size, None, {}
            schema = _merge(parts)
            add = lambda what, path, old="", types="", root="": out.append((*group, seq, file_id, what, old, path, types, root))  # noqa: B023, E731
            if before is not None:
                renamed, ended, begun = edit_script(before, schema)
                for path in ended:
                    add("removed", path)
                for path in begun:
                    add("added", path)
                if renamed:
                    moved = {y: state.get(x, ("", "<" + x)) for x, y in renamed.items()}
                    state |= {x: ("", f"{x}{_FRESH}{file_id}") for x in renamed if x not in moved}
                    state |= moved
                for x, y in renamed.items():
                    inherited = any(x.startswith(a + SEP) and y.startswith(b + SEP) and x[len(a) :] == y[len(b) :] for a, b in renamed.items() if a != x)
                    add("carried" if inherited else "renamed", y, old=x)
            if seq // size == at:  # not the halo
                for path, kinds in schema.items():
                    now = ",".join(sorted(kinds)) if len(kinds) > 1 else next(iter(kinds), "")
                    types, root = state.get(path) or ("", "<" + path)
                    if now and types and types != now:
                        add("retyped", path, old=types, types=now)
                    elif now and not types and not one and root[0] == "<":
                        add("first", path, types=now, root=root)
                    state[path] = (now or types, root)
                    if fields:
                        add("field", path, types=now, root=root)
            before = schema
        yield frame()
    out = []
    leave()
    yield frame()


_STATE = "family string, chunk long, path string, types string, root string, known boolean"


def _apply(known: dict, step: dict) -> dict:
    """What is known after a step: path -> (types, root). Roots '<path' refer to what was known before it; a path that
    nothing is known of stands for itself."""
    out = dict(known)
    for path, (types, root) in step.items():
        had = known.get(root[1:], ("", root)) if root.startswith("<") else ("", root)
        out[path] = (types or had[0], had[1])
    return out


def _group_steps(rows: pd.DataFrame) -> dict[int, dict]:
    steps: dict[int, dict] = {}
    for chunk, path, types, root in zip(rows["chunk"], rows["path"], rows["types"], rows["root"]):
        steps.setdefault(chunk, {})[path] = (types, root)
    return dict(sorted(steps.items()))


def _state_rows(family: str, at: list[tuple[int, dict]], known: bool) -> pd.DataFrame:
    out = [(family, chunk, path, types, root, known) for chunk, fields in at for path, (types, root) in fields.items()]
    return pd.DataFrame(out, columns=[x.split()[0] for x in _STATE.split(", ")])


def _compose(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    whole: dict = {}
    for step in _group_steps(rows).values():
        whole = _apply(whole, step)
    return _state_rows(key[0], [(key[1], whole)], False)


def _hand_down(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    known = next(iter(_group_steps(rows[rows["known"]]).values()), {})
    out = []
    for chunk, step in _group_steps(rows[~rows["known"]]).items():
        out.append((chunk, known))
        known = _apply(known, step)
    return _state_rows(key[0], out, True)


def known_before(state: DataFrame) -> DataFrame:
    """(family, chunk, path, types, root): what is known of each field before each chunk, from (family, chunk, path,
    types, root), what each chunk leaves behind; a prefix scan in groups of FAN."""
    levels = [cut(state.select("family", "chunk", "path", "types", "root", F.lit(False).alias("known")))]
    group = F.expr(f"chunk div {FAN}")
    while (levels[-1].agg(F.max("chunk")).first()[0] or 0) >= FAN:
        levels.append(cut(levels[-1].groupBy("family", group.alias("g")).applyInPandas(_compose, _STATE)))
    known = None
    for steps in reversed(levels):
        held = steps.withColumn("g", group)
        if known is not None:
            held = held.unionByName(known.withColumn("g", F.col("chunk")))
        known = held.groupBy("family", "g").applyInPandas(_hand_down, _STATE)
    return known.select("family", "chunk", "path", "types", "root")


def schema_events(records: DataFrame, fields: bool = False) -> DataFrame:
    """All events of the edit scripts, ready to be read more than once; with ``fields`` also each path of each file as
    'field', its ``root`` being the name that the field began with in its family."""
    files = file_schemas(records).withColumn("chunk", F.expr(f"seq div {CHUNK}"))
    shown = files.withColumn("at", F.explode(F.when((F.col("seq") % CHUNK == CHUNK - 1) & (F.col("seq") < F.col("files") - 1), F.array(F.col("chunk"), F.col("chunk") + 1)).otherwise(F.array("chunk"))))
    # the file that closes a chunk is the halo of the next one
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = shown.repartition(n, "family", "at").sortWithinPartitions("family", "at", "seq")  # by number, so that small but costly partitions are not put together
    size = CHUNK
    events = cut(spread.select("family", "at", "seq", "files", "file_id", "parts").mapInPandas(lambda batches: _chunk_events(batches, fields, size), _EVENTS))
    state = events.where("what = 'state'")
    if state.isEmpty():
        return events.withColumn("root", F.regexp_replace("root", "^<", "")).drop("chunk")
    known = cut(known_before(state.select("family", "chunk", F.col("field_path").alias("path"), "types", "root")))
    had = known.select("family", "chunk", F.concat(F.lit("<"), F.col("path")).alias("root"), F.col("types").alias("had"), F.regexp_replace("root", "^<", "").alias("began"))
    open_ = events.where("what in ('first', 'field')").join(had, ["family", "chunk", "root"], "left")
    late = open_.where("what = 'first' and had <> '' and had <> types").select(*events.columns).withColumn("what", F.lit("retyped"))
    named = open_.where("what = 'field'").withColumn("root", F.coalesce("began", F.regexp_replace("root", "^<", ""))).select(*events.columns)
    return events.where("what not in ('first', 'field', 'state')").unionByName(late).unionByName(named).drop("chunk")


def schema_changes(records: DataFrame) -> DataFrame:
    """(file_id, field_path, drift) of every change in a file against the file before it in its family.

    Unreadable and null records, and records that are no objects, have no fields; a file of only such records
    has none at all. Rows without family or file are left out, repeated rows change nothing, files written at
    the same time follow their ids, other columns are ignored and an empty table gives an empty result.
    """
    return schema_events(records).where("what in ('added', 'removed', 'renamed', 'retyped')").select("file_id", F.translate("field_path", SEP, ".").alias("field_path"), F.col("what").alias("drift"))


def file_projections(fields: DataFrame) -> DataFrame:
    """(family, file_id, projection): for each file the canonical name of each of its paths.

    Within a family a field keeps one name through all renames. Names of different families are joined where at
    least FAMILIES families have renamed the one into the other; the one that most files have stands for all. In a
    family where that would give two fields of one file the same name, those fields keep the names they began with.
    """
    named = fields.where("what = 'field'").select("family", "file_id", F.translate("field_path", SEP, ".").alias("path"), F.translate("root", SEP, ".").alias("root"))
    bare = F.split_part("root", F.lit(_FRESH), F.lit(1))
    use = cut(named.groupBy("path", bare.alias("name")).agg(F.count("*").alias("n"), F.countDistinct("family").alias("families")))
    names = use.select(F.col("path").alias("name"), "n").unionByName(use.select("name", F.lit(0).cast("long").alias("n"))).groupBy("name").agg(F.sum("n").alias("n")).withColumn("node", F.xxhash64("name")).withColumn("all", F.lit(0))
    links = use.where((F.col("path") != F.col("name")) & (F.col("families") >= FAMILIES)).select(F.lit(0).alias("all"), F.xxhash64("path").alias("a"), F.xxhash64("name").alias("b"))
    grouped = names.join(components(links, names.select("all", "node"), "all"), ["all", "node"])
    best = grouped.groupBy("root").agg(F.max_by("name", F.struct("n", "name")).alias("target"))
    target = grouped.join(best, "root").select("name", "target")
    aimed = named.withColumn("name", bare).join(target, "name")
    clash = aimed.groupBy("family", "file_id", "target").agg(F.count("*").alias("n")).where("n > 1").select("family", "target", F.lit(True).alias("clash")).distinct()
    own = F.translate("root", _FRESH, "@")
    final = aimed.join(clash, ["family", "target"], "left").withColumn("canonical", F.when(F.col("clash") | F.contains("root", F.lit(_FRESH)), own).otherwise(F.col("target")))
    return final.groupBy("family", "file_id").agg(F.collect_set(F.struct("path", "canonical")).alias("projection"))


_KINDS = {"number": "double", "boolean": "boolean", "string": "string"}


def table_columns(fields: DataFrame, projections: DataFrame) -> list[tuple[str, str]]:
    """(canonical name, type) of the MAX_COLUMNS fields that most files have, objects left out, by name; the type is that of
    most files: double, boolean or string (arrays as JSON text)."""
    each = projections.select("family", "file_id", F.explode("projection").alias("p")).select("family", "file_id", "p.*")
    kinds = fields.where("what = 'field' and types <> 'object'").select("family", "file_id", F.translate("field_path", SEP, ".").alias("path"), "types")
    counted = each.join(kinds, ["family", "file_id", "path"]).groupBy("canonical", "types").agg(F.count("*").alias("n"))
    top = counted.groupBy("canonical").agg(F.sum("n").alias("n"), F.max_by("types", F.struct(F.when(F.col("types") != "", F.col("n")).otherwise(0), "types")).alias("types")).orderBy(F.desc("n"), "canonical").limit(MAX_COLUMNS)
    return sorted((r["canonical"], _KINDS.get(r["types"], "string")) for r in top.toLocalIterator())


def _leaves(record: dict) -> list[tuple[str, object]]:
    out, todo = [], [("", record)]
    while todo:
        prefix, fields = todo.pop()
        for key, v in fields.items():
            if isinstance(v, dict) and v:
                todo.append((f"{prefix}{key}.", v))
            else:
                out.append((prefix + key, v))
    return out


def _typed(value: object, kind: str) -> object:
    """A value as a column's type; None if it is none of that type."""
    if kind == "boolean":
        return value if isinstance(value, bool) else None
    if kind == "double":
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return float(value) if abs(value) < 1e300 else None
        return float(value) if isinstance(value, str) and _NUMERIC.fullmatch(value) and len(value) < 40 else None
    text = value if isinstance(value, str) else write_json(value)
    return text.encode("utf-8", "replace").decode()


def column_name(canonical: str) -> str:
    """A canonical name as a column: dots and the sign of a reused name become underscores."""
    return "f_" + re.sub(r"\W", "_", canonical)


def consistent_records(records: DataFrame) -> DataFrame:
    """(family, file_id, line_no, f_..., rest, null_fields): every readable record once, in typed columns.

    Each file's script is its projection, from the paths in it to canonical names (see ``file_projections``); a
    column is named ``f_`` and the canonical name. A value that is none of its column's type, or whose field has no
    column, or has that of another field, stands in the map ``rest`` under its canonical name, as text; fields that are
    null are listed in ``null_fields``. So no value is lost. Repeated rows are read once; other columns are ignored;
    an empty table gives an empty result.
    """
    fields = schema_events(records, fields=True)
    projections = cut(file_projections(fields))
    columns: dict[str, tuple[str, str]] = {}
    for canonical, kind in table_columns(fields, projections):
        columns.setdefault(column_name(canonical), (canonical, kind))
    place = {canonical: (name, kind) for name, (canonical, kind) in columns.items()}
    one = records.where("family is not null and file_id is not null and line_no is not null").groupBy("family", "file_id", F.col("line_no").cast("long").alias("line_no")).agg(F.max("record_json").alias("record_json"))
    schema = ", ".join(["family string, file_id long, line_no long", *[f"{name} {kind}" for name, (_, kind) in columns.items()], "rest map<string,string>, null_fields array<string>"])
    order = ["family", "file_id", "line_no", *columns, "rest", "null_fields"]

    def project(batches):
        compiled: dict = {}
        for batch in batches:
            out = []
            for family, file_id, line_no, text, projection in zip(batch["family"], batch["file_id"], batch["line_no"], batch["record_json"], batch["projection"]):
                record = read_json(text)
                if not isinstance(record, dict):
                    continue
                if (family, file_id) not in compiled:
                    compiled = {(family, file_id): {p["path"]: p["canonical"] for p in projection}}
                names = compiled[family, file_id]
                row = dict.fromkeys(order)
                row |= {"family": family, "file_id": file_id, "line_no": line_no}
                rest: dict[str, str] = {}
                nulls: list[str] = []
                for path, value in _leaves(record):
                    canonical = names.get(path, path).encode("utf-8", "replace").decode()
                    if value is None:
                        nulls.append(canonical)
                        continue
                    name, kind = place.get(canonical, (None, "string"))
                    typed = _typed(value, kind) if name else None
                    if typed is not None and row[name] is None:
                        row[name] = typed
                    else:
                        while canonical in rest:
                            canonical += "'"
                        rest[canonical] = _typed(value, "string")
                row["rest"], row["null_fields"] = rest, sorted(nulls)
                out.append(row)
            frame = pd.DataFrame(out, columns=order)
            doubles = [name for name, (_, kind) in columns.items() if kind == "double"]
            yield frame.astype({"file_id": "int64", "line_no": "int64"} | dict.fromkeys(doubles, "float64"))

    joined = one.join(projections, ["family", "file_id"]).select("family", "file_id", "line_no", "record_json", "projection")
    return joined.mapInPandas(project, schema)
