"""JSON texts of any depth, read and written on the Python side."""

from __future__ import annotations

import json
import re

_TOKEN = re.compile(r"[ \t\n\r]*(?:([\[\]{},:])|(\"(?:[^\"\\\x00-\x1f]|\\.)*\")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null))")


def _no_constant(text: str) -> float:
    raise ValueError(f"not JSON: {text}")


def _deep(text: str) -> object:
    """Reads a text nested too deeply for the standard reader; containers being read are kept on a stack."""
    stack: list[tuple[object, object]] = []  # (container, key that waits for its value)
    here: object = None
    key: object = None
    at, end, state = 0, len(text.rstrip(" \t\n\r")), "value"
    while True:
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError("not JSON")
        at = m.end()
        sign = m.group(1)
        if state in ("value", "first item") and sign in ("{", "["):
            stack.append((here, key))
            here, key = ({}, None) if sign == "{" else ([], None)
            state = "first key" if sign == "{" else "first item"
            continue
        if (sign == "}" and state in ("first key", "after") and isinstance(here, dict)) or (sign == "]" and state in ("first item", "after") and isinstance(here, list)):
            value = here
            here, key = stack.pop()
        elif state in ("first key", "key") and m.group(2):
            key = json.loads(m.group(2))
            colon = _TOKEN.match(text, at)
            if not colon or colon.group(1) != ":":
                raise ValueError("not JSON")
            at, state = colon.end(), "value"
            continue
        elif sign == "," and state == "after":
            state = "key" if isinstance(here, dict) else "value"
            continue
        elif state in ("value", "first item") and not sign:
            value = json.loads(m.group(2) or m.group(3))
        else:
            raise ValueError("not JSON")
        if here is None:
            if at < end:
                raise ValueError("not JSON")
            return value
        if isinstance(here, dict):
            here[key] = value
        else:
            here.append(value)
        state = "after"


def read_json(text: str | None) -> object | None:
    """The value of a JSON text; None if there is none that can be read (NaN and Infinity are not JSON). Depth is
    bounded by memory only."""
    if text is None:
        return None
    try:
        return json.loads(text, parse_constant=_no_constant)
    except RecursionError:
        try:
            return _deep(text)
        except ValueError:
            return None
    except ValueError:
        return None


def write_json(value: object) -> str:
    """The JSON text of a value of any depth."""
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        pass
    out: list[str] = []
    todo: list[tuple[str, object]] = [("value", value)]
    while todo:
        what, v = todo.pop()
        if what == "text":
            out.append(v)
        elif isinstance(v, (dict, list)):
            pairs = [(json.dumps(k, ensure_ascii=False) + ": ", x) for k, x in v.items()] if isinstance(v, dict) else [("", x) for x in v]
            parts: list[tuple[str, object]] = [("text", "{" if isinstance(v, dict) else "[")]
            for i, (name, x) in enumerate(pairs):
                parts += [("text", (", " if i else "") + name), ("value", x)]
            todo += reversed([*parts, ("text", "}" if isinstance(v, dict) else "]")])
        else:
            out.append(json.dumps(v, ensure_ascii=False))
    return "".join(out)
