"""JSON in text replies: taken out of fences and prose, and held against a schema."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def json_text(c: Column) -> Column:
    """The JSON of a reply: of a fenced block, the whole text, or from its first opening to its last closing brace; null where none parses."""
    bare = F.regexp_extract(c, r"(?s)\A\s*(?:```[^\n]*\n)?(.*?)\s*(?:```)?\s*\z", 1)
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    parses = lambda x: F.try_parse_json(x).isNotNull()
    return F.when(parses(bare), bare).when((inner != "") & parses(inner), inner)


_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "number": (int, float)}


def first_problem(value, schema: dict) -> str | None:
    """Where a value first departs from a schema of types, required fields, properties and items; None if nowhere."""
    left = [("", value, schema)]
    while left:
        path, v, s = left.pop()
        kind = s.get("type")
        if kind in _KINDS and (not isinstance(v, _KINDS[kind]) or (kind == "number" and isinstance(v, bool))):
            return f"{path or '/'}: not of type {kind}"
        if kind == "object":
            if missing := [k for k in s.get("required", ()) if k not in v]:
                return f"{path}/{missing[0]}: missing"
            left += [(f"{path}/{k}", v[k], p) for k, p in reversed((s.get("properties") or {}).items()) if v.get(k) is not None]
        if kind == "array" and isinstance(s.get("items"), dict):
            left += [(f"{path}/{i}", x, s["items"]) for i, x in reversed(list(enumerate(v)))]
    return None


def schema_problem(c: Column, schema: dict) -> Column:
    """The first problem of a reply's JSON text, `no JSON` where there is none, null where it keeps the schema."""

    @F.pandas_udf("string")
    def check(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: "no JSON" if t is None else first_problem(json.loads(t), schema))

    return check(c)
