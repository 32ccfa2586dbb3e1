"""JSON texts that the built-in functions cannot take: values of unknown depth, cut streams and raw line ends in strings.
Small helpers over one text each, run as Arrow-batched functions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def flatten_value(value: object) -> str:
    """A caption value as one line: lists joined by '; ', objects as 'key: value; key: value', blanks left out."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, list):
        return "; ".join(t for v in value if (t := flatten_value(v)))
    if isinstance(value, dict):
        return "; ".join(f"{k}: {t}" for k, v in value.items() if (t := flatten_value(v)))
    return re.sub(r"\s+", " ", str(value)).strip()


def partial_string(text: str, field: str) -> str | None:
    """The string value of field in a JSON text that may be cut anywhere, as far as it has come."""
    m = re.search(r'"%s"\s*:\s*"' % re.escape(field), text)
    if not m:
        return None
    body = re.match(r'(?:[^"\\]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*', text[m.end() :])[0]
    return json.loads(f'"{body}"', strict=False)


def repair_newlines(text: str) -> str:
    """Raw line ends and tabs inside the strings of a JSON text written as escapes."""
    escape = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}
    return re.sub(r'"(?:[^"\\]|\\.)*"', lambda m: "".join(escape.get(c, c) for c in m[0]), text, flags=re.S)


def violations(value: object, schema: dict, root: dict | None = None, path: str = "$") -> list[str]:
    """What breaks a subset of JSON Schema: $ref, const, enum, type, anyOf, oneOf, required, properties, items."""
    root = root or schema
    if "$ref" in schema:
        target = root
        for step in schema["$ref"].lstrip("#/").split("/"):
            target = target[step]
        return violations(value, target, root, path)
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "number": (int, float), "integer": int}
    is_kind = lambda k: isinstance(value, kinds[k]) and not (k in ("number", "integer") and isinstance(value, bool))
    out = []
    for word, least, most in (("anyOf", 1, None), ("oneOf", 1, 1)):
        if word in schema:
            fits = sum(not violations(value, s, root, path) for s in schema[word])
            if fits < least or (most is not None and fits > most):
                out.append(f"{path}: {fits} of {word} fit")
    if "const" in schema and value != schema["const"]:
        out.append(f"{path}: not {schema['const']!r}")
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{path}: not in enum")
    named = schema.get("type")
    if named and not any(is_kind(k) for k in ([named] if isinstance(named, str) else named)):
        return [*out, f"{path}: not {named}"]
    if isinstance(value, dict):
        out += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        known = schema.get("properties", {})
        for k, v in value.items():
            if k in known:
                out += violations(v, known[k], root, f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{path}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += violations(v, schema["items"], root, f"{path}[{i}]")
    return out


def _each(f):
    def run(x: pd.Series) -> pd.Series:
        return x.map(f, na_action="ignore")

    return run


def _load(text: str) -> object:
    try:
        return json.loads(text)
    except ValueError:
        return text


def flattened(x: Column) -> Column:
    return F.pandas_udf(_each(lambda t: flatten_value(_load(t))), "string")(x)


def partial(x: Column, field: str) -> Column:
    return F.pandas_udf(_each(lambda t: partial_string(t, field)), "string")(x)


def repaired(x: Column) -> Column:
    return F.pandas_udf(_each(repair_newlines), "string")(x)


def schema_violations(x: Column, schema: dict) -> Column:
    """Array of what breaks the schema in a JSON text; one entry for a text that is no JSON."""
    def check(t: str) -> list[str]:
        try:
            return violations(json.loads(t), schema)
        except ValueError:
            return ["$: not JSON"]

    return F.pandas_udf(_each(check), "array<string>")(x)
