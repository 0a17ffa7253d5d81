"""Replies of a model as untrusted tables: JSON recovered from text, and coerced to a schema."""

from __future__ import annotations

import json
import re
from math import floor
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.session import prepare

_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.IGNORECASE | re.DOTALL)
_CLOSER = {"{": "}", "[": "]"}


def _structure(text: str, start: int):
    """(place, sign, open closers) at each structural sign outside strings."""
    stack: list[str] = []
    quoted = escaped = False
    for i in range(start, len(text)):
        c = text[i]
        if quoted:
            quoted, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in _CLOSER:
            stack.append(_CLOSER[c])
            yield i, c, stack
        elif c in "}]":
            if stack:
                stack.pop()
            yield i, c, stack
        elif c == ",":
            yield i, c, stack


def balanced_value(text: str) -> str | None:
    """The first object or array of a text that is closed again, or None."""
    start = re.search(r"[{\[]", text)
    if not start:
        return None
    for i, c, stack in _structure(text, start.start()):
        if c in "}]" and not stack:
            return text[start.start() : i + 1]
    return None


def repair_truncated(text: str) -> str | None:
    """A cut-off value made whole: back to the last comma between elements, then what is open there is closed. None if nothing is open."""
    cut, closers, still_open = None, "", False
    for i, c, stack in _structure(text, 0):
        if c == "," and stack:
            cut, closers = i, "".join(reversed(stack))
        still_open, last = bool(stack), "".join(reversed(stack))
    if not still_open:
        return None
    return text[:cut] + closers if cut is not None else text.rstrip(", \t\r\n") + last


def extract_json(raw: str | None) -> Any:
    """The value in a reply: whole, in a code fence, embedded in prose, or cut off. ValueError if there is none."""
    text = (raw or "").strip()
    fence = _FENCE.search(text)
    text = fence[1].strip() if fence else text
    start = re.search(r"[{\[]", text)
    for candidate in (text, balanced_value(text), repair_truncated(text[start.start() :]) if start else None):
        if candidate is not None:
            try:
                return json.loads(candidate)
            except ValueError:
                continue
    raise ValueError("no JSON value")


def coerce(value: Any, schema: dict, path: str = "$", strict: bool = True) -> Any:
    """value made to fit a schema, or ValueError naming the place that can't.

    schema: type (object, array, string, number, boolean) with props, required,
    of, min, max, enum, integer, default, optional. Unknown keys go, bad
    elements of arrays are dropped, numbers are clamped, strings trimmed and
    cut. strict: text without a digit is no number; otherwise it is 0.
    """
    kind = schema["type"]
    if value is None:
        if "default" in schema or schema.get("optional"):
            return schema.get("default")
        raise ValueError(f"{path} is required")
    if kind == "object":
        if not isinstance(value, dict):
            raise ValueError(f"{path} must be an object")
        return {k: coerce(value.get(k), s if k in schema.get("required", ()) else {"optional": True} | s, f"{path}.{k}", strict) for k, s in schema["props"].items()}
    if kind == "array":
        if not isinstance(value, list):
            raise ValueError(f"{path} must be an array")
        kept = []
        for i, x in enumerate(value):
            try:
                kept.append(coerce(x, schema["of"], f"{path}[{i}]", strict))
            except ValueError:
                continue
        if len(kept) < schema.get("min", 0):
            raise ValueError(f"{path} needs {schema['min']} items")
        return kept[: schema["max"]] if "max" in schema else kept
    if kind == "boolean":
        return value if isinstance(value, bool) else {"true": True, "false": False}.get(value, schema.get("default", bool(value))) if isinstance(value, str) else schema.get("default", bool(value))
    fallback = lambda: schema["default"] if "default" in schema else _fail(path)
    if kind == "number":
        return _number(value, schema, fallback, strict)
    text = (value if isinstance(value, str) else json.dumps(value)).strip()
    if "enum" in schema and text not in schema["enum"]:
        return next((e for e in schema["enum"] if e.lower() == text.lower()), None) or fallback()
    if len(text) < schema.get("min", 0):
        return fallback()
    return text[: schema["max"]] if "max" in schema else text


def _fail(path: str) -> Any:
    raise ValueError(f"{path} does not fit")


def _number(value: Any, schema: dict, fallback, strict: bool) -> Any:
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        number = float(value)
    else:
        kept = re.sub(r"[^\d.+-]", "", value if isinstance(value, str) else "")
        try:
            number = 0.0 if not kept and not strict else float(kept)
        except ValueError:
            return fallback()
    if number != number or number in (float("inf"), float("-inf")):
        return fallback()
    number = float(floor(number + 0.5)) if schema.get("integer") else number
    number = max(number, schema["min"]) if "min" in schema else number
    number = min(number, schema["max"]) if "max" in schema else number
    return int(number) if number == floor(number) else number


def recover_replies(replies: DataFrame, schema: dict, strict: bool = True) -> DataFrame:
    """replies with value (JSON text of the coerced reply or null) and error (why not, or null). replies has a column raw."""
    prepare(replies.sparkSession)

    @F.udf(returnType="value string, error string", useArrow=True)
    def recover(raw):
        try:
            return json.dumps(coerce(extract_json(raw), schema, strict=strict), sort_keys=True, ensure_ascii=False), None
        except ValueError as e:
            return None, str(e)

    return replies.withColumn("r", recover(F.col("raw"))).select(*replies.columns, "r.value", "r.error")
