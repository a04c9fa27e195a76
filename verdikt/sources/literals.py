"""Literals of policy texts and the types of values."""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import Any

_OPEN, _CLOSE = "{(", "})"


def split_outside(text: str, separator: str) -> list[str]:
    """Parts of text between separators that stand outside braces and parentheses, stripped."""
    parts, depth, start = [], 0, 0
    for at, c in enumerate(text):
        depth += (c in _OPEN) - (c in _CLOSE and depth > 0)
        if c == separator and not depth:
            parts.append(text[start:at])
            start = at + 1
    return [p.strip() for p in (*parts, text[start:])]


def scalar(text: str) -> Any:
    text = text.strip()
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    return float(text) if re.fullmatch(r"-?\d+\.\d+", text) else text


def value(text: str) -> Any:
    """A scalar, or a set written {a b} or {a,b}."""
    text = text.strip()
    if text.startswith("{") and text.endswith("}"):
        return {scalar(t) for t in re.split(r"[\s,]+", text[1:-1]) if t}
    return scalar(text)


def scalar_type(v: Any) -> str:
    for kind, name in ((bool, "bool"), (int, "int"), (float, "float")):
        if isinstance(v, kind):
            return name
    return "string"


def datatype_of(values: Iterable[Any]) -> str:
    """The type that holds all observed values: the same for all, float for numbers, else string; ``set[...]`` around it
    if any is a container. Nothing observed: string."""
    values = [v for v in values if v is not None]
    items = [x for v in values for x in (v if isinstance(v, (set, list, tuple)) else (v,))]
    kinds = {scalar_type(x) for x in items}
    base = kinds.pop() if len(kinds) == 1 else "float" if kinds == {"int", "float"} else "string"
    return f"set[{base}]" if any(isinstance(v, (set, list, tuple)) for v in values) else base


def spark_value(v: Any, base: str) -> Any:
    """A value as its column stores it: sets sorted, numbers widened, anything else in a string column as text."""
    if v is None:
        return None
    if isinstance(v, set):
        return sorted((spark_value(x, base) for x in v), key=lambda x: (str(type(x)), x))
    if isinstance(v, (list, tuple)):
        return [spark_value(x, base) for x in v]
    if base == "float":
        return float(v)
    return v if base != "string" or isinstance(v, str) else str(v)
