"""Constant maps and arrays as one parsed expression instead of one call per entry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(value) -> str:
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(_text(v) for v in value) + ")"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value}D" if isinstance(value, float) else str(value)


def constant_map(mapping: dict) -> Column:
    return F.expr("map(" + ", ".join(f"{_text(k)}, {_text(v)}" for k, v in mapping.items()) + ")")


def constant_array(values) -> Column:
    return F.expr(_text(list(values)))
