"""Operand values of queries, and custom types written as ``#name(...)``."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

CUSTOM = re.compile(r"^#([a-zA-Z0-9]{3,20})\((.*)\)$", re.DOTALL)


@dataclass(frozen=True)
class CustomType:
    """``parse`` turns the inner text into a comparable Column, NULL where it is invalid."""

    name: str
    parse: Callable[[Column], Column]


def _datetime(inner: Column) -> Column:
    valid = inner.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?$")
    return F.when(valid, inner.try_cast("timestamp_ntz"))


def _time(inner: Column) -> Column:
    """Nanoseconds of the day."""

    def of(x: Column) -> Column:
        valid = x.rlike(r"^([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,9})?)?$")
        fraction = F.rpad(F.regexp_extract(x, r"\.(\d+)$", 1), 9, "0").cast("long")
        digits = lambda at: F.coalesce(F.nullif(F.substring(x, at, 2), F.lit("")), F.lit("0")).cast("long")
        return F.when(valid, (digits(1) * 3600 + digits(4) * 60 + digits(7)) * 1_000_000_000 + fraction)

    return F.get(F.transform(F.array(inner), of), F.lit(0))  # the text is computed once


_REGISTRY: dict[str, CustomType] = {}


def register_custom_type(name: str, parse: Callable[[Column], Column]) -> None:
    if not re.fullmatch("[a-zA-Z0-9]{3,20}", name):
        raise ValueError(f"not a custom type name: {name}")
    _REGISTRY[name] = CustomType(name, parse)


def custom_type(name: str) -> CustomType:
    if name not in _REGISTRY:
        raise ValueError(f"unknown custom type: {name}")
    return _REGISTRY[name]


register_custom_type("datetime", _datetime)
register_custom_type("time", _time)


def custom_parts(value: object) -> tuple[str, str] | None:
    """(type name, inner text) of a custom literal; unknown types are an error."""
    m = CUSTOM.match(value) if isinstance(value, str) else None
    return (custom_type(m[1]).name, m[2]) if m else None


def kind_of(value: object) -> str:
    """null, boolean, number, custom, string, array or object."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int | float):
        return "number"
    if isinstance(value, str):
        return "custom" if custom_parts(value) else "string"
    if isinstance(value, list | tuple):
        return "array"
    if isinstance(value, dict):
        return "object"
    raise TypeError(f"not a JSON value: {value!r}")


def plain(value: object) -> object:
    """Whole floats as integers, at any depth."""
    if isinstance(value, float) and value.is_integer():
        return int(value)
    if isinstance(value, list | tuple):
        return [plain(x) for x in value]
    if isinstance(value, dict):
        return {k: plain(x) for k, x in value.items()}
    return value


def canonical(value: object) -> str:
    """JSON with sorted keys and whole numbers without a fraction: equal values have equal texts."""
    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
