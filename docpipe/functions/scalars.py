"""The scalar functions of MAP. Each gives a Column and the kind of its value."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from docpipe.functions.access import DocumentAccess, TypedAccess, number_text
from docpipe.functions.values import canonical, custom_type, kind_of

FOLDS = ("SUM", "SUBS", "MULTIPLY", "DIVIDE", "POW", "ROOT", "AVG", "MAX", "MIN")
FUNCTIONS = (*FOLDS, "CONCAT", "ABS", "SIZE", "CAST")
CASTS = ("NUMBER", "STRING", "BOOLEAN", "JSON_CUSTOM")
#: Where MAX and MIN start.
MAX_START, MIN_START = -2147483648, 2147483647
#: Fixed value: what marks a literal text among the operands of CONCAT.
LITERAL_MARK = "-"

Access = TypedAccess | DocumentAccess


@dataclass(frozen=True)
class Scalar:
    """``operands``: numbers and paths; for ABS, SIZE and CAST one path."""

    function: str
    operands: tuple
    to_type: str | None = None
    custom: str | None = None


def _divide(n: Column, d: Column) -> Column:
    """As IEEE 754 has it."""
    by_zero = F.when(n > 0, math.inf).when(n < 0, -math.inf).otherwise(math.nan)
    return F.when(d == 0, by_zero).otherwise(n / F.nullif(d, F.lit(0.0)))


_STEPS: dict[str, Callable[[Column, Column], Column]] = {
    "SUBS": lambda a, x: a - x,
    "MULTIPLY": lambda a, x: a * x,
    "DIVIDE": _divide,
    "POW": lambda a, x: F.pow(a, x),
    "ROOT": lambda a, x: F.pow(a, _divide(F.lit(1.0), x)),
}


def _numbers(operands: tuple, fields: Access) -> list[tuple[Column, bool]]:
    """(value or NULL, whether it is a literal)."""
    out = []
    for x in operands:
        kind = kind_of(x)
        if kind == "number":
            out.append((F.lit(float(x)), True))
        elif kind == "string":
            out.append((fields.number(x), False))
    return out


def _fold(s: Scalar, fields: Access) -> Column:
    values = _numbers(s.operands, fields)
    if s.function == "SUM":
        return sum((F.coalesce(v, F.lit(0.0)) for v, _ in values), F.lit(0.0))
    if s.function == "AVG":
        total = sum((F.coalesce(v, F.lit(0.0)) for v, _ in values), F.lit(0.0))
        n = sum((v.isNotNull().cast("int") for v, _ in values), F.lit(0))
        return _divide(total, n.cast("double"))
    if s.function in ("MAX", "MIN"):
        start = F.lit(float(MAX_START if s.function == "MAX" else MIN_START))
        return (F.greatest if s.function == "MAX" else F.least)(start, *[v for v, _ in values]) if values else start
    # The running value starts at 0, and a field met while it is 0 is added: that is how the first operand gets in.
    step = _STEPS[s.function]

    def met(acc: Column, v: Column) -> Column:
        return F.when(v.isNull(), acc).when(acc == 0, acc + v).otherwise(step(acc, v))

    if len(values) <= 3:
        acc = F.lit(0.0)
        for v, literal in values:
            acc = step(acc, v) if literal else met(acc, v)
        return acc
    # Unrolled, the expression would grow with a power of the operands.
    items = F.array(*[F.struct(v.alias("v"), F.lit(literal).alias("literal")) for v, literal in values])
    return F.aggregate(items, F.lit(0.0), lambda acc, x: F.when(x["literal"], step(acc, x["v"])).otherwise(met(acc, x["v"])))


def _concat(s: Scalar, fields: Access) -> Column:
    parts = []
    for x in s.operands:
        kind = kind_of(x)
        if kind in ("string", "custom") and x.startswith(LITERAL_MARK):
            parts.append(F.lit(x[1:]))
        elif kind == "string":
            parts.append(F.coalesce(fields.json_text(x), F.lit("null")))
        elif kind == "custom":
            parts.append(F.lit(x[x.index("(") + 1 : -1]))
        elif kind == "array":
            parts += [F.lit(y if isinstance(y, str) else canonical(y)) for y in x if kind_of(y) not in ("array", "object", "null")]
        else:
            parts.append(F.lit(canonical(x)))
    return F.concat(*parts)


def _cast(s: Scalar, fields: Access) -> tuple[Column, str]:
    path = s.operands[0]
    number, text, boolean = fields.number(path), fields.text(path), fields.boolean(path)
    match s.to_type:
        case "NUMBER":
            return F.coalesce(number, F.trim(text).try_cast("double")), "number"
        case "STRING":
            return F.coalesce(text, fields.custom_text(path), number_text(number), boolean.cast("string")), "string"
        case "BOOLEAN":
            return F.coalesce(boolean, F.lower(text) == "true", number != 0), "boolean"
        case "JSON_CUSTOM":
            kind = custom_type(s.custom)
            if isinstance(fields, TypedAccess):
                return F.coalesce(fields.custom(path, s.custom), kind.parse(text)), "custom"
            inner = F.coalesce(F.when(fields.custom(path, s.custom).isNotNull(), fields.custom_text(path)), F.when(kind.parse(text).isNotNull(), text))
            return F.concat(F.lit(f"#{s.custom}("), inner, F.lit(")")), "custom"
    raise ValueError(s.to_type)


def scalar(s: Scalar, fields: Access) -> tuple[Column, str]:
    """The value, NULL where it has none, and its kind: number, string, boolean or custom."""
    if s.function in FOLDS:
        return _fold(s, fields), "number"
    match s.function:
        case "CONCAT":
            return _concat(s, fields), "string"
        case "ABS":
            return F.abs(fields.number(s.operands[0])), "number"
        case "SIZE":
            return fields.size(s.operands[0]).cast("int"), "number"
        case "CAST":
            return _cast(s, fields)
        case "VALUE":  # only made by rewrites: a count that stands where SIZE of rows was asked for
            return fields.number(s.operands[0]).cast("int"), "number"
    raise ValueError(s.function)
