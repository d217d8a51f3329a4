"""Field operators and conjunctions as Columns that are true or false, never NULL."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F

from docpipe.functions.access import DocumentAccess, TypedAccess, sure
from docpipe.functions.values import custom_parts, custom_type, kind_of

FIELD_OPERATORS = ("EQUALS", "NOT_EQUALS", "GREATER_THAN", "GREATER_THAN_EQUALS", "SMALLER_THAN", "SMALLER_THAN_EQUALS", "IN", "NOT_IN", "CONTAINS")
CONJUNCTIONS = ("AND", "OR", "XOR", "NOR", "NAND")


@dataclass(frozen=True)
class FieldTest:
    operator: str
    field: str
    value: object


@dataclass(frozen=True)
class Conjunction:
    operator: str
    operands: tuple


Test = FieldTest | Conjunction
Access = TypedAccess | DocumentAccess


def _compared(op: str, field: Column, value: Column) -> Column:
    match op:
        case "EQUALS":
            return sure(field == value)
        case "NOT_EQUALS":
            return sure(field != value)
        case "GREATER_THAN":
            return sure(field > value)
        case "GREATER_THAN_EQUALS":
            return sure(field >= value)
        case "SMALLER_THAN":
            return sure(field < value)
        case "SMALLER_THAN_EQUALS":
            return sure(field <= value)
    return F.lit(False)


def field_test(t: FieldTest, fields: Access) -> Column:
    """A field that is missing or of another type than the operand never matches; a null operand asks for an explicit null."""
    op, path, value = t.operator, t.field, t.value
    kind = kind_of(value)
    if kind == "null":
        return sure(fields.is_null(path))
    if op == "CONTAINS":
        if kind in ("array", "object"):
            return F.lit(False)
        inside = fields.array_has(path, value)
        return inside | sure(fields.text(path).contains(value)) if kind == "string" else inside
    if kind == "array":
        match op:
            case "EQUALS":
                return sure(fields.is_array(path)) & fields.equals(path, value)
            case "NOT_EQUALS":
                return sure(fields.is_array(path)) & ~fields.equals(path, value)
            case "IN":
                return fields.member(path, value)
            case "NOT_IN":
                return sure(fields.present(path)) & ~(fields.is_null(path)) & ~fields.member(path, value)
        return F.lit(False)
    if op in ("IN", "NOT_IN"):
        return F.lit(False)
    if kind == "object":
        same = fields.equals(path, value)
        return sure(fields.is_object(path)) & (same if op == "EQUALS" else ~same) if op in ("EQUALS", "NOT_EQUALS") else F.lit(False)
    if kind == "boolean":
        return _compared(op, fields.boolean(path), F.lit(value)) if op in ("EQUALS", "NOT_EQUALS") else F.lit(False)
    if kind == "number":
        return _compared(op, fields.exact_number(path), F.lit(value))
    if kind == "custom":
        name, inner = custom_parts(value)
        return _compared(op, fields.custom(path, name), custom_type(name).parse(F.lit(inner)))
    # Strings: equality ignores case, and there is no order.
    return _compared(op, F.lower(fields.text(path)), F.lit(value.lower())) if op in ("EQUALS", "NOT_EQUALS") else F.lit(False)


def predicate(t: Test, fields: Access, in_condition: bool = False) -> Column:
    """``in_condition``: the test is the condition of a MAP operator, where NOR and NAND match nothing."""
    if isinstance(t, FieldTest):
        return field_test(t, fields)
    parts = [predicate(x, fields, in_condition) for x in t.operands]
    match t.operator:
        case "AND":
            return reduce(lambda a, b: a & b, parts)
        case "OR":
            return reduce(lambda a, b: a | b, parts)
        case "XOR":
            return reduce(lambda a, b: a + b, [p.cast("int") for p in parts]) == 1
        case "NOR":
            return F.lit(False) if in_condition else ~reduce(lambda a, b: a | b, parts)
        case "NAND":
            return F.lit(False) if in_condition else ~reduce(lambda a, b: a & b, parts)
    raise ValueError(t.operator)
