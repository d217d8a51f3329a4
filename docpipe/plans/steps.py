"""Pipeline steps, from their JSON form, with validation."""

from __future__ import annotations

import re
from dataclasses import dataclass

from docpipe.functions.scalars import CASTS, FOLDS, FUNCTIONS, Scalar
from docpipe.operators.predicates import CONJUNCTIONS, FIELD_OPERATORS, Conjunction, FieldTest, Test

NAME = re.compile(r"[a-zA-Z0-9_-]{3,64}")


class InvalidStep(ValueError):
    """A step that can't be run; the text says why. The texts below, names of steps and of their fields are fixed values: clients match them."""


@dataclass(frozen=True)
class Filter:
    test: Test


@dataclass(frozen=True)
class FieldChange:
    """Add ``name`` with a scalar's value, or remove it if there is none."""

    name: str
    scalar: Scalar | None
    condition: Test | None


@dataclass(frozen=True)
class Map:
    changes: tuple[FieldChange, ...]


@dataclass(frozen=True)
class GroupBy:
    field: str


@dataclass(frozen=True)
class Join:
    collection: str
    local: str
    remote: str
    into: str


@dataclass(frozen=True)
class Count:
    pass


@dataclass(frozen=True)
class Distinct:
    field: str | None


@dataclass(frozen=True)
class Limit:
    n: int


@dataclass(frozen=True)
class Skip:
    n: int


@dataclass(frozen=True)
class Sort:
    field: str
    ascending: bool


Step = Filter | Map | GroupBy | Join | Count | Distinct | Limit | Skip | Sort


def _need(ok: object, message: str) -> None:
    if not ok:
        raise InvalidStep(message)


def _text(x: object) -> str | None:
    return x if isinstance(x, str) and x.strip() else None


def parse_test(spec: dict) -> Test:
    _need(isinstance(spec, dict), "FILTER step requires an operator")
    if "fieldOperatorType" in spec or "field" in spec:
        _need(_text(spec.get("field")), "Field operator requires a non-blank field name")
        _need(spec.get("fieldOperatorType") in FIELD_OPERATORS, "Field operator requires a fieldOperatorType")
        return FieldTest(spec["fieldOperatorType"], spec["field"], spec.get("value"))
    _need(spec.get("conjunctionType") in CONJUNCTIONS, "Conjunction operator requires a conjunctionType")
    _need(spec.get("operators"), "Conjunction operator requires at least one nested operator")
    return Conjunction(spec["conjunctionType"], tuple(map(parse_test, spec["operators"])))


def parse_scalar(spec: dict) -> Scalar:
    name = spec.get("type") if isinstance(spec, dict) else None
    _need(name in FUNCTIONS, "MAP ADD_FIELD operator requires a mid-operator")
    if name in FOLDS or name == "CONCAT":
        operands = spec.get("operands") or []
        if name in ("SUBS", "DIVIDE", "POW", "ROOT"):
            _need(len(operands) >= 2, f"{name} operator requires at least two operands")
        _need(operands, f"{name} operator requires at least one operand")
        return Scalar(name, tuple(operands))
    if name in ("ABS", "SIZE"):
        _need(_text(spec.get("operand")), f"{name} operator requires a non-blank operand")
        return Scalar(name, (spec["operand"],))
    _need(_text(spec.get("fieldName")), "CAST operator requires a non-blank fieldName")
    _need(spec.get("toType") in CASTS, "CAST operator requires a toType")
    if spec["toType"] == "JSON_CUSTOM":
        _need(_text(spec.get("customTypeName")), "CAST to JSON_CUSTOM requires a non-blank customTypeName")
    return Scalar("CAST", (spec["fieldName"],), spec["toType"], spec.get("customTypeName"))


def _parse_change(spec: dict) -> FieldChange:
    _need(_text(spec.get("fieldName")), "MAP operator requires a non-blank fieldName")
    condition = parse_test(spec["condition"]) if spec.get("condition") is not None else None
    return FieldChange(spec["fieldName"], parse_scalar(spec["operator"]) if spec.get("operator") is not None else None, condition)


def parse_step(spec: dict) -> Step:
    kind = spec.get("type") if isinstance(spec, dict) else None
    match kind:
        case "FILTER":
            _need(spec.get("operator"), "FILTER step requires an operator")
            return Filter(parse_test(spec["operator"]))
        case "MAP":
            _need(spec.get("operators"), "MAP step requires at least one operator")
            return Map(tuple(map(_parse_change, spec["operators"])))
        case "GROUP_BY":
            _need(_text(spec.get("fieldName")), "GROUP_BY step requires a non-blank fieldName")
            return GroupBy(spec["fieldName"])
        case "JOIN":
            _need(_text(spec.get("joinCollection")), "JOIN step requires a non-blank joinCollection")
            _need(NAME.fullmatch(spec["joinCollection"]), "JOIN joinCollection name must be 3-64 alphanumeric characters, underscores, or hyphens")
            for x in ("localField", "remoteField", "asField"):
                _need(_text(spec.get(x)), f"JOIN step requires a non-blank {x}")
            return Join(spec["joinCollection"], spec["localField"], spec["remoteField"], spec["asField"])
        case "COUNT":
            return Count()
        case "DISTINCT":
            return Distinct(_text(spec.get("fieldName")))
        case "LIMIT":
            _need(spec.get("limit") is not None, "LIMIT step requires a limit value")
            _need(spec["limit"] > 0, "LIMIT step requires a limit greater than 0")
            return Limit(int(spec["limit"]))
        case "SKIP":
            _need(spec.get("skip") is not None, "SKIP step requires a skip value")
            _need(spec["skip"] >= 0, "SKIP step requires a skip value of 0 or greater")
            return Skip(int(spec["skip"]))
        case "SORT":
            _need(_text(spec.get("fieldName")), "SORT step requires a non-blank fieldName")
            _need(isinstance(spec.get("ascending"), bool), "SORT step requires an ascending value")
            return Sort(spec["fieldName"], spec["ascending"])
    raise InvalidStep(f"unknown aggregation step: {kind}")


def parse_steps(specs: list[dict]) -> tuple[Step, ...]:
    steps = tuple(map(parse_step, specs))
    _need(all(not isinstance(s, Count) for s in steps[:-1]), "COUNT must be the last aggregation step")
    return steps


def filter_fields(test: Test) -> list[str]:
    if isinstance(test, FieldTest):
        return [test.field]
    return [f for x in test.operands for f in filter_fields(x)]
