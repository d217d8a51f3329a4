"""A pipeline of steps, compiled to one DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from docpipe.functions.scalars import Scalar
from docpipe.operators import shaping
from docpipe.plans.steps import Count, Distinct, FieldChange, Filter, GroupBy, Join, Limit, Map, Skip, Sort, Step, parse_steps

Lookup = Callable[[str], DataFrame]


def _counts_only(step: Step, after: Step | None) -> bool:
    """Whether a step's nested rows are only counted: the next MAP takes their SIZE first, and drops them without using them again."""
    field = shaping.GROUP if isinstance(step, GroupBy) else step.into if isinstance(step, Join) else None
    if field is None or not isinstance(after, Map):
        return False
    for n, change in enumerate(after.changes):
        if change.name == field:
            return n > 0 and change.scalar is None and change.condition is None
        if change.condition is not None or change.scalar is None:
            return False
        if change.scalar != Scalar("SIZE", (field,)) and any(isinstance(x, str) and x.split(".")[0] == field or not isinstance(x, str | int | float) for x in change.scalar.operands):
            return False
    return False


def _with_counts(after: Map, field: str) -> Map:
    """SIZE of the rows becomes the count that stands in their place."""
    return Map(tuple(FieldChange(c.name, Scalar("VALUE", (field,)), c.condition) if c.scalar == Scalar("SIZE", (field,)) else c for c in after.changes))


@dataclass(frozen=True)
class Pipeline:
    steps: tuple[Step, ...]

    @classmethod
    def parse(cls, specs: list[dict]) -> Pipeline:
        return cls(parse_steps(specs))

    def apply(self, df: DataFrame, lookup: Lookup | None = None, ties: tuple[str, ...] = ("_id",)) -> DataFrame:
        """``lookup`` gives the collections that JOIN names. Rows of equal sort value are ordered by ``ties``, so that LIMIT and SKIP after SORT are repeatable."""
        steps, at = list(self.steps), 0
        while at < len(steps):
            step = steps[at]
            sizes = _counts_only(step, steps[at + 1] if at + 1 < len(steps) else None)
            if sizes:
                field = shaping.GROUP if isinstance(step, GroupBy) else step.into
                steps[at + 1] = _with_counts(steps[at + 1], field)
            match step:
                case Filter():
                    df = shaping.filtered(df, step.test)
                case Map():
                    df = shaping.mapped(df, step.changes)
                case GroupBy():
                    df = shaping.grouped(df, step.field, sizes)
                case Join():
                    if lookup is None:
                        raise ValueError("JOIN needs a lookup of collections")
                    df = shaping.looked_up(df, lookup(step.collection), step, sizes)
                case Count():
                    df = shaping.counted(df)
                case Distinct():
                    df = shaping.distinct(df, step.field)
                case Sort():
                    df = df.orderBy(*shaping.sort_keys(df, step, list(ties)))
                case Limit():
                    df = df.limit(step.n)
                case Skip():
                    df = df.offset(step.n)
            at += 1
        return df

    @property
    def sorted_at_end(self) -> bool:
        """Whether the result has an order: a SORT, and after it nothing that loses it."""
        for step in reversed(self.steps):
            if isinstance(step, Sort):
                return True
            if isinstance(step, GroupBy | Join | Distinct | Count):
                return False
        return False
