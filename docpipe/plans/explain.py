"""Diagnostics of a pipeline: which indexed fields it can use, how many documents a scan reads, and advice."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame

from docpipe.plans.steps import Distinct, Filter, GroupBy, Join, Sort, Step, filter_fields


@dataclass
class Analysis:
    startTime: int = 0
    endTime: int = 0
    durationMillis: int = 0
    indexUsed: bool = False
    indexesUsed: list[str] = field(default_factory=list)
    documentsScanned: int = 0
    locksAcquired: list[str] = field(default_factory=list)
    suggestions: list[str] = field(default_factory=list)

    def as_dict(self) -> dict:
        return asdict(self)


def step_fields(step: Step) -> list[str]:
    match step:
        case Filter():
            return filter_fields(step.test)
        case Sort() | GroupBy():
            return [step.field]
        case Join():
            return [step.remote]
        case Distinct() if step.field:
            return [step.field]
    return []


#: The sentences of advice.
NO_INDEX, CONSIDER = "No index was used for this query.", " Consider creating an index on: {}."
MOVE_FILTER = "FILTER step on field '{}' at step {} is not the first step; move it to the top of the pipeline so it can use an index and reduce documents scanned."


def suggestions(steps: tuple[Step, ...], index_used: bool) -> list[str]:
    out = []
    if not index_used:
        fields = list(dict.fromkeys(f for s in steps for f in step_fields(s)))
        out.append(NO_INDEX + (CONSIDER.format(", ".join(fields)) if fields else ""))
    for n, s in enumerate(steps):
        if n and isinstance(s, Filter):
            out.append(MOVE_FILTER.format(", ".join(dict.fromkeys(filter_fields(s.test))), n + 1))
    return out


class Stopwatch:
    def __init__(self) -> None:
        self.start = int(time.time() * 1000)

    def stop(self, analysis: Analysis) -> Analysis:
        analysis.startTime, analysis.endTime = self.start, int(time.time() * 1000)
        analysis.durationMillis = analysis.endTime - analysis.startTime
        return analysis


def physical_plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().toString()
