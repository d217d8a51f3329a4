"""Column names that can't clash with those of a caller's table."""

from __future__ import annotations

from collections.abc import Iterable


def others(columns: Iterable[str], outputs: Iterable[str]) -> list[str]:
    """``columns`` without those named like an output, whatever their case, as Spark compares names."""
    taken = {o.lower() for o in outputs}
    return [c for c in columns if c.lower() not in taken]


def free_prefix(columns: Iterable[str]) -> str:
    """A prefix that no column has."""
    names, out = [c.lower() for c in columns], "_"
    while any(n.startswith(out) for n in names):
        out += "_"
    return out
