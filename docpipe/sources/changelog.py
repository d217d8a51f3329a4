"""Latest-wins views over a log of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docpipe.functions.access import quoted, unused


def latest(log: DataFrame, key: str, seq: str, deleted: Column | None = None) -> DataFrame:
    """The last change of each key, without keys whose last change is a deletion.

    A maximum, not a window: changes of one key are combined before the shuffle, so a key with very many is no task of its own.
    """
    p = unused(log.columns)
    gone = F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False))
    rest = F.struct(*[F.col(quoted(c)) for c in log.columns if c != key])
    last = log.groupBy(F.col(quoted(key)).alias(key)).agg(F.max_by(F.struct(rest.alias("row"), gone.alias("gone")), F.col(quoted(seq))).alias(p))
    return last.where(~F.col(f"{p}.gone")).select(*[F.col(quoted(key)) if c == key else F.col(f"{p}.row.{quoted(c)}").alias(c) for c in log.columns])
