"""Balanced shards by Karmarkar-Karp differencing of indivisible groups.

A *partial partition* is one way to deal some groups into k sets; its spread is the largest sum less the smallest. The two with
the largest spread are combined again and again, the one's largest set with the other's smallest, until one is left. Groups
(rows of equal text) are dealt by hash to parts of bounded size; each part is differenced in one task, and the parts' own
partial partitions, k sums each, are differenced in the same way in rounds until one is left, which fixes the shard of every
set of every part. A group as large as the mean of what is left gets a shard to itself first, as a text of very many copies does;
else its shard would have to take a set of every part besides.

Defined results: a null text has no bytes and CRC 0, and null texts are one group; rows of equal text always share a shard;
repeated rows and null ids are kept; groups of equal size go by their hash, rows of equal order by theirs, and rows equal in both
get slots in any order; a very long text is one row whose size counts; an empty table gives no rows; shards may stay empty if
there are fewer groups; the text is not kept, other columns are, except that those named like an output are replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from docpipe.llm.names import free_prefix, others
from docpipe.llm.storage import ship, written

LAW = "bytes"


def difference(items: list[list[tuple[int, tuple]]], k: int) -> list[tuple[int, list]]:
    """Karmarkar-Karp on partial partitions. Each item lists up to k (sum, members); returns k (sum, members), smallest first.

    Members are kept as nested pairs while sets are combined, so that a combination costs k steps, and are unfolded at the end.
    """
    heap = []
    for n, item in enumerate(items):
        sets = sorted(([(0, None)] * (k - len(item)) + [(s, (m,)) for s, m in item]), key=lambda x: x[0])
        heap.append((sets[0][0] - sets[-1][0], n, sets))
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        joined = sorted(((x[0] + y[0], (x[1], y[1]) if x[1] and y[1] else x[1] or y[1]) for x, y in zip(a, reversed(b), strict=True)), key=lambda x: x[0])
        low = joined[0][0]
        heapq.heappush(heap, (low - joined[-1][0], count, joined))
        count += 1
    return [(s, list(_unfold(m))) for s, m in heap[0][2]] if heap else [(0, [])] * k


def _unfold(tree: tuple | None) -> Iterator:
    todo = [tree] if tree else []
    while todo:
        x = todo.pop()
        if len(x) == 1:
            yield x[0]
        else:
            todo += x


def _rounds(parts: DataFrame, k: int, fan_in: int) -> DataFrame:
    """From (part, set_no, bytes) for every part to (part, set_no, shard), in rounds of ``fan_in`` parts for each task."""

    def combine(frame: pd.DataFrame) -> pd.DataFrame:
        items = [[(int(r.bytes), (int(r.part), int(r.set_no))) for r in g.itertuples()] for _, g in frame.sort_values(["part", "set_no"]).groupby("part")]
        rows = [(frame["up"].iloc[0], n, s, p, q) for n, (s, m) in enumerate(difference(items, k)) for p, q in m]
        return pd.DataFrame(rows, columns=["part", "set_no", "bytes", "from_part", "from_set"])

    now, up = parts.select("part", "set_no", "bytes", F.col("part").alias("low_part"), F.col("set_no").alias("low_set")), parts.select("part", "set_no", "bytes")
    n = parts.agg(F.max("part")).first()[0]
    while n:
        grouped = up.withColumn("up", F.floor(F.col("part") / fan_in).cast("long"))
        made = written(grouped.groupBy("up").applyInPandas(combine, "part long, set_no long, bytes long, from_part long, from_set long"), "shard-sums")
        step = made.select(F.col("from_part").alias("part"), F.col("from_set").alias("set_no"), F.col("part").alias("_part"), F.col("set_no").alias("_set"))
        now = now.join(step, ["part", "set_no"]).select(F.col("_part").alias("part"), F.col("_set").alias("set_no"), "low_part", "low_set")
        up = made.select("part", "set_no", "bytes").distinct()
        n //= fan_in
    return now.select(F.col("low_part").alias("part"), F.col("low_set").alias("from_set"), F.col("set_no").cast("int").alias("shard"))


def _alone(largest: list, total: int, k: int) -> list:
    """Of the largest groups, in order, those that get a shard to themselves."""
    out = []
    for g in largest:
        if len(out) == k - 1 or g["bytes"] * (k - len(out)) < total:
            break
        out.append(g)
        total -= g["bytes"]
    return out


def assign(docs: DataFrame, shards: int = 24, text: str = "text", order: Column | None = None, groups_in_part: int = 100_000, fan_in: int = 256, rows_in_part: int = 200_000) -> DataFrame:
    """Add size, text_crc32, shard and slot (place in its shard, without gaps) to each row; the text itself is not kept."""
    k = shards
    spark = docs.sparkSession
    ship(spark)
    order = F.col("doc_id") if order is None else order
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    kept = others(docs.columns, ("size", "text_crc32", "shard", "slot", text))
    p = free_prefix(docs.columns)
    rows = docs.select(
        *[F.col(f"`{c}`") for c in kept],
        order.alias(f"{p}order"),
        (F.octet_length(body).cast("long") + 8).alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.xxhash64(F.col(f"`{text}`").isNull(), body).alias(f"{p}key"),
    )
    rows = written(rows, "shard-rows")
    groups = rows.groupBy(f"{p}key", "size", "text_crc32").agg((F.count(F.lit(1)) * F.col("size")).alias("bytes"))
    groups = groups.select(F.col(f"{p}key").alias("_key"), F.col("size").alias("_size"), F.col("text_crc32").alias("_crc"), "bytes")
    groups = written(groups, "shard-texts")
    total = rows.count()
    parts = max(1, -(-total // groups_in_part))
    names = ("_key", "_size", "_crc")
    alone = _alone(groups.orderBy(F.desc("bytes"), *names).limit(k).collect(), groups.agg(F.sum("bytes")).first()[0] or 0, k)
    own = spark.createDataFrame([(*[g[c] for c in names], k - 1 - n) for n, g in enumerate(alone)], "_key long, _size long, _crc long, shard int")
    if alone:
        k -= len(alone)
        groups = groups.join(F.broadcast(own.drop("shard")), list(names), "left_anti")
    groups = groups.withColumn("part", F.pmod(F.xxhash64("_key", F.lit(7)), F.lit(parts)))

    def differenced(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["bytes", "_key", "_size", "_crc"], ascending=False, ignore_index=True)
        sets = [-1] * len(frame)
        for n, (_, members) in enumerate(difference([[(b, i)] for i, b in enumerate(frame["bytes"].tolist())], k)):
            for i in members:
                sets[i] = n
        return frame.assign(from_set=sets)

    dealt = written(groups.groupBy("part").applyInPandas(differenced, "_key long, _size long, _crc long, bytes long, part long, from_set long"), "shard-groups")
    sums = dealt.groupBy("part", F.col("from_set").alias("set_no")).agg(F.sum("bytes").alias("bytes"))
    shard_of = dealt.join(_rounds(sums, k, fan_in), ["part", "from_set"]).select(*names, "shard").unionAll(own).select(F.col("_key").alias(f"{p}key"), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), "shard")
    placed = rows.join(shard_of, [f"{p}key", "size", "text_crc32"])
    # Slots: places inside many small chunks of a shard first, then the chunks' starts; no task sorts a whole shard.
    chunks = max(1, -(-total // rows_in_part))
    placed = placed.withColumn(f"{p}chunk", F.pmod(F.xxhash64(f"{p}order", f"{p}key"), F.lit(chunks)))
    placed = placed.withColumn(f"{p}in_chunk", F.row_number().over(Window.partitionBy("shard", f"{p}chunk").orderBy(f"{p}order", f"{p}key")) - 1)
    counts = placed.groupBy("shard", f"{p}chunk").agg(F.count(F.lit(1)).alias(f"{p}n"))
    starts = counts.withColumn(f"{p}start", F.coalesce(F.sum(f"{p}n").over(Window.partitionBy("shard").orderBy(f"{p}chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop(f"{p}n")
    return placed.join(starts, ["shard", f"{p}chunk"]).select(*[F.col(f"`{c}`") for c in kept], "size", "text_crc32", "shard", (F.col(f"{p}start") + F.col(f"{p}in_chunk")).alias("slot"))
