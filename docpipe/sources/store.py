"""Collections on storage as commits of changes and compacted snapshots.

A collection's folder holds commit folders below ``log`` (_id, _seq, _deleted, doc as VARIANT), snapshot folders, and
``pointer.json``, which names the current snapshot, the commits after it, and the indexed fields. Only what the pointer names
counts: a write that fails before the pointer is replaced leaves a folder that nobody reads, and its sequence numbers are free
again. After the pointer a marker in ``changes`` wakes live queries. A view is the snapshot and the commits, latest change first.

Compaction runs by itself once ``compact_after`` commits have gathered. It writes a new snapshot with three typed columns for
each indexed field (its number, its text in lower case and its canonical JSON), ordered by them, so that filters on the fields
skip files and row groups. What it replaces is deleted by a later write, when ``grace_seconds`` have passed, so that running
readers end well. One writer at a time for each collection.
"""

from __future__ import annotations

import json
import logging
import re
import threading
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from docpipe.functions.access import DOC, DocumentAccess, canonical_literal, documents, parsed
from docpipe.functions.values import kind_of
from docpipe.operators.predicates import Conjunction, FieldTest, Test
from docpipe.sources.changelog import latest
from docpipe.sources.files import Files

ID = re.compile(r"[a-zA-Z0-9_-]{1,64}")
LOG = T.StructType([T.StructField("_id", T.StringType()), T.StructField("_seq", T.LongType()), T.StructField("_deleted", T.BooleanType()), T.StructField("doc", T.VariantType())])
_LOCKS: dict[str, threading.RLock] = {}
_COLUMNS = ("_id", "_seq", "_deleted", "doc")
_MARKERS = 64  # of changes that stay for live queries
_log = logging.getLogger(__name__)


class EntryTooLarge(ValueError):
    pass


class DuplicateIds(ValueError):
    pass


@dataclass
class Saved:
    inserted: list[str] = field(default_factory=list)
    updated: list[str] = field(default_factory=list)


def index_columns(names: Iterable[str]) -> dict[str, tuple[str, str, str]]:
    """For each indexed field the snapshot's columns with its number, its text in lower case and its canonical JSON."""
    return {f: tuple(f"_ix_{f.encode().hex()}_{kind}" for kind in ("number", "text", "json")) for f in names}


def needed(test: Test, indexed: dict[str, tuple[str, str, str]]) -> tuple[Column | None, set[str]]:
    """A condition on index columns that every document which passes ``test`` meets, and the fields it uses; None if there is none."""
    if isinstance(test, Conjunction):
        found = [needed(t, indexed) for t in test.operands]
        parts = [c for c, _ in found if c is not None]
        used = {f for c, fs in found if c is not None for f in fs}
        if test.operator == "AND" and parts:
            return reduce(lambda a, b: a & b, parts), used
        if test.operator == "OR" and len(parts) == len(found):
            return reduce(lambda a, b: a | b, parts), used
        return None, set()
    if not isinstance(test, FieldTest) or test.field not in indexed:
        return None, set()
    number, text, whole = map(F.col, indexed[test.field])
    kind, op, value = kind_of(test.value), test.operator, test.value
    out = None
    if kind == "number":
        ways = {"EQUALS": number == value, "GREATER_THAN": number > value, "GREATER_THAN_EQUALS": number >= value, "SMALLER_THAN": number < value, "SMALLER_THAN_EQUALS": number <= value}
        out = ways.get(op)
    elif kind == "string" and op == "EQUALS":
        out = text == F.lower(F.lit(value))
    elif kind in ("array", "object", "boolean") and op == "EQUALS":
        out = whole == canonical_literal(value)
    elif kind == "array" and op == "IN":
        out = whole.isin(*[canonical_literal(v) for v in value if v is not None]) if any(v is not None for v in value) else F.lit(False)
    return out, {test.field} if out is not None else set()


class CollectionStore:
    def __init__(self, spark: SparkSession, path: str, max_entry_size: int = 1 << 20, compact_after: int = 64, grace_seconds: float = 900.0):
        self.spark, self.path, self.max_entry_size = spark, path.rstrip("/"), max_entry_size
        self.compact_after, self.grace_seconds = compact_after, grace_seconds
        self.files = Files(spark, path)
        self.lock = _LOCKS.setdefault(self.path, threading.RLock())

    def create(self) -> None:
        self.files.make("changes")
        if not self.files.exists("pointer.json"):
            self.files.write("pointer.json", {"snapshot": None, "commits": [], "seq": 0, "indexes": [], "ordered": [], "old": []})

    def drop(self) -> None:
        self.files.remove("")

    @property
    def pointer(self) -> dict:
        return self.files.read("pointer.json")

    # Reading

    def _commits(self, at: dict) -> DataFrame | None:
        return self.spark.read.schema(LOG).parquet(*[f"{self.path}/{c}" for c in at["commits"]]) if at["commits"] else None

    def _snapshot(self, at: dict) -> DataFrame | None:
        if not at["snapshot"]:
            return None
        more = [T.StructField(c, T.DoubleType() if c.endswith("_number") else T.StringType()) for cs in index_columns(at["ordered"]).values() for c in cs]
        return self.spark.read.schema(T.StructType([*LOG.fields, *more])).parquet(f"{self.path}/{at['snapshot']}")

    def _current(self, at: dict, only: Column | None = None, ids: DataFrame | Column | None = None) -> DataFrame:
        """(_id, _seq, _deleted, doc) of the current documents. ``only``: a condition on the snapshot's index columns; documents
        that don't meet it may be left out. ``ids`` restricts the ids, by a condition or by a table of them."""
        snapshot, new = self._snapshot(at), self._commits(at)
        if snapshot is not None:
            snapshot = (snapshot if only is None else snapshot.where(only)).select(*_COLUMNS)

        def those(df: DataFrame) -> DataFrame:
            return df if ids is None else df.where(ids) if isinstance(ids, Column) else df.join(ids, "_id", "left_semi")

        if snapshot is None and new is None:
            return self.spark.createDataFrame([], LOG)
        if new is None:
            return those(snapshot)  # one row for each id already
        if snapshot is None:
            return latest(those(new), "_id", "_seq", F.col("_deleted"))
        return latest(those(snapshot).unionByName(those(new)), "_id", "_seq", F.col("_deleted"))

    def rows(self) -> DataFrame:
        """(_id, doc) of the current documents."""
        return self._current(self.pointer).select("_id", "doc")

    def view(self, test: Test | None = None) -> DataFrame:
        """The current documents as a collection for pipelines; with ``test`` those that don't pass it may be left out."""
        return self.indexed_view(test)[0]

    def indexed_view(self, test: Test | None = None) -> tuple[DataFrame, list[str]]:
        """:meth:`view`, and the indexed fields whose columns are read instead of the documents that can't pass ``test``."""
        at = self.pointer
        only, used = needed(test, index_columns(at["ordered"])) if test is not None and at["snapshot"] else (None, set())
        return self._current(at, only).select(F.variant_get("doc", "$", "map<string,variant>").alias(DOC)), sorted(used)

    def scanned(self, test: Test | None = None) -> int:
        """How many stored changes a view with ``test`` reads; of the snapshot only footers and index columns are read for this."""
        at = self.pointer
        only = needed(test, index_columns(at["ordered"]))[0] if test is not None else None
        snapshot, new = self._snapshot(at), self._commits(at)
        parts = [snapshot if snapshot is None or only is None else snapshot.where(only), new]
        return sum(x.count() for x in parts if x is not None)

    def distinct_values(self, name: str) -> DataFrame | None:
        """(json) the canonical texts of a field's values from the index alone, if all documents are in the snapshot; None if not."""
        at = self.pointer
        if name not in at["ordered"] or at["commits"] or not at["snapshot"]:
            return None
        column = F.col(index_columns([name])[name][2])
        return self._snapshot(at).where(column.isNotNull()).select(column.alias("json")).distinct()

    def find(self, _id: str) -> dict | None:
        """One document; the filter on the id reaches the files."""
        found = self._current(self.pointer, ids=F.col("_id") == _id).select(F.to_json("doc")).collect()
        return json.loads(found[0][0]) if found else None

    # Writing

    def _commit(self, at: dict, rows: DataFrame, count: int) -> None:
        """Write ``rows`` (as LOG), then name them in the pointer: all of them count, or none."""
        name = f"log/{at['seq'] + 1:020d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        now = at | {"commits": [*at["commits"], name], "seq": at["seq"] + count}
        self.files.write("pointer.json", now)
        self._changed(now["seq"])
        self._sweep()
        if len(now["commits"]) >= self.compact_after:
            self.compact()

    def _changed(self, seq: int) -> None:
        self.files.write(f"changes/{seq:020d}-{uuid.uuid4().hex}.json", {"seq": seq})

    def _append(self, rows: list[tuple[str, bool, str | None]]) -> None:
        at = self.pointer
        frame = self.spark.createDataFrame([(i, at["seq"] + n, d, x) for n, (i, d, x) in enumerate(rows, 1)], "_id string, _seq long, _deleted boolean, text string")
        self._commit(at, frame.select("_id", "_seq", "_deleted", F.parse_json("text").alias("doc")).coalesce(1), len(rows))

    def save(self, objects: list[dict]) -> Saved:
        """Insert or replace, all or none. Ids are given where they are missing."""
        prepared = [{"_id": str(uuid.uuid4())} | x if not x.get("_id") else x for x in objects]
        ids = [x["_id"] for x in prepared]
        if len(set(ids)) < len(ids):
            raise DuplicateIds(next(i for i in ids if ids.count(i) > 1))
        texts = [json.dumps(x, ensure_ascii=False) for x in prepared]
        for i, t in zip(ids, texts, strict=True):
            if len(t.encode()) > self.max_entry_size:
                raise EntryTooLarge(i)
        with self.lock:
            asked = self.spark.createDataFrame([(i,) for i in ids], "_id string")
            have = {r[0] for r in self._current(self.pointer, ids=asked).select("_id").collect()}
            self._append([(i, False, t) for i, t in zip(ids, texts, strict=True)])
        return Saved([i for i in ids if i not in have], [i for i in ids if i in have])

    def save_table(self, df: DataFrame, json_column: str) -> DataFrame:
        """Insert or replace documents from JSON texts in one distributed commit; returns (_id, change), change being inserted or
        updated. Malformed texts are left out with a warning, ids given where they are missing, and of several texts with one id
        the one whose text sorts last counts."""
        with self.lock:
            at = self.pointer
            name = f"log/{at['seq'] + 1:020d}-{uuid.uuid4().hex}"
            self._prepared(df, json_column, at["seq"] + 1).write.parquet(f"{self.path}/{name}")
            before = self._current(at).select("_id")
            given = self.spark.read.schema(LOG).parquet(f"{self.path}/{name}").select("_id")
            done = given.join(before.withColumn("change", F.lit("updated")), "_id", "left").select("_id", F.coalesce("change", F.lit("inserted")).alias("change"))
            self.files.write("pointer.json", at | {"commits": [*at["commits"], name], "seq": at["seq"] + 1})
            self._changed(at["seq"] + 1)
        return done

    def load(self, df: DataFrame, json_column: str) -> None:
        """:meth:`save_table` without its result."""
        with self.lock:
            at = self.pointer
            self._commit(at, self._prepared(df, json_column, at["seq"] + 1), 1)

    def _prepared(self, df: DataFrame, json_column: str, seq: int) -> DataFrame:
        bad = df.where(parsed(df, json_column).isNull()).count()
        if bad:
            _log.warning("%s: %d malformed texts are left out", self.path, bad)
        docs = documents(df, json_column)
        own = F.try_variant_get(F.try_element_at(F.col(DOC), F.lit("_id")), "$", "string")
        named = docs.withColumn("_id", F.coalesce(own, F.expr("uuid()")))
        whole = F.map_concat(F.map_filter(F.col(DOC), lambda k, _: k != "_id"), F.create_map(F.lit("_id"), F.col("_id").cast("variant")))
        rows = named.select("_id", F.to_json(F.to_variant_object(whole)).alias("text")).groupBy("_id").agg(F.max("text").alias("text"))
        return rows.select("_id", F.lit(seq).cast("long").alias("_seq"), F.lit(False).alias("_deleted"), F.parse_json("text").alias("doc"))

    def delete(self, _id: str) -> bool:
        with self.lock:
            if self.find(_id) is None:
                return False
            self._append([(_id, True, None)])
        return True

    # Upkeep

    def compact(self) -> None:
        """Write the current documents as a new snapshot with the columns of all indexes, and let go of the commits in it."""
        with self.lock:
            at = self.pointer
            name = f"snapshot-{uuid.uuid4().hex}"
            rows = self._current(at).withColumn(DOC + "_map", F.variant_get("doc", "$", "map<string,variant>"))
            columns = index_columns(at["indexes"])
            for f, (number, text, whole) in columns.items():
                fields = _OfMap(DOC + "_map")
                rows = rows.withColumn(number, fields.number(f)).withColumn(text, F.lower(fields.text(f))).withColumn(whole, fields.canonical(f))
            keys = [F.col(c) for cs in columns.values() for c in cs] or [F.col("_id")]
            rows = rows.drop(DOC + "_map").repartitionByRange(*keys).sortWithinPartitions(*keys)
            rows.write.option("parquet.bloom.filter.enabled#_id", "true").option("parquet.block.size", 16 << 20).parquet(f"{self.path}/{name}")
            old = [*at["old"], *[{"name": x, "at": time.time()} for x in [*at["commits"], at["snapshot"]] if x]]
            self.files.write("pointer.json", at | {"snapshot": name, "commits": [], "ordered": list(at["indexes"]), "old": old})
            self._sweep()
            for x in self.files.names("changes")[:-_MARKERS]:
                self.files.remove(f"changes/{x}")

    def _sweep(self) -> None:
        """Delete what was replaced long enough ago."""
        at, now = self.pointer, time.time()
        gone = [x for x in at["old"] if now - x["at"] >= self.grace_seconds]
        if gone:
            self.files.write("pointer.json", at | {"old": [x for x in at["old"] if x not in gone]})
            for x in gone:
                self.files.remove(x["name"])

    @property
    def indexes(self) -> list[str]:
        return list(self.pointer["indexes"])

    def create_index(self, name: str) -> None:
        """Indexes order the files of snapshots and add columns to them; they never change results."""
        with self.lock:
            at = self.pointer
            self.files.write("pointer.json", at | {"indexes": sorted({*at["indexes"], name})})
            self.compact()

    def drop_index(self, name: str) -> bool:
        with self.lock:
            at = self.pointer
            if name not in at["indexes"]:
                return False
            left = lambda names: [x for x in names if x != name]
            self.files.write("pointer.json", at | {"indexes": left(at["indexes"]), "ordered": left(at["ordered"])})
        return True

    def stats(self) -> dict:
        at = self.pointer
        held = [*at["commits"], *([at["snapshot"]] if at["snapshot"] else [])]
        files = [n for d in held for n in self.files.names(d) if n.endswith(".parquet")]
        return {"indexCount": len(at["indexes"]), "indexes": at["indexes"], "pageCount": len(files), "entryCount": self.rows().count(), "sizeBytes": sum(map(self.files.size, held))}


class _OfMap(DocumentAccess):
    """Fields of a map column of any name."""

    def __init__(self, name: str):
        self.name = name

    def _doc(self) -> Column:
        return F.col(self.name)
