"""Live queries: a pipeline is run again when one of its collections changes, and its result pushed if it is another.

Each watched collection's folder of change markers, written once a change counts, is a Structured Streaming source; a
micro-batch, which may hold many changes, means one new run. The state of a listener is the hash of its last result, on the
driver. Where the order of rows doesn't matter, a fingerprint computed by the executors says first whether there is anything new
to collect.
"""

from __future__ import annotations

import hashlib
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from docpipe.functions.access import DOC, canonical_json, is_documents, to_rows
from docpipe.functions.values import canonical

Push = Callable[[dict], None]
#: Fixed value: the message of a push.
UPDATED = "Query results updated"


def result_hash(rows: list[dict], ordered: bool) -> str:
    """SHA-256 of the rows; their order counts only if the pipeline gives one."""
    texts = [canonical(r) for r in rows]
    return hashlib.sha256("\n".join(texts if ordered else sorted(texts)).encode()).hexdigest()


def fingerprint(df: DataFrame) -> tuple:
    """Of the rows whatever their order: their number, and two sums over hashes of their texts."""
    text = canonical_json(F.to_variant_object(F.col(DOC))) if is_documents(df) else F.to_json(F.struct("*"))
    of = lambda seed: F.sum(F.xxhash64(F.lit(seed), "text").cast("decimal(38,0)"))
    return tuple(df.select(text.alias("text")).agg(F.count(F.lit(1)), of(1), of(2)).first())


@dataclass
class Listener:
    listen_id: str
    run: Callable[[], DataFrame]
    ordered: bool
    push: Push
    watched: set[str]
    last: str
    owner: object = None
    streams: list[StreamingQuery] = field(default_factory=list)
    lock: threading.Lock = field(default_factory=threading.Lock)
    live: bool = True
    mark: tuple | None = None

    def check(self) -> bool:
        """Run again; push and return true if the result is another."""
        with self.lock:
            if not self.live:
                return False
            found = self.run()
            if not self.ordered:
                mark, self.mark = self.mark, fingerprint(found)
                if mark == self.mark:
                    return False
            rows = to_rows(found)
            now = result_hash(rows, self.ordered)
            if now == self.last:
                return False
            self.last = now
        self.push({"type": "LISTEN", "status": "OK", "message": UPDATED, "listenId": self.listen_id, "results": rows, "resultHash": now})
        return True


class Listeners:
    def __init__(self, spark: SparkSession, checkpoints: str, interval: str = "1 second"):
        self.spark, self.checkpoints, self.interval = spark, checkpoints.rstrip("/"), interval
        self.all: dict[str, Listener] = {}

    def add(self, run: Callable[[], DataFrame], paths: list[str], ordered: bool, push: Push, owner: object = None) -> tuple[Listener, list[dict]]:
        """``paths``: folders of the watched collections. Returns the listener and its first result."""
        rows = to_rows(run())
        listener = Listener(str(uuid.uuid4()), run, ordered, push, set(paths), result_hash(rows, ordered), owner)
        for n, path in enumerate(sorted(listener.watched)):
            changes = self.spark.readStream.schema("seq long").option("ignoreMissingFiles", "true").json(f"{path}/changes")

            def each(batch: DataFrame, _: int, listener: Listener = listener) -> None:
                if not batch.isEmpty():
                    listener.check()

            writer = changes.writeStream.foreachBatch(each).option("checkpointLocation", f"{self.checkpoints}/{listener.listen_id}/{n}")
            listener.streams.append(writer.trigger(processingTime=self.interval).start())
        self.all[listener.listen_id] = listener
        return listener, rows

    def stop(self, listen_id: str) -> bool:
        listener = self.all.pop(listen_id, None)
        if listener is None:
            return False
        listener.live = False
        for s in listener.streams:
            s.stop()
        return True

    def stop_where(self, test: Callable[[Listener], bool]) -> None:
        for i in [i for i, x in self.all.items() if test(x)]:
            self.stop(i)

    def settle(self) -> None:
        """Wait until all changes so far have been seen."""
        for x in list(self.all.values()):
            for s in x.streams:
                s.processAllAvailable()
