"""Commits, compaction and indexes of a stored collection."""

import json
import random

import pytest

from docpipe.functions.access import to_rows
from docpipe.plans.explain import physical_plan
from docpipe.plans.pipeline import Pipeline
from docpipe.plans.steps import parse_test
from docpipe.queries import both, test as leaf, where
from docpipe.service.service import Engine
from docpipe.sources.store import CollectionStore


@pytest.fixture()
def store(spark, tmp_path):
    made = CollectionStore(spark, f"file://{tmp_path}/c", compact_after=1000)
    made.create()
    return made


def test_a_write_that_fails_leaves_nothing(store):
    store.save([{"_id": "a", "v": 1}])
    write = store.files.write

    def broken(name, value):
        if name == "pointer.json":
            raise OSError("no space left")
        write(name, value)

    store.files.write = broken
    for attempt in (lambda: store.save([{"_id": "a", "v": 2}, {"_id": "b", "v": 2}]), lambda: store.delete("a"), lambda: store.load(store.spark.createDataFrame([('{"_id": "a", "v": 3}',)], "j string"), "j")):
        with pytest.raises(OSError):
            attempt()
        assert store.find("a") == {"_id": "a", "v": 1} and store.find("b") is None and store.rows().count() == 1
    store.files.write = write
    assert store.save([{"_id": "b", "v": 4}]).inserted == ["b"]
    assert store.find("a") == {"_id": "a", "v": 1} and store.find("b") == {"_id": "b", "v": 4}
    store.compact()
    assert sorted(json.dumps(r) for r in to_rows(store.view())) == ['{"_id":"a","v":1}', '{"_id":"b","v":4}'] or {r["_id"]: r["v"] for r in to_rows(store.view())} == {"a": 1, "b": 4}


def test_replaced_files_stay_for_readers_and_then_go(store):
    store.save([{"_id": "a", "v": 1}])
    store.compact()
    reader = store.view()
    old = store.pointer["snapshot"]
    store.save([{"_id": "a", "v": 2}])
    store.compact()
    assert [r["v"] for r in to_rows(reader)] == [1] and store.files.exists(old)
    store.grace_seconds = 0
    store.save([{"_id": "a", "v": 3}])
    assert not store.files.exists(old) and store.find("a")["v"] == 3
    assert store.files.names("log") == [store.pointer["commits"][0].partition("/")[2]]


def test_commits_are_compacted_by_themselves(spark, tmp_path):
    store = CollectionStore(spark, f"file://{tmp_path}/c", compact_after=3)
    store.create()
    for i in range(4):
        store.save([{"_id": "a", "v": i}])
    assert len(store.pointer["commits"]) == 1 and store.pointer["snapshot"] and store.find("a")["v"] == 3


def test_save_table_says_what_it_did(store, spark):
    store.save([{"_id": "1", "v": 0}, {"_id": "9", "v": 0}])
    done = store.save_table(spark.range(4).selectExpr("concat('{\"_id\": \"', id, '\", \"v\": 1}') AS j"), "j")
    assert {r["_id"]: r["change"] for r in done.collect()} == {"0": "inserted", "1": "updated", "2": "inserted", "3": "inserted"}
    assert {r["_id"]: r["v"] for r in to_rows(store.view())} == {"0": 1, "1": 1, "2": 1, "3": 1, "9": 0}


def test_indexes_prune_and_never_change_results(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/data")
    engine.catalog.create_database("db")
    plain, fast = (engine.catalog.create_collection("db", n) for n in ("plain", "fast"))
    rng = random.Random(4)
    value = lambda: rng.choice([None, True, 1, 2, 2.0, 2.5, 1e20, "a", "A", "b", [1], [1.0, "a"], {"x": 1}, {"x": 1.0, "y": None}, "#time(05:06)"])
    docs = [{"_id": f"{i:04}"} | {f: value() for f in ("f", "g") if rng.random() < 0.9} for i in range(300)]
    texts = spark.createDataFrame([(json.dumps(d),) for d in docs], "j string")
    for s in (plain, fast):
        s.load(texts, "j")
    for f in ("f", "g", "g.x"):
        fast.create_index(f)
    late = [d | {"f": value()} for d in docs[:40]]
    tests = [leaf(op, "f", v) for op in ("EQUALS", "GREATER_THAN", "SMALLER_THAN_EQUALS", "NOT_EQUALS", "CONTAINS") for v in (2, 1e20, "A", True, [1], {"x": 1}, None)]
    tests += [leaf("IN", "f", [1, "a", {"x": 1}]), both("AND", leaf("EQUALS", "g.x", 1), leaf("EQUALS", "f", "a")), both("OR", leaf("EQUALS", "f", 2), leaf("EQUALS", "g", [1])), both("NOR", leaf("EQUALS", "f", 2))]

    def answer(name, steps):
        return sorted(json.dumps(r, sort_keys=True) for r in to_rows(engine.aggregate("db", name, steps)))

    for round_ in range(2):
        for t in tests[:: 1 if round_ == 0 else 5]:
            assert answer("fast", [where(t)]) == answer("plain", [where(t)]), t
        assert answer("fast", [{"type": "DISTINCT", "fieldName": "f"}]) == answer("plain", [{"type": "DISTINCT", "fieldName": "f"}])
        if round_ == 0:
            df, used = engine.compiled("db", "fast", Pipeline.parse([where(leaf("EQUALS", "f", 2))]))
            column = f"_ix_{b'f'.hex()}_number"
            assert used == ["f"] and f"EqualTo({column},2.0)" in physical_plan(df)
            assert engine.compiled("db", "fast", Pipeline.parse([where(leaf("NOT_EQUALS", "f", 2))]))[1] == []
            assert engine.compiled("db", "plain", Pipeline.parse([where(leaf("EQUALS", "f", 2))]))[1] == []
            df, used = engine.compiled("db", "fast", Pipeline.parse([{"type": "DISTINCT", "fieldName": "f"}]))
            assert used == ["f"] and "ReadSchema: struct<_ix_" in physical_plan(df)
            assert fast.scanned(parse_test(leaf("EQUALS", "f", 2))) == sum(d.get("f") == 2 and d["f"] is not True for d in docs) and fast.scanned() == 300
            for s in (plain, fast):
                s.save(late)
    assert fast.drop_index("f") and answer("fast", [where(tests[0])]) == answer("plain", [where(tests[0])])
