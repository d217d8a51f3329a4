"""Requests end to end: users, databases, documents, queries and live queries."""

import time

import pytest

from docpipe.queries import test as leaf, where
from docpipe.service.service import Engine


@pytest.fixture()
def engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/data", max_entry_size=2000, admin=("root", "rootpass1"), listen_interval="0 seconds")
    yield e
    e.listeners.stop_where(lambda _: True)


@pytest.fixture()
def admin(engine):
    s = engine.session()
    assert s.handle({"type": "AUTHENTICATE", "username": "root", "password": "rootpass1"})["status"] == "OK"
    assert s.handle({"type": "CREATE_DATABASE", "databaseName": "shop"})["status"] == "OK"
    return s


def ask(s, kind, **more):
    return s.handle({"type": kind, "databaseName": "shop", "collectionName": "items"} | more)


def test_documents_and_queries(admin):
    assert ask(admin, "CREATE_COLLECTION")["status"] == "OK"
    assert ask(admin, "SAVE", object={"_id": "a", "n": 1})["_id"] == "a"
    done = ask(admin, "BULK_SAVE", objects=[{"_id": "a", "n": 2}, {"_id": "b", "n": 3}, {"n": 4}])
    assert done["updated"] == ["a"] and len(done["inserted"]) == 2
    assert ask(admin, "FIND_BY_ID", _id="a")["object"] == {"_id": "a", "n": 2}
    assert ask(admin, "FIND_BY_ID", _id="zz")["errorCode"] == "404-2"
    assert ask(admin, "BULK_SAVE", objects=[{"_id": "q"}, {"_id": "q"}])["errorCode"] == "400-3"
    assert ask(admin, "SAVE", object={"x": "y" * 3000})["errorCode"] == "400-2"
    assert ask(admin, "SAVE", object={"_id": "bad id"})["errorCode"] == "400-1"
    assert ask(admin, "DELETE", _id="b")["status"] == "OK"
    assert ask(admin, "DELETE", _id="b")["errorCode"] == "404-2"
    steps = [where(leaf("GREATER_THAN", "n", 1)), {"type": "SORT", "fieldName": "n", "ascending": True}]
    before = [r["n"] for r in ask(admin, "AGGREGATE", aggregationSteps=steps)["results"]]
    assert before == [2, 4]
    assert ask(admin, "AGGREGATE", aggregationSteps=[where(leaf("EQUALS", "n", 99))])["errorCode"] == "404-3"
    assert ask(admin, "CREATE_INDEX", fieldName="n")["status"] == "OK"
    found = ask(admin, "AGGREGATE", aggregationSteps=steps, analyze=True)
    assert [r["n"] for r in found["results"]] == before and found["analyzeResult"]["indexesUsed"] == ["n"] and found["analyzeResult"]["documentsScanned"] == 2
    assert ask(admin, "SAVE", object={"_id": "c", "n": 3})["status"] == "OK"
    assert [r["n"] for r in ask(admin, "AGGREGATE", aggregationSteps=steps)["results"]] == [2, 3, 4]
    assert ask(admin, "REINDEX")["fieldNames"] == ["n"]
    assert [r["n"] for r in ask(admin, "AGGREGATE", aggregationSteps=steps)["results"]] == [2, 3, 4]
    assert ask(admin, "DROP_INDEX", fieldName="n")["status"] == "OK" and ask(admin, "DROP_INDEX", fieldName="n")["errorCode"] == "404-6"
    stats = ask(admin, "GET_DATABASE_STATS")["stats"]
    assert stats["totals"]["entryCount"] == 3 and stats["databases"][0]["collections"][0]["name"] == "items"
    assert ask(admin, "LIST_COLLECTIONS")["collections"] == ["items"]
    assert ask(admin, "DROP_COLLECTION")["status"] == "OK" and ask(admin, "LIST_COLLECTIONS")["collections"] == []
    assert ask(admin, "DROP_DATABASE")["status"] == "OK" and ask(admin, "LIST_COLLECTIONS")["errorCode"] == "404-4"


def test_users_and_permissions(engine, admin):
    assert admin.handle({"type": "CREATE_USER", "username": "bob", "password": "bobspass1", "collectionPermissions": {"shop|items": "READ"}})["status"] == "OK"
    assert admin.handle({"type": "CREATE_USER", "username": "bob", "password": "bobspass1"})["errorCode"] == "409-1"
    assert ask(admin, "SAVE", object={"_id": "a", "n": 1})["status"] == "OK"
    bob = engine.session()
    assert ask(bob, "FIND_BY_ID", _id="a")["errorCode"] == "401-1"
    assert bob.handle({"type": "LIST_DATABASES"})["databases"] == ["shop"]
    assert bob.handle({"type": "AUTHENTICATE", "username": "bob", "password": "wrong"})["errorCode"] == "401-3"
    bob.handle({"type": "AUTHENTICATE", "username": "bob", "password": "bobspass1"})
    assert ask(bob, "FIND_BY_ID", _id="a")["status"] == "OK"
    assert ask(bob, "SAVE", object={"n": 2})["errorCode"] == "403-1"
    join = {"type": "JOIN", "joinCollection": "other", "localField": "n", "remoteField": "n", "asField": "x"}
    assert ask(bob, "AGGREGATE", aggregationSteps=[join])["errorCode"] == "403-1"
    assert bob.handle({"type": "CREATE_DATABASE", "databaseName": "mine"})["errorCode"] == "403-1"
    assert bob.handle({"type": "SET_PASSWORD", "username": "bob", "currentPassword": "no", "newPassword": "newpass12"})["errorCode"] == "400-6"
    assert bob.handle({"type": "SET_PASSWORD", "username": "bob", "currentPassword": "bobspass1", "newPassword": "newpass12"})["status"] == "OK"
    changed = admin.handle({"type": "CHANGE_PERMISSIONS", "username": "bob", "globalPermissions": ["CREATE_DATABASE"], "databasePermissions": {"shop": "READ_WRITE"}})
    assert changed["status"] == "OK" and ask(bob, "SAVE", object={"n": 2})["status"] == "OK"
    assert bob.handle({"type": "CREATE_DATABASE", "databaseName": "mine"})["status"] == "OK"
    users = admin.handle({"type": "LIST_USERS", "aggregationSteps": [where(leaf("CONTAINS", "ownedDatabases", "mine"))]})["results"]
    assert [u["_id"] for u in users] == ["bob"] and "passwordHash" not in users[0]
    assert ask(admin, "SET_DATABASE_OWNERS", owners=["nobody"])["errorCode"] == "400-1"
    assert ask(admin, "SET_DATABASE_OWNERS", owners=["bob"])["status"] == "OK" and ask(bob, "DROP_DATABASE")["status"] == "OK"
    assert admin.handle({"type": "DELETE_USER", "username": "root"})["errorCode"] == "400-4"
    assert admin.handle({"type": "CHANGE_PERMISSIONS", "username": "root", "admin": False})["errorCode"] == "400-5"
    assert admin.handle({"type": "DELETE_USER", "username": "bob"})["status"] == "OK"
    assert ask(bob, "FIND_BY_ID", _id="a")["errorCode"] == "401-2"
    assert admin.handle({"type": "NO_SUCH"})["errorCode"] == "400-1"


def test_live_queries(engine, admin):
    pushed = []
    s = engine.session(pushed.append)
    s.handle({"type": "AUTHENTICATE", "username": "root", "password": "rootpass1"})
    ask(s, "SAVE", object={"_id": "a", "status": "active"})
    first = ask(s, "LISTEN", aggregationSteps=[where(leaf("EQUALS", "status", "active"))])
    assert [r["_id"] for r in first["results"]] == ["a"] and len(first["resultHash"]) == 64

    def after(kind, **more):
        n = len(pushed)
        assert ask(s, kind, **more)["status"] == "OK"
        engine.listeners.settle()
        time.sleep(0.2)
        return pushed[n:]

    assert after("SAVE", object={"_id": "b", "status": "idle"}) == []
    new = after("SAVE", object={"_id": "c", "status": "active"})
    assert len(new) == 1 and new[0]["resultHash"] != first["resultHash"] and {r["_id"] for r in new[0]["results"]} == {"a", "c"}
    assert len(after("DELETE", _id="a")) == 1
    assert s.handle({"type": "STOP_LISTEN", "listenId": first["listenId"]})["status"] == "OK"
    assert s.handle({"type": "STOP_LISTEN", "listenId": first["listenId"]})["errorCode"] == "404-7"
    assert after("SAVE", object={"_id": "d", "status": "active"}) == []
    ask(s, "LISTEN", aggregationSteps=[])
    assert s.handle({"type": "CLOSE_CONNECTION"})["status"] == "OK" and not engine.listeners.all


def test_load_and_compact(engine, admin, spark):
    store = engine.catalog.create_collection("shop", "bulk")
    store.load(spark.createDataFrame([('{"_id":"x","v":1}',), ("broken",), ('{"v":2}',), ("{}",), ('{"_id":"x","v":3}',)], "j string"), "j")
    rows = {r["_id"]: r.get("v") for r in [__import__("json").loads(t[0]) for t in store.rows().selectExpr("to_json(doc)").collect()]}
    assert rows["x"] == 3 and sorted(map(str, rows.values())) == ["2", "3", "None"]
    store.compact()
    assert store.rows().count() == 3 and store.find("x") == {"_id": "x", "v": 3}
