"""Steps on documents and on typed rows, against a row-wise version."""

import json
import random

import pytest
from pyspark.sql import functions as F

from docpipe.functions.access import DocumentAccess, documents, to_rows
from docpipe.functions.values import canonical, kind_of
from docpipe.operators.predicates import CONJUNCTIONS, FIELD_OPERATORS, predicate
from docpipe.plans.explain import suggestions
from docpipe.plans.pipeline import Pipeline
from docpipe.plans.steps import InvalidStep, parse_steps, parse_test
from docpipe.queries import add_field, both, mapped, test as leaf, where

BOATS = [{"_id": f"boat-{i}", "crew": i % 4 + 1, "length": 6 + i * 0.75, "sail": i % 3 > 0, "port": ("Kiel", "Oslo", "Riga")[i % 3], "flags": [["p", "q"], ["q"], ["r", "p"], []][i % 4], "hull": {"beam": i % 3}} for i in range(9)]
TYPED = "_id string, crew int, length double, sail boolean, port string, flags array<string>, hull struct<beam:int>"


def as_documents(spark, rows):
    return documents(spark.createDataFrame([(json.dumps(r),) for r in rows], "json string").coalesce(1), "json")


@pytest.fixture(scope="module")
def boats(spark):
    return as_documents(spark, BOATS).cache()


@pytest.fixture(scope="module")
def typed(spark):
    return spark.createDataFrame([(*[r[c] for c in ("_id", "crew", "length", "sail", "port", "flags")], (r["hull"]["beam"],)) for r in BOATS], TYPED).cache()


def run(df, *steps, lookup=None):
    return to_rows(Pipeline.parse(list(steps)).apply(df, lookup))


def ids(df, t):
    return sorted(r["_id"] for r in run(df, where(t)))


def at(doc, path):
    """(whether the field is there, its value)."""
    for part in path.split("."):
        if not isinstance(doc, dict) or part not in doc:
            return False, None
        doc = doc[part]
    return True, doc


def plain_test(t, d):
    """The row-wise version."""
    if "conjunctionType" in t:
        n = sum(plain_test(x, d) for x in t["operators"])
        return {"AND": n == len(t["operators"]), "OR": n > 0, "XOR": n == 1, "NOR": n == 0, "NAND": n < len(t["operators"])}[t["conjunctionType"]]
    op, value = t["fieldOperatorType"], t["value"]
    there, v = at(d, t["field"])
    if not there:
        return False
    k = kind_of(value)
    if k == "null":
        return v is None
    same = canonical(v) == canonical(value)
    if op == "CONTAINS":
        return k not in ("array", "object") and (isinstance(v, list) and canonical(value) in map(canonical, v) or k == "string" and kind_of(v) == "string" and value in v)
    if op in ("IN", "NOT_IN"):
        return k == "array" and v is not None and (canonical(v) in map(canonical, value)) == (op == "IN")
    if kind_of(v) != k:
        return False
    if k == "string":
        same = v.lower() == value.lower()
    if op in ("EQUALS", "NOT_EQUALS"):
        return same == (op == "EQUALS")
    return k == "number" and {"GREATER_THAN": v > value, "GREATER_THAN_EQUALS": v >= value, "SMALLER_THAN": v < value, "SMALLER_THAN_EQUALS": v <= value}[op]


def test_filters_on_both_forms(boats, typed):
    some = {"crew": [2, 4, 2.0, "2"], "length": [7.5, 9], "sail": [True], "port": ["OSLO", "Riga", "i"], "flags": ["p", ["r", "p"], []], "hull": [{"beam": 1}, {"beam": 2.0}], "hull.beam": [0, 1], "absent": [1]}
    tests = [leaf(op, f, v) for f, vs in some.items() for v in vs for op in FIELD_OPERATORS if op not in ("IN", "NOT_IN")]
    tests += [leaf(op, f, vs) for f, vs in some.items() for op in ("IN", "NOT_IN")]
    tests += [both(c, leaf("SMALLER_THAN", "crew", 3), leaf("EQUALS", "port", "kiel"), *extra) for c in CONJUNCTIONS for extra in ([], [leaf("EQUALS", "absent", 1)])]
    want = {json.dumps(t): sorted(r["_id"] for r in BOATS if plain_test(t, r)) for t in tests}
    assert len({tuple(x) for x in want.values()}) > 20
    from docpipe.functions.access import TypedAccess

    def found(df, fields, own):
        rows = df.select(own.alias("id"), *[predicate(parse_test(t), fields).alias(f"t{i}") for i, t in enumerate(tests)]).collect()
        return {json.dumps(t): sorted(r["id"] for r in rows if r[f"t{i}"]) for i, t in enumerate(tests)}

    assert found(boats, DocumentAccess(), F.try_variant_get(F.try_element_at("doc", F.lit("_id")), "$", "string")) == want
    assert found(typed, TypedAccess(typed), F.col("_id")) == want


def test_explicit_nulls(spark):
    rows = [{"_id": "1", "x": None}, {"_id": "2"}, {"_id": "3", "x": 0}]
    assert ids(as_documents(spark, rows), leaf("EQUALS", "x", None)) == ["1"]
    assert ids(spark.createDataFrame([("1", None), ("3", 0)], "_id string, x int"), leaf("EQUALS", "x", None)) == ["1"]


def test_steps(boats):
    by_port = {r["port"]: sorted(x["_id"] for x in r["group"]) for r in run(boats, {"type": "GROUP_BY", "fieldName": "port"})}
    assert by_port == {p: sorted(r["_id"] for r in BOATS if r["port"] == p) for p in ("Kiel", "Oslo", "Riga")}
    whole = next(r for r in run(boats, {"type": "GROUP_BY", "fieldName": "_id"}) if r["_id"] == "boat-4")
    assert whole["group"] == [BOATS[4]]
    assert run(boats, {"type": "COUNT"}) == [{"count": len(BOATS)}]
    assert sorted(r["length"] for r in run(boats, {"type": "DISTINCT", "fieldName": "length"})) == sorted({r["length"] for r in BOATS})
    left = {canonical({"port": r["port"], "sail": r["sail"]}) for r in BOATS}
    drop = mapped(*[add_field(f, None) for f in ("crew", "length", "flags", "hull")])
    assert sorted(canonical(r) for r in run(boats, drop, {"type": "DISTINCT"})) == sorted(left)
    for up in (True, False):
        order = sorted(BOATS, key=lambda r: (r["crew"] if up else -r["crew"], r["_id"]))
        sort = {"type": "SORT", "fieldName": "crew", "ascending": up}
        assert [r["_id"] for r in run(boats, sort)] == [r["_id"] for r in order]
        assert [r["_id"] for r in run(boats, sort, {"type": "SKIP", "skip": 2}, {"type": "LIMIT", "limit": 3})] == [r["_id"] for r in order[2:5]]
        assert [r["_id"] for r in run(boats, where(leaf("EQUALS", "sail", False)), sort, {"type": "LIMIT", "limit": 1})] == [r["_id"] for r in order if not r["sail"]][:1]


def test_lookup(spark):
    trips = [{"_id": f"t{i}", "by": k} for i, k in enumerate(["boat-1", "boat-1", "boat-3", None, 5, "5", 5.0])] + [{"_id": "t9"}]
    asked = [{"_id": "q1", "who": "boat-1"}, {"_id": "q2", "who": "boat-8"}, {"_id": "q3", "who": None}, {"_id": "q4"}, {"_id": "q5", "who": 5}, {"_id": "q6", "who": "5"}]
    other = as_documents(spark, trips)
    join = {"type": "JOIN", "joinCollection": "trips", "localField": "who", "remoteField": "by", "asField": "trips"}

    def want(q):
        if "who" not in q:
            return "none"
        return sorted(t["_id"] for t in trips if "by" in t and canonical(t["by"]) == canonical(q["who"])) or None

    got = {r["_id"]: "none" if "trips" not in r else r["trips"] and sorted(t["_id"] for t in r["trips"]) for r in run(as_documents(spark, asked), join, lookup=lambda _: other)}
    assert got == {q["_id"]: want(q) for q in asked}
    sizes = {r["_id"]: r.get("n") for r in run(as_documents(spark, asked), join, mapped(add_field("n", {"type": "SIZE", "operand": "trips"}), add_field("trips", None)), lookup=lambda _: other)}
    assert sizes == {q["_id"]: len(w) if isinstance(w := want(q), list) else None for q in asked}


def test_lookup_of_unlike_types_and_taken_names(spark):
    left = spark.createDataFrame([("x", 1), ("7", 2)], "__key string, __rows int")
    right = spark.createDataFrame([(7, "a"), (8, "b")], "__local int, name string")
    join = {"type": "JOIN", "joinCollection": "right", "localField": "__key", "remoteField": "__local", "asField": "found"}
    assert run(left, join, lookup=lambda _: right) == [{"__key": "x", "__rows": 1, "found": None}, {"__key": "7", "__rows": 2, "found": None}]
    join["localField"] = "__rows"
    assert all(r["found"] is None for r in run(left, join, lookup=lambda _: right))
    longs = right.select(F.col("__local").cast("long") - 6, "name").toDF("__local", "name")
    assert {r["__rows"]: r["found"][0]["name"] for r in run(left, join, lookup=lambda _: longs)} == {1: "a", 2: "b"}


def test_values_are_equal_by_number_and_strings_stay(spark):
    texts = ['"x:1.0,y"', '"x:1,y"', '"z"', "1", "1.0", "1e0", "0.1", "1.0e-1", "0.10", "1e20", "100000000000000000000", "1e-7", "0.0000001", '{"k": 1e20}', '{"k": 100000000000000000000.0}', '{"k": "1.0"}', "[1.50, -0.0]", "[1.5, 0]", "123456789012345678", "123456789012345677"]
    df = documents(spark.createDataFrame([(f'{{"_id": "{i:02}", "v": {t}}}',) for i, t in enumerate(texts)], "json string").coalesce(1), "json")
    want = [["00"], ["01"], ["02"], ["03", "04", "05"], ["06", "07", "08"], ["09", "10"], ["11", "12"], ["13", "14"], ["15"], ["16", "17"], ["18"], ["19"]]
    got = sorted(sorted(x["_id"] for x in r["group"]) for r in run(df, {"type": "GROUP_BY", "fieldName": "v"}))
    assert got == want
    assert len(run(df, {"type": "DISTINCT", "fieldName": "v"})) == len(want)
    assert ids(df, leaf("IN", "v", ["x:1.0,y"])) == ["00"]
    assert ids(df, leaf("IN", "v", [1e20, 0.1])) == ["06", "07", "08", "09", "10"]
    assert ids(df, leaf("EQUALS", "v", {"k": 1e20})) == ["13", "14"]
    assert ids(df, leaf("EQUALS", "v", [1.5, 0])) == ["16", "17"]
    assert ids(df, leaf("EQUALS", "v", 1e-7)) == ["11", "12"]


def test_last_of_equal_keys_counts(spark):
    df = documents(spark.createDataFrame([('{"_id": "a", "x": 1, "x": {"y": 2, "y": 3}}',), ("{",), ("[1]",), ("  \n{}",)], "json string"), "json")
    assert sorted(run(df), key=len) == [{}, {"_id": "a", "x": {"y": 3}}]


def test_kinds_sort_apart_and_custom_types_compare(spark):
    values = ["pier", False, True, None, 7, 2.5, {"b": [1]}, [3], "#datetime(2031-03-04T05:06:07)", "#time(05:06:07)", 7.0]
    df = as_documents(spark, [{"_id": f"{i:02}", "v": v} for i, v in enumerate(values)])
    rank = {"array": 0, "object": 0, "boolean": 1, "number": 2, "string": 3, "custom": 4, "null": 5}
    inner = lambda v: v[v.index("(") + 1 : -1]
    key = lambda i: (rank[kind_of(values[i])], {"boolean": lambda v: (not v,), "number": lambda v: (v,), "string": lambda v: (v,), "custom": lambda v: (inner(v),)}.get(kind_of(values[i]), lambda v: ())(values[i]), i)
    assert [r["_id"] for r in run(df, {"type": "SORT", "fieldName": "v", "ascending": True})] == [f"{i:02}" for i in sorted(range(len(values)), key=key)]
    assert ids(df, leaf("SMALLER_THAN", "v", "#datetime(2031-03-04T05:06:08)")) == ["08"]
    assert ids(df, leaf("GREATER_THAN_EQUALS", "v", "#time(05:06)")) == ["09"]
    assert ids(df, leaf("EQUALS", "v", "#time(05:06:07.000)")) == ["09"]
    sizes = {canonical(g["v"]): g["n"] for g in run(df, {"type": "GROUP_BY", "fieldName": "v"}, mapped(add_field("n", {"type": "SIZE", "operand": "group"}), add_field("group", None)))}
    assert len(sizes) == 10 and sizes["7"] == 2


def one(spark, doc, operator):
    return run(as_documents(spark, [{"_id": "x"} | doc]), mapped(add_field("out", operator)))[0]["out"]


def test_scalars(spark):
    d = {"p": 6, "q": 4, "z": 0, "neg": -9, "s": "Mast", "no": None, "list": [1, 2, 3], "num": " 2.5 ", "yes": "TRUE", "when": "2031-03-04T05:06:07", "at": "05:06"}
    fold = lambda f, *x: {"type": f, "operands": list(x)}
    cast = lambda f, to, **more: {"type": "CAST", "fieldName": f, "toType": to} | more
    custom = lambda f, name: cast(f, "JSON_CUSTOM", customTypeName=name)
    cases = [
        (fold("SUM", "p", "q", 5, "missing"), 15), (fold("SUBS", "p", "q", 1), 1), (fold("SUBS", "p", 6, "q", 1), 3), (fold("MULTIPLY", "p", "q"), 24), (fold("MULTIPLY", 3, "q"), 4),
        (fold("DIVIDE", "p", "q"), 1.5), (fold("POW", "q", 3), 64), (fold("ROOT", "q", 2), 2), (fold("AVG", "p", "q", "no"), 5), (fold("MAX", "p", "neg"), 6), (fold("MIN", "p", "neg"), -9),
        ({"type": "ABS", "operand": "neg"}, 9), ({"type": "ABS", "operand": "s"}, None), ({"type": "SIZE", "operand": "list"}, 3), ({"type": "SIZE", "operand": "s"}, 4),
        (cast("num", "NUMBER"), 2.5), (cast("s", "NUMBER"), None), (cast("p", "STRING"), "6"), (cast("yes", "BOOLEAN"), True), (cast("z", "BOOLEAN"), False),
        (custom("when", "datetime"), "#datetime(2031-03-04T05:06:07)"), (custom("at", "time"), "#time(05:06)"), (custom("s", "time"), None), (custom("when", "time"), None),
        (fold("CONCAT", "s", "--", 8, "p", True, "missing"), "Mast-86truenull"),
    ]
    got = run(as_documents(spark, [{"_id": "x"} | d]), mapped(*[add_field(f"out{i}", op) for i, (op, _) in enumerate(cases)]))[0]
    assert {i: got[f"out{i}"] for i in range(len(cases))} == {i: w for i, (_, w) in enumerate(cases)}


def test_random_predicates_on_random_documents(spark):
    rng = random.Random(1)
    value = lambda: rng.choice([None, True, False, 0, 1, 2, 2.5, "a", "A", "ab", [1], [1, "a"], [], {"x": 1}, {"x": 1, "y": None}])
    docs = [{"_id": f"{i:03}"} | {f: value() for f in "abc" if rng.random() < 0.8} for i in range(120)]
    df = as_documents(spark, docs).cache()

    def made(depth):
        if depth and rng.random() < 0.6:
            return both(rng.choice(CONJUNCTIONS), *[made(depth - 1) for _ in range(rng.randint(1, 3))])
        op = rng.choice(FIELD_OPERATORS)
        return leaf(op, rng.choice("abc"), [value() for _ in range(3)] if op in ("IN", "NOT_IN") and rng.random() < 0.8 else value())

    tests = [made(2) for _ in range(60)]
    got = df.select(F.try_variant_get(F.try_element_at("doc", F.lit("_id")), "$", "string").alias("id"), *[predicate(parse_test(t), DocumentAccess()).alias(f"t{i}") for i, t in enumerate(tests)]).collect()
    by_id = {r["id"]: r for r in got}
    for i, t in enumerate(tests):
        for d in docs:
            assert by_id[d["_id"]][f"t{i}"] is plain_test(t, d), (t, d)


def test_validation_and_advice():
    for steps, message in (
        ([{"type": "LIMIT", "limit": 0}], "LIMIT step requires"),
        ([{"type": "SKIP", "skip": -1}], "SKIP step requires"),
        ([{"type": "COUNT"}, {"type": "LIMIT", "limit": 1}], "COUNT must be the last"),
        ([{"type": "FILTER"}], "FILTER step requires"),
        ([{"type": "SORT", "fieldName": "crew"}], "SORT step requires"),
        ([mapped(add_field("x", {"type": "DIVIDE", "operands": [1]}))], "DIVIDE operator requires"),
    ):
        with pytest.raises(InvalidStep, match=message):
            parse_steps(steps)
    steps = parse_steps([{"type": "SORT", "fieldName": "crew", "ascending": True}, where(leaf("EQUALS", "port", "x"))])
    first, second = suggestions(steps, False)
    assert "crew, port" in first and "'port' at step 2" in second
    assert suggestions(steps[:1], True) == []


def test_counts_replace_nested_rows(typed):
    steps = [{"type": "GROUP_BY", "fieldName": "crew"}, mapped(add_field("n", {"type": "SIZE", "operand": "group"}), add_field("group", None))]
    df = Pipeline.parse(steps).apply(typed)
    assert "collect_list" not in df._jdf.queryExecution().toString()
    assert sorted(map(tuple, df.collect())) == sorted({(r["crew"], sum(x["crew"] == r["crew"] for x in BOATS)) for r in BOATS})
