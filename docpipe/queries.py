"""One query for each operator of the engine over the sample tables, with SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from docpipe.functions.access import DOC, documents
from docpipe.plans.explain import suggestions
from docpipe.plans.pipeline import Pipeline
from docpipe.service.service import Engine
from docpipe.sources.changelog import latest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def add(name: str, source: str, steps: list[dict], sql: str, columns: list[str] | None = None, ties: tuple[str, ...] = ("_id",), shape: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """A pipeline over a table; ``columns`` are picked first, ``shape`` flattens nested results for comparison."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source)
        df = df.select(*columns) if columns else df
        out = Pipeline.parse(steps).apply(df, lambda n: table(spark, sf_dir, n), ties)
        return shape(out) if shape else out

    QUERIES[name], ORACLES[name] = run, sql


def test(op: str, field: str, value: object) -> dict:
    return {"fieldOperatorType": op, "field": field, "value": value}


def both(kind: str, *tests: dict) -> dict:
    return {"conjunctionType": kind, "operators": list(tests)}


def where(t: dict) -> dict:
    return {"type": "FILTER", "operator": t}


def add_field(name: str, operator: dict | None, condition: dict | None = None) -> dict:
    return {"fieldName": name} | ({"operator": operator} if operator else {}) | ({"condition": condition} if condition else {})


def mapped(*changes: dict) -> dict:
    return {"type": "MAP", "operators": list(changes)}


# Filters

add("filter_equals_string", "orders", [where(test("EQUALS", "o_orderstatus", "f"))], "SELECT * FROM orders WHERE lower(o_orderstatus) = 'f'")
for _name, _op, _sql in (
    ("equals_number", "EQUALS", "="),
    ("not_equals", "NOT_EQUALS", "<>"),
    ("gt", "GREATER_THAN", ">"),
    ("gte", "GREATER_THAN_EQUALS", ">="),
    ("lt", "SMALLER_THAN", "<"),
    ("lte", "SMALLER_THAN_EQUALS", "<="),
):
    add(f"filter_{_name}", "lineitem", [where(test(_op, "l_quantity", 25))], f"SELECT * FROM lineitem WHERE l_quantity {_sql} 25")
add("filter_string_order_is_false", "orders", [where(test("GREATER_THAN", "o_orderstatus", "A")), {"type": "COUNT"}], "SELECT CAST(0 AS BIGINT) AS count")
add("filter_type_mismatch", "orders", [where(test("NOT_EQUALS", "o_orderstatus", 5)), {"type": "COUNT"}], "SELECT CAST(0 AS BIGINT) AS count")
add("filter_datetime_gte", "orders", [where(test("GREATER_THAN_EQUALS", "o_orderdate", "#datetime(1997-01-01T00:00:00)"))], "SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00'")
add("filter_in", "customer", [where(test("IN", "c_mktsegment", ["BUILDING", "MACHINERY", "building", 7]))], "SELECT * FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'building')")
add("filter_not_in", "customer", [where(test("NOT_IN", "c_mktsegment", ["BUILDING", "MACHINERY"]))], "SELECT * FROM customer WHERE c_mktsegment IS NOT NULL AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
add("filter_in_number", "part", [where(test("IN", "p_size", [1, 5, 10.0]))], "SELECT * FROM part WHERE p_size IN (1, 5, 10)")
add("filter_contains_string", "part", [where(test("CONTAINS", "p_name", "ring"))], "SELECT * FROM part WHERE contains(p_name, 'ring')")


def _with_ids(df: DataFrame) -> DataFrame:
    return df.select("p_partkey", F.array(F.col("p_size").cast("long"), F.pmod("p_partkey", F.lit(3))).alias("ids"), F.struct(F.col("p_size").alias("size"), F.col("p_brand").alias("brand")).alias("meta"))


def add_nested(name: str, t: dict, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Pipeline.parse([where(t)]).apply(_with_ids(table(spark, sf_dir, "part"))).select("p_partkey")

    QUERIES[name], ORACLES[name] = run, f"SELECT p_partkey FROM part WHERE {sql}"


add_nested("filter_array_equals", test("EQUALS", "ids", [5, 1]), "p_size = 5 AND p_partkey % 3 = 1")
add_nested("filter_array_not_equals", test("NOT_EQUALS", "ids", [5, 1]), "NOT (p_size = 5 AND p_partkey % 3 = 1)")
add_nested("filter_contains_array", test("CONTAINS", "ids", 2), "p_size = 2 OR p_partkey % 3 = 2")
add_nested("filter_object_equals", test("EQUALS", "meta", {"brand": "Brand#1", "size": 5}), "p_size = 5 AND p_brand = 'Brand#1'")
add_nested("filter_object_in", test("IN", "meta", [{"size": 5, "brand": "Brand#1"}, {"size": 7, "brand": "Brand#2"}]), "(p_size = 5 AND p_brand = 'Brand#1') OR (p_size = 7 AND p_brand = 'Brand#2')")
add_nested("filter_nested_path", test("SMALLER_THAN", "meta.size", 4), "p_size < 4")


def _dear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_totalprice > 400000")


def filter_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    outer = table(spark, sf_dir, "customer").join(_dear(spark, sf_dir), F.col("c_custkey") == F.col("o_custkey"), "left")
    return Pipeline.parse([where(test("EQUALS", "o_orderkey", None))]).apply(outer).select("c_custkey", "c_name")


QUERIES["filter_null"] = filter_null
ORACLES["filter_null"] = "SELECT c_custkey, c_name FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey WHERE o_orderkey IS NULL"


def filter_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of day as custom values of documents."""
    texts = table(spark, sf_dir, "events").select(F.to_json(F.struct(F.col("event_id").cast("string").alias("_id"), F.concat(F.lit("#time("), F.date_format("ts", "HH:mm:ss"), F.lit(")")).alias("at"))).alias("json"))
    found = Pipeline.parse([where(both("AND", test("GREATER_THAN_EQUALS", "at", "#time(06:30)"), test("SMALLER_THAN", "at", "#time(18:00:00)")))]).apply(documents(texts, "json"))
    return found.select(_field("_id", "string"), _field("at", "string"))


QUERIES["filter_time"] = filter_time
ORACLES["filter_time"] = "SELECT CAST(event_id AS VARCHAR) AS _id, strftime(ts, '#time(%H:%M:%S)') AS at FROM events WHERE strftime(ts, '%H:%M:%S') >= '06:30:00' AND strftime(ts, '%H:%M:%S') < '18:00:00'"

# Conjunctions

_A, _B = test("GREATER_THAN", "l_quantity", 25), test("EQUALS", "l_returnflag", "n")
_SA, _SB = "coalesce(l_quantity > 25, false)", "coalesce(lower(l_returnflag) = 'n', false)"
for _kind, _sql in (("AND", f"{_SA} AND {_SB}"), ("OR", f"{_SA} OR {_SB}"), ("XOR", f"CAST({_SA} AS INT) + CAST({_SB} AS INT) = 1"), ("NOR", f"NOT ({_SA} OR {_SB})"), ("NAND", f"NOT ({_SA} AND {_SB})")):
    add(f"conj_{_kind.lower()}", "lineitem", [where(both(_kind, _A, _B))], f"SELECT * FROM lineitem WHERE {_sql}")
add(
    "conj_nested", "lineitem", [where(both("OR", both("AND", _A, _B), both("NOR", _B, test("SMALLER_THAN", "l_discount", 0.05)), test("EQUALS", "no_such_field", 1)))],
    f"SELECT * FROM lineitem WHERE ({_SA} AND {_SB}) OR NOT ({_SB} OR coalesce(l_discount < 0.05, false))",
)

# Map

_KEYS = ["l_orderkey", "l_linenumber"]
_NUMBERS = [*_KEYS, "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def add_fold(name: str, function: str, operands: list, sql: str) -> None:
    add(f"map_{name}", "lineitem", [mapped(add_field("x", {"type": function, "operands": operands}))], f"SELECT {', '.join(_NUMBERS)}, {sql} AS x FROM lineitem", _NUMBERS)


_SEED = "CASE WHEN {a} = 0 THEN {a} + {x} ELSE {f} END"
_PD = _SEED.format(a="l_extendedprice", x="l_discount", f="l_extendedprice * l_discount")
add_fold("sum", "SUM", ["l_quantity", "l_discount", 3, "no_such_field"], "l_quantity + l_discount + 3.0::DOUBLE")
add_fold("subs", "SUBS", ["l_extendedprice", "l_discount", 2], f"({_SEED.format(a='l_extendedprice', x='l_discount', f='l_extendedprice - l_discount')}) - 2.0::DOUBLE")
add_fold("multiply", "MULTIPLY", ["l_extendedprice", "l_discount", "l_tax"], _SEED.format(a=f"({_PD})", x="l_tax", f=f"({_PD}) * l_tax"))
add_fold("multiply_literal_first", "MULTIPLY", [2, "l_quantity"], "l_quantity")
add_fold("divide", "DIVIDE", ["l_extendedprice", "l_quantity"], _SEED.format(a="l_extendedprice", x="l_quantity", f="l_extendedprice / l_quantity"))
add_fold("divide_by_zero", "DIVIDE", ["l_extendedprice", 0], "CASE WHEN l_extendedprice > 0 THEN 'Infinity'::DOUBLE WHEN l_extendedprice < 0 THEN '-Infinity'::DOUBLE ELSE 'NaN'::DOUBLE END")
add_fold("pow", "POW", ["l_quantity", 2], "l_quantity * l_quantity")
add(
    "map_root", "lineitem", [mapped(add_field("square", {"type": "POW", "operands": ["l_quantity", 2]}), add_field("x", {"type": "ROOT", "operands": ["square", 2]}))],
    "SELECT l_orderkey, l_linenumber, l_quantity, l_quantity * l_quantity AS square, sqrt(l_quantity * l_quantity) AS x FROM lineitem", ["l_orderkey", "l_linenumber", "l_quantity"],
)
add_fold("avg", "AVG", ["l_quantity", "l_extendedprice", "no_such_field"], "(l_quantity + l_extendedprice) / 2")
add_fold("max", "MAX", ["l_discount", "l_tax", 0.05], "greatest(l_discount, l_tax, 0.05::DOUBLE)")
add_fold("min", "MIN", ["l_discount", "l_tax", 0.05], "least(l_discount, l_tax, 0.05::DOUBLE)")
add("map_abs", "customer", [mapped(add_field("x", {"type": "ABS", "operand": "c_acctbal"}))], "SELECT c_custkey, c_acctbal, abs(c_acctbal) AS x FROM customer", ["c_custkey", "c_acctbal"])
add("map_size_string", "documents", [mapped(add_field("x", {"type": "SIZE", "operand": "text"}), add_field("text", None))], "SELECT doc_id, CAST(length(text) AS INTEGER) AS x FROM documents", ["doc_id", "text"])
add("map_size_array", "embeddings", [mapped(add_field("x", {"type": "SIZE", "operand": "embedding"}), add_field("embedding", None))], "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS x FROM embeddings", ["vec_id", "embedding"])
add(
    "map_concat", "nation", [mapped(add_field("x", {"type": "CONCAT", "operands": ["n_name", "--", "n_nationkey", "no_such_field", 7, True, ["a", 1]]}))],
    "SELECT n_nationkey, n_name, n_name || '-' || CAST(n_nationkey AS VARCHAR) || 'null' || '7' || 'true' || 'a1' AS x FROM nation", ["n_nationkey", "n_name"],
)


def add_cast(name: str, source: str, column: str, key: str, to: dict, sql: str) -> None:
    add(f"map_cast_{name}", source, [mapped(add_field("x", {"type": "CAST", "fieldName": column} | to))], f"SELECT {key}, {column}, {sql} AS x FROM {source}", [key, column])


add(
    "map_cast_number", "part", [mapped(add_field("text", {"type": "CONCAT", "operands": ["p_size", "-.5"]}), add_field("x", {"type": "CAST", "fieldName": "text", "toType": "NUMBER"}), add_field("none", {"type": "CAST", "fieldName": "p_brand", "toType": "NUMBER"}))],
    "SELECT p_partkey, p_brand, p_size, p_size || '.5' AS text, p_size + 0.5::DOUBLE AS x, TRY_CAST(p_brand AS DOUBLE) AS none FROM part", ["p_partkey", "p_brand", "p_size"],
)
add_cast("string", "part", "p_size", "p_partkey", {"toType": "STRING"}, "CAST(p_size AS VARCHAR)")
add_cast("boolean", "part", "p_size", "p_partkey", {"toType": "BOOLEAN"}, "p_size <> 0")


def map_cast_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, "no date").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("at"))
    return Pipeline.parse([mapped(add_field("x", {"type": "CAST", "fieldName": "at", "toType": "JSON_CUSTOM", "customTypeName": "datetime"}), add_field("at", None))]).apply(texts)


QUERIES["map_cast_datetime"] = map_cast_datetime
ORACLES["map_cast_datetime"] = "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE date_trunc('second', ts) END AS x FROM events"


def map_cast_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nanoseconds of the day."""
    texts = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, "25:00").otherwise(F.date_format("ts", "HH:mm:ss")).alias("at"))
    return Pipeline.parse([mapped(add_field("x", {"type": "CAST", "fieldName": "at", "toType": "JSON_CUSTOM", "customTypeName": "time"}), add_field("at", None))]).apply(texts)


QUERIES["map_cast_time"] = map_cast_time
ORACLES["map_cast_time"] = "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN CAST(floor(epoch(ts)) % 86400 AS BIGINT) * 1000000000 END AS x FROM events"
_BIG = test("GREATER_THAN", "p_size", 25)
add(
    "map_conditional_add", "part", [mapped(add_field("p_retailprice", {"type": "SUM", "operands": ["p_retailprice", 1]}, _BIG), add_field("big", {"type": "CONCAT", "operands": ["-yes"]}, _BIG))],
    "SELECT p_partkey, p_size, CASE WHEN p_size > 25 THEN p_retailprice + 1.0::DOUBLE ELSE p_retailprice END AS p_retailprice, CASE WHEN p_size > 25 THEN 'yes' END AS big FROM part", ["p_partkey", "p_size", "p_retailprice"],
)
add("map_condition_nor_is_false", "part", [mapped(add_field("x", {"type": "SUM", "operands": [1]}, both("NOR", _BIG)))], "SELECT p_partkey, p_size, CAST(NULL AS DOUBLE) AS x FROM part", ["p_partkey", "p_size"])
add("map_remove_field", "part", [mapped(add_field("p_name", None), add_field("p_size", None, _BIG))], "SELECT p_partkey, CASE WHEN NOT p_size > 25 THEN p_size END AS p_size FROM part", ["p_partkey", "p_name", "p_size"])
add(
    "map_sequence", "part", [mapped(add_field("a", {"type": "SUM", "operands": ["p_size", 1]}), add_field("b", {"type": "MULTIPLY", "operands": ["a", 2]}), add_field("a", None))],
    "SELECT p_partkey, p_size, (p_size + 1.0::DOUBLE) * 2 AS b FROM part", ["p_partkey", "p_size"],
)

# Group, join, count, distinct

add(
    "group_by_size", "orders", [{"type": "GROUP_BY", "fieldName": "o_orderpriority"}, mapped(add_field("n", {"type": "SIZE", "operand": "group"}), add_field("group", None))],
    "SELECT o_orderpriority, CAST(count(*) AS INTEGER) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1",
)
add(
    "group_by_nested", "orders", [{"type": "GROUP_BY", "fieldName": "o_custkey"}], "SELECT o_custkey, o_orderkey, o_totalprice FROM orders", ["o_orderkey", "o_custkey", "o_totalprice"],
    shape=lambda df: df.select("o_custkey", F.explode("group").alias("g")).select("o_custkey", "g.o_orderkey", "g.o_totalprice"),
)
_LOOKUP = {"type": "JOIN", "joinCollection": "orders", "localField": "c_custkey", "remoteField": "o_custkey", "asField": "found"}
add(
    "join_lookup_size", "customer", [_LOOKUP, mapped(add_field("n", {"type": "SIZE", "operand": "found"}), add_field("found", None))],
    "SELECT c_custkey, CAST(n AS INTEGER) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey", ["c_custkey"],
)
add(
    "join_lookup_nested", "customer", [_LOOKUP], "SELECT c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN orders ON c_custkey = o_custkey", ["c_custkey"],
    shape=lambda df: df.select("c_custkey", F.explode_outer("found").alias("o")).select("c_custkey", "o.o_orderkey", "o.o_orderstatus"),
)
QUERIES["join_lookup_no_match"] = lambda spark, sf_dir: Pipeline.parse([_LOOKUP, where(test("EQUALS", "found", None)), mapped(add_field("found", None))]).apply(table(spark, sf_dir, "customer").select("c_custkey"), lambda _: _dear(spark, sf_dir))
ORACLES["join_lookup_no_match"] = "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)"
add(
    "join_lookup_unlike_types", "customer", [_LOOKUP | {"localField": "c_name"}, mapped(add_field("n", {"type": "SIZE", "operand": "found"}), add_field("found", None))],
    "SELECT c_custkey, c_name, CAST(NULL AS INTEGER) AS n FROM customer", ["c_custkey", "c_name"],
)
add("count_all", "lineitem", [{"type": "COUNT"}], "SELECT count(*) AS count FROM lineitem")
add("count_filtered", "lineitem", [where(_A), {"type": "COUNT"}], "SELECT count(*) AS count FROM lineitem WHERE l_quantity > 25")
add("distinct_field", "customer", [{"type": "DISTINCT", "fieldName": "c_mktsegment"}], "SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL")
add("distinct_document", "lineitem", [{"type": "DISTINCT"}], "SELECT DISTINCT l_returnflag, l_linestatus, l_tax FROM lineitem", ["l_orderkey AS _id", "l_returnflag", "l_linestatus", "l_tax"])
QUERIES["distinct_document"] = lambda spark, sf_dir: Pipeline.parse([{"type": "DISTINCT"}]).apply(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("_id"), "l_returnflag", "l_linestatus", "l_tax"))

# Sort, limit, skip

for _name, _up in (("asc", True), ("desc", False)):
    add(f"sort_{_name}_limit", "orders", [{"type": "SORT", "fieldName": "o_totalprice", "ascending": _up}, {"type": "LIMIT", "limit": 20}], f"SELECT * FROM orders ORDER BY o_totalprice {_name} NULLS LAST, o_orderkey LIMIT 20", ties=("o_orderkey",))
add(
    "sort_skip_limit", "orders", [{"type": "SORT", "fieldName": "o_orderpriority", "ascending": True}, {"type": "SKIP", "skip": 30}, {"type": "LIMIT", "limit": 25}],
    "SELECT * FROM orders ORDER BY o_orderpriority NULLS LAST, o_orderkey LIMIT 25 OFFSET 30", ties=("o_orderkey",),
)
add(
    "pipeline_flagship", "lineitem",
    [
        where(both("AND", test("SMALLER_THAN_EQUALS", "l_shipdate", "#datetime(1998-09-02T00:00:00)"), test("GREATER_THAN", "l_quantity", 10))),
        mapped(add_field("charge", {"type": "MULTIPLY", "operands": ["l_extendedprice", "l_tax"]})),
        where(test("GREATER_THAN", "charge", 100)),
        {"type": "GROUP_BY", "fieldName": "l_suppkey"},
        mapped(add_field("n", {"type": "SIZE", "operand": "group"}), add_field("group", None)),
        {"type": "SORT", "fieldName": "n", "ascending": False},
        {"type": "LIMIT", "limit": 50},
    ],
    "SELECT l_suppkey, CAST(count(*) AS INTEGER) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' AND l_quantity > 10"
    " AND CASE WHEN l_extendedprice = 0 THEN l_extendedprice + l_tax ELSE l_extendedprice * l_tax END > 100 GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 50",
    ties=("l_suppkey",),
)

# Change logs and documents


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")


QUERIES["upsert_latest_wins"] = lambda spark, sf_dir: latest(_log(spark, sf_dir), "user_id", "event_id")
ORACLES["upsert_latest_wins"] = "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1"
QUERIES["delete_tombstone"] = lambda spark, sf_dir: latest(_log(spark, sf_dir), "user_id", "event_id", F.col("event_id") % 3 == 0)
ORACLES["delete_tombstone"] = ORACLES["upsert_latest_wins"] + " AND event_id % 3 <> 0"


def _event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.to_json(F.struct(F.col("event_id").cast("string").alias("_id"), "event_type", "value", F.from_json("props", "k long").alias("props"))).alias("json"))
    return documents(rows, "json")


def _field(name: str, kind: str):
    return F.try_variant_get(F.try_element_at(F.col(DOC), F.lit(name)), "$", kind).alias(name)


def add_document(name: str, steps: list[dict], shape: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: shape(Pipeline.parse(steps).apply(_event_documents(spark, sf_dir), lambda _: _event_documents(spark, sf_dir)))
    ORACLES[name] = sql


_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_SIZE = mapped(add_field("n", {"type": "SIZE", "operand": "group"}), add_field("group", None))
add_document("json_props_filter", [where(test("GREATER_THAN", "props.k", 50))], lambda df: df.select(_field("_id", "string"), _field("value", "double")), f"SELECT CAST(event_id AS VARCHAR) AS _id, value FROM events WHERE {_K} > 50")
add_document("json_object_equals", [where(test("EQUALS", "props", {"k": 7}))], lambda df: df.select(_field("_id", "string")), f"SELECT CAST(event_id AS VARCHAR) AS _id FROM events WHERE {_K} = 7")
add_document("json_nor", [where(both("NOR", test("EQUALS", "event_type", "CLICK"), test("EQUALS", "missing", 1))), {"type": "COUNT"}], lambda df: df.select(_field("count", "long")), "SELECT count(*) AS count FROM events WHERE NOT coalesce(lower(event_type) = 'click', false)")
add_document("json_group_size", [{"type": "GROUP_BY", "fieldName": "event_type"}, _SIZE], lambda df: df.select(_field("event_type", "string"), _field("n", "long")), "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
add_document("json_distinct", [{"type": "DISTINCT", "fieldName": "props"}], lambda df: df.select(F.try_variant_get(F.try_element_at(DOC, F.lit("props")), "$.k", "long").alias("k")), f"SELECT DISTINCT {_K} AS k FROM events")
add_document(
    "json_map_sort_limit", [mapped(add_field("twice", {"type": "MULTIPLY", "operands": ["value", 2]}), add_field("value", None)), {"type": "SORT", "fieldName": "twice", "ascending": False}, {"type": "LIMIT", "limit": 20}],
    lambda df: df.select(_field("_id", "string"), _field("twice", "double")), "SELECT CAST(event_id AS VARCHAR) AS _id, value * 2 AS twice FROM events ORDER BY twice DESC, _id LIMIT 20",
)
add_document(
    "json_lookup_size", [where(test("SMALLER_THAN", "props.k", 3)), {"type": "JOIN", "joinCollection": "events", "localField": "props", "remoteField": "props", "asField": "same"}, mapped(add_field("n", {"type": "SIZE", "operand": "same"}), add_field("same", None))],
    lambda df: df.select(_field("_id", "string"), _field("n", "long")), f"SELECT CAST(event_id AS VARCHAR) AS _id, n FROM events JOIN (SELECT {_K} AS k2, count(*) AS n FROM events GROUP BY 1) ON {_K} = k2 WHERE {_K} < 3",
)



def json_number_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that are written in several ways, and strings that look like them, as groups."""
    forms = F.element_at(F.array(*[F.concat(F.lit(a), F.col("p_size").cast("string"), F.lit(b)) for a, b in (("", ""), ("", ".0"), ("", "e0"), ('"x:', '.0,y"'), ('{"k":[', '.50e0]}'))]), F.pmod("p_partkey", F.lit(5)).cast("int") + 1)
    texts = table(spark, sf_dir, "part").select(F.concat(F.lit('{"v":'), forms, F.lit("}")).alias("json"))
    found = Pipeline.parse([{"type": "GROUP_BY", "fieldName": "v"}, _SIZE]).apply(documents(texts, "json"))
    return found.select(F.to_json(F.try_element_at(DOC, F.lit("v"))).alias("v"), _field("n", "long"))


QUERIES["json_number_forms"] = json_number_forms
ORACLES["json_number_forms"] = (
    "SELECT CASE WHEN p_partkey % 5 < 3 THEN '' || p_size WHEN p_partkey % 5 = 3 THEN '\"x:' || p_size || '.0,y\"' ELSE '{\"k\":[' || p_size || '.5]}' END AS v, count(*) AS n FROM part GROUP BY 1"
)

# Stored collections, through the engine


def _engine(spark: SparkSession, interval: str = "1 second") -> Engine:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='docpipe-stored-')}"
    engine = Engine(spark, f"{root.rstrip('/')}/stored-{uuid.uuid4().hex}", admin=("root", "rootpass1"), listen_interval=interval)
    engine.catalog.create_database("shop")
    return engine


def _texts(df: DataFrame, key: str, *columns: str) -> DataFrame:
    return df.select(F.to_json(F.struct(F.col(key).cast("string").alias("_id"), *columns)).alias("json"))


def find_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for three ids of a stored collection, one of which isn't there."""
    engine = _engine(spark)
    engine.catalog.create_collection("shop", "customers").load(_texts(table(spark, sf_dir, "customer"), "c_custkey", "c_name", "c_acctbal"), "json")
    session = engine.session()
    session.handle({"type": "AUTHENTICATE", "username": "root", "password": "rootpass1"})
    asked = [(i, session.handle({"type": "FIND_BY_ID", "databaseName": "shop", "collectionName": "customers", "_id": i})) for i in ("1", "42", "no-such")]
    return spark.createDataFrame([(i, a["status"], (a.get("object") or {}).get("c_name"), float(a["object"]["c_acctbal"]) if "object" in a else None) for i, a in asked], "_id string, status string, c_name string, c_acctbal double")


QUERIES["find_by_id"] = find_by_id
ORACLES["find_by_id"] = "SELECT i AS _id, CASE WHEN c_custkey IS NULL THEN 'NOT_FOUND' ELSE 'OK' END AS status, c_name, c_acctbal FROM (SELECT unnest(['1', '42', 'no-such']) AS i) LEFT JOIN customer ON i = CAST(c_custkey AS VARCHAR)"


def save_delete_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BULK_SAVE, SAVE and DELETE requests, then what AGGREGATE gives."""
    session = _engine(spark).session()
    session.handle({"type": "AUTHENTICATE", "username": "root", "password": "rootpass1"})
    ask = lambda kind, **more: session.handle({"type": kind, "databaseName": "shop", "collectionName": "nations"} | more)
    ask("BULK_SAVE", objects=[{"_id": str(r["n_nationkey"]), "name": r["n_name"], "region": r["n_regionkey"]} for r in table(spark, sf_dir, "nation").collect()])
    ask("SAVE", object={"_id": "3", "name": "renamed", "region": 1.0})
    ask("DELETE", _id="7")
    found = ask("AGGREGATE", aggregationSteps=[where(test("SMALLER_THAN", "region", 3)), mapped(add_field("label", {"type": "CONCAT", "operands": ["name", "--", "region"]}))])
    return spark.createDataFrame([(r["_id"], r["label"]) for r in found["results"]], "_id string, label string")


QUERIES["save_delete_aggregate"] = save_delete_aggregate
ORACLES["save_delete_aggregate"] = "SELECT * FROM (SELECT CAST(n_nationkey AS VARCHAR) AS _id, CASE WHEN n_nationkey = 3 THEN 'renamed-1' ELSE n_name || '-' || n_regionkey END AS label FROM nation WHERE n_nationkey <> 7 AND (n_regionkey < 3 OR n_nationkey = 3))"


def indexed_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter that an index answers, with later changes on top of the snapshot."""
    engine = _engine(spark)
    store = engine.catalog.create_collection("shop", "parts")
    store.load(_texts(table(spark, sf_dir, "part"), "p_partkey", "p_size", "p_brand"), "json")
    store.create_index("p_size")
    store.save([{"_id": "1", "p_size": 7, "p_brand": "changed"}, {"_id": "new", "p_size": 7.0, "p_brand": "new"}])
    return engine.aggregate("shop", "parts", [where(test("EQUALS", "p_size", 7))]).select(_field("_id", "string"), _field("p_brand", "string"))


QUERIES["indexed_filter"] = indexed_filter
ORACLES["indexed_filter"] = "SELECT CAST(p_partkey AS VARCHAR) AS _id, p_brand FROM part WHERE p_size = 7 AND p_partkey <> 1 UNION ALL SELECT '1', 'changed' UNION ALL SELECT 'new', 'new'"


def indexed_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _engine(spark)
    store = engine.catalog.create_collection("shop", "parts")
    store.load(_texts(table(spark, sf_dir, "part"), "p_partkey", "p_size"), "json")
    store.create_index("p_size")
    return engine.aggregate("shop", "parts", [{"type": "DISTINCT", "fieldName": "p_size"}]).select(_field("p_size", "long"))


QUERIES["indexed_distinct"] = indexed_distinct
ORACLES["indexed_distinct"] = "SELECT DISTINCT CAST(p_size AS BIGINT) AS p_size FROM part"

# Advice and live queries


def bulk_save_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents a batch inserts into a stored collection and which it updates: customers saved over suppliers of the same ids."""
    store = _engine(spark).catalog.create_collection("shop", "parties")
    store.load(_texts(table(spark, sf_dir, "supplier"), "s_suppkey", "s_name"), "json")
    return store.save_table(_texts(table(spark, sf_dir, "customer"), "c_custkey", "c_name"), "json")


QUERIES["bulk_save_classified"] = bulk_save_classified
ORACLES["bulk_save_classified"] = "SELECT CAST(c_custkey AS VARCHAR) AS _id, CASE WHEN c_custkey IN (SELECT s_suppkey FROM supplier) THEN 'updated' ELSE 'inserted' END AS change FROM customer"


def analyze_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = Pipeline.parse([{"type": "SORT", "fieldName": "o_orderdate", "ascending": True}, where(test("EQUALS", "o_orderstatus", "f"))]).steps
    return spark.createDataFrame([(s,) for s in suggestions(steps, False)], "suggestion string")


QUERIES["analyze_suggestions"] = analyze_suggestions
ORACLES["analyze_suggestions"] = (
    "SELECT unnest(['No index was used for this query. Consider creating an index on: o_orderdate, o_orderstatus.',"
    " 'FILTER step on field ''o_orderstatus'' at step 2 is not the first step; move it to the top of the pipeline so it can use an index and reduce documents scanned.']) AS suggestion"
)


def listen_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A live count over a stored collection: its first result, then what is pushed after a change that matters and one that doesn't."""
    engine = _engine(spark, "0 seconds")
    store = engine.catalog.create_collection("shop", "events")
    store.load(table(spark, sf_dir, "events").select(F.to_json(F.struct(F.col("event_id").cast("string").alias("_id"), "event_type")).alias("json")), "json")
    pipeline = Pipeline.parse([where(test("EQUALS", "event_type", "click")), {"type": "COUNT"}])
    pushed: list[dict] = []
    _, first = engine.listeners.add(lambda: engine.compile("shop", "events", pipeline), [store.path], pipeline.sorted_at_end, pushed.append)
    try:
        for added in ({"_id": "new-1", "event_type": "click"}, {"_id": "new-2", "event_type": "other"}):
            store.save([added])
            engine.listeners.settle()
    finally:
        engine.listeners.stop_where(lambda _: True)
    rows = [(0, first[0]["count"]), *[(n, p["results"][0]["count"]) for n, p in enumerate(pushed, 1)]]
    return spark.createDataFrame(rows, "push int, count long")


QUERIES["listen_changed"] = listen_changed
ORACLES["listen_changed"] = "SELECT CAST(k AS INTEGER) AS push, count(*) + k AS count FROM events, (SELECT unnest([0, 1]) AS k) WHERE lower(event_type) = 'click' GROUP BY k"
