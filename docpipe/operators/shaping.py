"""Steps that aren't filters: map, group, lookup join, count, distinct, sort, limit and skip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docpipe.functions.access import DOC, DocumentAccess, TypedAccess, access_for, as_variant, canonical_json, is_documents, quoted, unused
from docpipe.functions.scalars import scalar
from docpipe.operators.predicates import Test, predicate
from docpipe.plans.steps import FieldChange, Join, Sort

GROUP = "group"


def filtered(df: DataFrame, test: Test) -> DataFrame:
    return df.where(predicate(test, access_for(df)))


def mapped(df: DataFrame, changes: tuple[FieldChange, ...]) -> DataFrame:
    """One change after the other; later ones see what earlier ones made."""
    for change in changes:
        df = _changed_document(df, change) if is_documents(df) else _changed_row(df, change)
    return df


def _changed_row(df: DataFrame, change: FieldChange) -> DataFrame:
    fields = TypedAccess(df)
    name, have = change.name, change.name in df.columns
    when = predicate(change.condition, fields, True) if change.condition is not None else None
    if change.scalar is None:
        if not have:
            return df
        # A typed column can't be missing in some rows only: there it becomes NULL.
        return df.drop(name) if when is None else df.withColumn(name, F.when(~when, F.col(quoted(name))))
    value, _ = scalar(change.scalar, fields)
    if when is not None:
        value = F.when(when, value)
        if have:
            value = value.otherwise(F.col(quoted(name)))
    return df.withColumn(name, value)


def _changed_document(df: DataFrame, change: FieldChange) -> DataFrame:
    fields, doc = DocumentAccess(), F.col(DOC)
    rest = F.map_filter(doc, lambda k, _: k != change.name)
    if change.scalar is not None:
        value, kind = scalar(change.scalar, fields)
        rest = F.map_concat(rest, F.create_map(F.lit(change.name), as_variant(value, kind)))
    if change.condition is not None:
        rest = F.when(predicate(change.condition, fields, True), rest).otherwise(doc)
    return df.select(rest.alias(DOC))


def _packed(df: DataFrame) -> Column:
    """A whole row or document as one value."""
    return F.to_variant_object(F.col(DOC)) if is_documents(df) else F.struct(*[F.col(quoted(c)) for c in df.columns])


def grouped(df: DataFrame, field: str, sizes_only: bool = False) -> DataFrame:
    """One row for each value of the field: the value and its rows under ``group``, or with ``sizes_only`` their number."""
    fields = access_for(df)
    rows = F.count(F.lit(1)).cast("int") if sizes_only else F.collect_list(_packed(df))
    if not is_documents(df):
        return df.where(fields.present(field)).groupBy(fields.column(field).alias(field)).agg(rows.alias(GROUP))
    key = fields.canonical(field)
    found = df.where(fields.present(field)).groupBy(key.alias("key")).agg(rows.alias(GROUP))
    group = as_variant(F.col(GROUP), "number") if sizes_only else F.col(GROUP).cast("variant")
    return found.select(F.create_map(F.lit(field), F.parse_json("key"), F.lit(GROUP), group).alias(DOC))


def looked_up(df: DataFrame, remote: DataFrame, join: Join, sizes_only: bool = False) -> DataFrame:
    """Each row with the remote rows of equal key under a new field; NULL where there are none. Keys of different kinds are never equal."""
    own, other = access_for(df), access_for(remote)
    p = unused([*df.columns, *remote.columns])
    rows = F.count(F.lit(1)).cast("int") if sizes_only else F.collect_list(_packed(remote))
    if not is_documents(df) and not is_documents(remote):
        matches = remote.where(other.present(join.remote)).groupBy(other.column(join.remote).alias(f"{p}key")).agg(rows.alias(f"{p}rows"))
        kept = [F.col(quoted(c)) for c in df.columns if c != join.into]
        if own.kind(join.local) != other.kind(join.remote) or own.kind(join.local) is None:
            return df.select(*kept, F.lit(None).cast(matches.schema[f"{p}rows"].dataType).alias(join.into))
        return df.withColumn(f"{p}local", own.column(join.local)).join(matches, F.col(f"{p}local") == F.col(f"{p}key"), "left").select(*kept, F.col(f"{p}rows").alias(join.into))
    if not (is_documents(df) and is_documents(remote)):
        raise ValueError("a lookup needs two collections of the same form")
    # Texts of values as keys: an explicit null finds explicit nulls.
    matches = remote.where(other.present(join.remote)).groupBy(other.canonical(join.remote).alias(f"{p}key")).agg(rows.alias(f"{p}rows"))
    joined = df.withColumn(f"{p}local", own.canonical(join.local)).join(matches, F.col(f"{p}local") == F.col(f"{p}key"), "left")
    found = F.col(f"{p}rows")
    value = as_variant(found, "number") if sizes_only else F.coalesce(found.cast("variant"), F.parse_json(F.lit("null")))
    with_field = F.map_concat(F.map_filter(F.col(DOC), lambda k, _: k != join.into), F.create_map(F.lit(join.into), value))
    return joined.select(F.when(F.col(f"{p}local").isNull(), F.col(DOC)).otherwise(with_field).alias(DOC))


def counted(df: DataFrame) -> DataFrame:
    n = df.groupBy().agg(F.count(F.lit(1)).alias("count"))
    return n.select(F.create_map(F.lit("count"), F.col("count").cast("variant")).alias(DOC)) if is_documents(df) else n


def distinct(df: DataFrame, field: str | None) -> DataFrame:
    """Distinct values of a field, null among them, or distinct rows without their ids."""
    fields = access_for(df)
    if not is_documents(df):
        return df.where(fields.present(field)).select(fields.column(field).alias(field)).distinct() if field else df.drop("_id").distinct()
    if field:
        return df.where(fields.present(field)).select(fields.canonical(field).alias("key")).distinct().select(F.create_map(F.lit(field), F.parse_json("key")).alias(DOC))
    rest = F.to_variant_object(F.map_filter(F.col(DOC), lambda k, _: k != "_id"))
    return df.select(canonical_json(rest).alias("key")).distinct().select(F.variant_get(F.parse_json("key"), "$", "map<string,variant>").alias(DOC))


def sort_keys(df: DataFrame, sort: Sort, ties: list[str]) -> list[Column]:
    """Missing and null values last in either direction; true before false in either direction."""
    fields, path = access_for(df), sort.field

    def way(c: Column) -> Column:
        return c.asc_nulls_last() if sort.ascending else c.desc_nulls_last()

    if not is_documents(df):
        last = [F.col(quoted(t)).asc_nulls_last() for t in ties if t in df.columns and t != path]
        kind = fields.kind(path)
        if kind is None or kind in ("array", "object", "other"):
            return last or [F.lit(0).asc()]
        c = fields.column(path)
        return [c.desc_nulls_last() if kind == "boolean" else way(c), *last]
    # Of several kinds: arrays and objects, booleans, numbers, strings and custom values, then null and missing.
    rank = (
        F.when(fields.is_array(path) | fields.is_object(path), 0)
        .when(fields.boolean(path).isNotNull(), 1)
        .when(fields.number(path).isNotNull(), 2)
        .when(fields.text(path).isNotNull(), 3)
        .when(fields.custom_text(path).isNotNull(), 4)
        .otherwise(5)
    )
    own = F.try_variant_get(F.try_element_at(F.col(DOC), F.lit("_id")), "$", "string")
    return [rank.asc(), fields.boolean(path).desc_nulls_last(), way(fields.number(path)), way(F.coalesce(fields.text(path), fields.custom_text(path))), own.asc_nulls_last()]
