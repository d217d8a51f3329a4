"""Fields of documents as Columns, for the two forms of a collection.

*Typed*: an ordinary DataFrame; a path is a column or a nested field, SQL NULL stands for a missing field. *Documents*: one
column ``doc`` of type map<string, variant>; a missing field and an explicit null differ.

Every method gives NULL, or false for tests, where the field is missing or has another type.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from docpipe.functions.values import custom_parts, custom_type, kind_of

DOC = "doc"


def sure(c: Column) -> Column:
    """A test that is never NULL."""
    return F.coalesce(c, F.lit(False))


def quoted(path: str) -> str:
    return "`" + path.replace("`", "``") + "`"


class TypedAccess:
    def __init__(self, df: DataFrame):
        self.schema = df.schema

    def type_of(self, path: str) -> T.DataType | None:
        kind: T.DataType = self.schema
        for part in path.split("."):
            if not isinstance(kind, T.StructType) or part not in kind.fieldNames():
                return None
            kind = kind[part].dataType
        return kind

    def kind(self, path: str) -> str | None:
        t = self.type_of(path)
        if t is None or isinstance(t, T.NullType):
            return None
        if isinstance(t, T.BooleanType):
            return "boolean"
        if isinstance(t, T.NumericType):
            return "number"
        if isinstance(t, T.StringType | T.CharType | T.VarcharType):
            return "string"
        if isinstance(t, T.TimestampNTZType | T.TimestampType):
            return "datetime"
        if type(t).__name__ == "TimeType":
            return "time"
        if isinstance(t, T.ArrayType):
            return "array"
        if isinstance(t, T.StructType | T.MapType):
            return "object"
        return "other"

    def column(self, path: str) -> Column:
        return F.col(".".join(map(quoted, path.split(".")))) if self.type_of(path) is not None else F.lit(None)

    def present(self, path: str) -> Column:
        return self.column(path).isNotNull()

    def is_null(self, path: str) -> Column:
        return self.column(path).isNull()

    def number(self, path: str) -> Column:
        return self.column(path).cast("double") if self.kind(path) == "number" else F.lit(None).cast("double")

    def exact_number(self, path: str) -> Column:
        """In its own type, so that comparisons reach the files."""
        return self.column(path) if self.kind(path) == "number" else F.lit(None).cast("double")

    def text(self, path: str) -> Column:
        return self.column(path) if self.kind(path) == "string" else F.lit(None).cast("string")

    def boolean(self, path: str) -> Column:
        return self.column(path) if self.kind(path) == "boolean" else F.lit(None).cast("boolean")

    def custom(self, path: str, name: str) -> Column:
        if self.kind(path) == name and name == "datetime":
            return self.column(path).cast("timestamp_ntz")
        if self.kind(path) == name and name == "time":
            return custom_type("time").parse(self.column(path).cast("string"))
        return F.lit(None).cast("timestamp_ntz" if name == "datetime" else "long")

    def custom_text(self, path: str) -> Column:
        """The inner text of a custom value."""
        kind = self.kind(path)
        if kind == "datetime":
            return F.regexp_replace(self.column(path).cast("string"), " ", "T")
        return self.column(path).cast("string") if kind == "time" else F.lit(None).cast("string")

    def _literal(self, value: object, t: T.DataType) -> Column | None:
        """``value`` as a Column of type ``t``; None if no value of that type equals it."""
        k = kind_of(value)
        if k == "null":
            return F.lit(None).cast(t)
        if isinstance(t, T.ArrayType) and k == "array":
            parts = [self._literal(x, t.elementType) for x in value]
            return None if any(p is None for p in parts) else F.array(*parts).cast(t)
        if isinstance(t, T.StructType) and k == "object":
            if not set(value) <= set(t.fieldNames()):
                return None
            parts = [self._literal(value.get(f.name), f.dataType) for f in t.fields]
            return None if any(p is None for p in parts) else F.struct(*[p.alias(f.name) for p, f in zip(parts, t.fields, strict=True)]).cast(t)
        if isinstance(t, T.BooleanType) and k == "boolean" or isinstance(t, T.StringType) and k in ("string", "custom"):
            return F.lit(value)
        if isinstance(t, T.NumericType) and k == "number":
            whole = isinstance(t, T.IntegralType)
            if whole and float(value) != int(value):
                return None
            return F.lit(int(value) if whole else float(value)).cast(t)
        return None

    def equals(self, path: str, value: object) -> Column:
        """Whole-value equality, exact case."""
        t = self.type_of(path)
        if t is None:
            return F.lit(False)
        if kind_of(value) == "custom" and self.kind(path) in ("datetime", "time"):
            name, inner = custom_parts(value)
            return sure(self.custom(path, name) == custom_type(name).parse(F.lit(inner)))
        literal = self._literal(value, t)
        return F.lit(False) if literal is None else sure(self.column(path) == literal)

    def member(self, path: str, values: list) -> Column:
        t = self.type_of(path)
        if t is None:
            return F.lit(False)
        if self.kind(path) in ("datetime", "time"):
            return reduce(lambda a, b: a | b, [self.equals(path, v) for v in values], F.lit(False))
        literals = [x for v in values if v is not None and (x := self._literal(v, t)) is not None]
        return sure(self.column(path).isin(*literals)) if literals else F.lit(False)

    def is_array(self, path: str) -> Column:
        return self.present(path) if self.kind(path) == "array" else F.lit(False)

    def is_object(self, path: str) -> Column:
        return self.present(path) if self.kind(path) == "object" else F.lit(False)

    def array_has(self, path: str, value: object) -> Column:
        t = self.type_of(path)
        if not isinstance(t, T.ArrayType):
            return F.lit(False)
        literal = self._literal(value, t.elementType)
        return F.lit(False) if literal is None else sure(F.exists(self.column(path), lambda x: sure(x == literal)))

    def size(self, path: str) -> Column:
        kind = self.kind(path)
        if kind == "string":
            return F.length(self.column(path))
        return F.when(self.present(path), F.size(self.column(path))) if kind == "array" else F.lit(None).cast("int")

    def json_text(self, path: str) -> Column:
        """JSON of a value that is no string, the text of one that is; NULL if missing."""
        kind = self.kind(path)
        c = self.column(path)
        if kind in ("array", "object"):
            return F.to_json(c)
        if kind in ("datetime", "time"):
            return self.custom_text(path)
        if kind == "number":
            return number_text(c) if not isinstance(self.type_of(path), T.IntegralType) else c.cast("string")
        return c.cast("string")


class DocumentAccess:
    """Fields of ``doc``, a map from top-level names to variants."""

    def _doc(self) -> Column:
        return F.col(DOC)

    def column(self, path: str) -> Column:
        head, *rest = path.split(".")
        v = F.try_element_at(self._doc(), F.lit(head))
        if rest:
            v = F.try_variant_get(v, "$" + "".join("['" + p.replace("\\", "\\\\").replace("'", "\\'") + "']" for p in rest), "variant")
        return v

    def _schema(self, path: str) -> Column:
        return F.schema_of_variant(self.column(path))

    def present(self, path: str) -> Column:
        return self.column(path).isNotNull()

    def is_null(self, path: str) -> Column:
        return sure(F.is_variant_null(self.column(path)))

    def _is_number(self, path: str) -> Column:
        s = self._schema(path)
        return s.isin("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT") | s.startswith("DECIMAL")

    def number(self, path: str) -> Column:
        return F.when(self._is_number(path), F.try_variant_get(self.column(path), "$", "double"))

    exact_number = number

    def _string(self, path: str) -> Column:
        return F.when(self._schema(path) == "STRING", F.try_variant_get(self.column(path), "$", "string"))

    def _is_custom(self, c: Column) -> Column:
        return c.rlike(r"^(?s)#[a-zA-Z0-9]{3,20}\(.*\)$")

    def text(self, path: str) -> Column:
        c = self._string(path)
        return F.when(~self._is_custom(c), c)

    def boolean(self, path: str) -> Column:
        return F.when(self._schema(path) == "BOOLEAN", F.try_variant_get(self.column(path), "$", "boolean"))

    def custom(self, path: str, name: str) -> Column:
        c = self._string(path)
        inner = F.when(c.startswith(f"#{name}(") & c.endswith(")"), F.substring(c, len(name) + 3, F.length(c) - (len(name) + 3)))
        return custom_type(name).parse(inner)

    def custom_text(self, path: str) -> Column:
        c = self._string(path)
        return F.when(self._is_custom(c), F.regexp_extract(c, r"^(?s)#[a-zA-Z0-9]{3,20}\((.*)\)$", 1))

    def canonical(self, path: str) -> Column:
        return canonical_json(self.column(path))

    def equals(self, path: str, value: object) -> Column:
        return sure(self.canonical(path) == canonical_literal(value))

    def member(self, path: str, values: list) -> Column:
        texts = [canonical_literal(v) for v in values if v is not None]
        return sure(self.canonical(path).isin(*texts)) if texts else F.lit(False)

    def is_array(self, path: str) -> Column:
        return self._array(path).isNotNull()

    def is_object(self, path: str) -> Column:
        return F.try_variant_get(self.column(path), "$", "map<string,variant>").isNotNull()

    def _array(self, path: str) -> Column:
        return F.try_variant_get(self.column(path), "$", "array<variant>")

    def array_has(self, path: str, value: object) -> Column:
        return sure(F.exists(self._array(path), lambda x: sure(canonical_json(x) == canonical_literal(value))))

    def size(self, path: str) -> Column:
        return F.coalesce(F.length(self.text(path)), F.when(self.is_array(path), F.size(self._array(path))))

    def json_text(self, path: str) -> Column:
        return F.coalesce(self.custom_text(path), self._string(path), canonical_json(self.column(path)))


def number_text(c: Column) -> Column:
    """A number's text, whole numbers without a fraction."""
    d = c.cast("double")
    whole = (d == F.floor(d)) & (F.abs(d) < 1e15)
    return F.when(whole, d.cast("decimal(20,0)").cast("string")).otherwise(d.cast("string"))


#: JSON text in parts: string literals, numbers, and what stands between.
_PARTS = r'("(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|[^"0-9-]+)'


def _folded_number(part: Column) -> Column:
    whole = part.rlike(r"^-?\d{1,18}$") & (part != "-0")
    d = part.try_cast("double")
    near = (d == F.floor(d)) & (F.abs(d) < 1e18)
    return F.when(whole, part).when(near, F.when(near, d).cast("decimal(20,0)").cast("string")).otherwise(d.cast("string"))


def canonical_json(v: Column) -> Column:
    """JSON of a variant with sorted keys. Numbers have one form whatever their type: whole numbers below 10^18 their digits, others
    that of a double. Strings stay as they are."""
    text = F.to_json(v)

    def folded(t: Column) -> Column:
        parts = F.regexp_extract_all(t, F.lit(_PARTS), F.lit(1))
        return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^-?[0-9]"), _folded_number(x)).otherwise(x)), "")

    plain = text.startswith('"') | text.isin("true", "false", "null") | (text.rlike(r"^-?\d{1,18}$") & (text != "-0"))
    return F.when(plain, text).otherwise(folded(text))


def canonical_literal(value: object) -> Column:
    """The same text of a Python value, by the same expression."""
    return canonical_json(F.parse_json(F.lit(json.dumps(value, ensure_ascii=False, allow_nan=False))))


def unused(columns: Iterable[str]) -> str:
    """A prefix that no column's name starts with."""
    names, out = [c.lower() for c in columns], "__"
    while any(n.startswith(out) for n in names):
        out += "_"
    return out


def as_variant(c: Column, kind: str) -> Column:
    """A scalar Column as a variant; NULL becomes the null value, whole numbers lose their fraction."""
    null = F.parse_json(F.lit("null"))
    if kind != "number":
        return F.coalesce(c.cast("variant"), null)
    d = c.cast("double")
    whole = (d == F.floor(d)) & (F.abs(d) < 9e15)
    return F.when(d.isNull(), null).when(whole, F.when(whole, d).cast("bigint").cast("variant")).otherwise(d.cast("variant"))


def access_for(df: DataFrame) -> TypedAccess | DocumentAccess:
    return DocumentAccess() if is_documents(df) else TypedAccess(df)


def is_documents(df: DataFrame) -> bool:
    if df.columns != [DOC]:
        return False
    t = df.schema[DOC].dataType
    return isinstance(t, T.MapType) and isinstance(t.valueType, T.VariantType)


def parsed(df: DataFrame, json_column: str) -> Column:
    """The JSON texts of a column of ``df`` as maps, NULL where they are no object. Of equal keys in an object the last one counts."""
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return F.try_variant_get(F.try_parse_json(F.col(quoted(json_column))), "$", "map<string,variant>")


def documents(df: DataFrame, json_column: str) -> DataFrame:
    """JSON texts of objects as a collection of documents; malformed texts are left out."""
    # Not a filter: that would be pushed below the parsing and parse every text once more.
    return df.select(F.explode(F.array_compact(F.array(parsed(df, json_column)))).alias(DOC))


def to_rows(df: DataFrame) -> list[dict]:
    """Collected results as Python objects."""
    if is_documents(df):
        return [json.loads(r[0]) for r in df.select(F.to_json(F.to_variant_object(F.col(DOC)))).collect()]
    return [r.asDict(recursive=True) for r in df.collect()]
