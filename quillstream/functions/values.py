"""Values of the dialect over Spark columns: static kinds in typed mode, variants in dynamic mode.

A predicate or a conversion asks a value for its number, string or truth; what has
another kind answers null. A kind that the schema fixes is decided while binding, so
comparisons on typed columns stay plain and reach the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The number grammar accepted from strings.
NUMERIC = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?$"
ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


@dataclass(frozen=True)
class Value:
    kind: str  # number, string, boolean, null, array, object, variant
    col: Column
    exists: Column | None = None  # None: always there
    field: bool = False
    type: T.DataType | None = None  # of a typed column
    time: Column | None = None  # the timestamp whose text this is
    schema: Column | None = None  # of a variant, where it is already computed

    @property
    def there(self) -> Column:
        return F.lit(True) if self.exists is None else self.exists


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, (T.StringType, T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "string"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.ArrayType):
        return "array"
    if isinstance(t, (T.StructType, T.MapType)):
        return "object"
    if isinstance(t, T.VariantType):
        return "variant"
    return "null" if isinstance(t, T.NullType) else "object"


def column_value(col: Column, t: T.DataType) -> Value:
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return Value("string", F.date_format(col, ISO), field=True, type=t, time=col)
    if isinstance(t, T.DateType):
        return Value("string", F.date_format(col, "yyyy-MM-dd"), field=True)
    return Value(kind_of(t), col, field=True, type=t)


def literal(v: object) -> Value:
    kind = "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string"
    return Value(kind, F.lit(v))


def schema(v: Value) -> Column:
    return v.schema if v.schema is not None else F.schema_of_variant(v.col)


def tag(v: Value) -> Column:
    """number, string, boolean, null, array or object; null where the value is missing."""
    if v.kind != "variant":
        return F.when(v.col.isNull(), F.lit("null")).otherwise(F.lit(v.kind))
    s = schema(v)
    return (
        F.when(v.col.isNull(), F.lit(None))
        .when(s == "BIGINT", "number")
        .when(s == "STRING", "string")
        .when(s.isin("DOUBLE", "FLOAT") | s.startswith("DECIMAL"), "number")
        .when(s == "BOOLEAN", "boolean")
        .when(s == "VOID", "null")
        .when(s.startswith("ARRAY"), "array")
        .otherwise("object")
    )


def _of(v: Value, kind: str, spark_type: str) -> Column:
    if v.kind == kind:
        return v.col
    if v.kind == "variant":
        return F.when(tag(v) == kind, F.try_variant_get(v.col, "$", spark_type))
    return F.lit(None).cast(spark_type)


def number(v: Value) -> Column:
    return _of(v, "number", "double")


def string(v: Value) -> Column:
    return _of(v, "string", "string")


def truth(v: Value) -> Column:
    return _of(v, "boolean", "boolean")


def numeric(v: Value) -> Column:
    """A number, or a string that is one, as double."""
    if v.kind == "number":
        return v.col.cast("double")
    if v.kind == "string":
        return F.when(v.col.rlike(NUMERIC), v.col.try_cast("double"))
    if v.kind == "variant":
        s = F.try_variant_get(v.col, "$", "string")
        kind = tag(v)
        return F.when(kind == "number", F.try_variant_get(v.col, "$", "double")).when((kind == "string") & s.rlike(NUMERIC), s.try_cast("double"))
    return F.lit(None).cast("double")


def finite(x: Column) -> Column:
    """Null instead of NaN and infinity."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def number_text(x: Column) -> Column:
    """Shortest plain text: no exponent for 1e-6 <= |x| < 1e21, no `.0`."""
    x = x.cast("double")
    size = F.abs(x)
    plain = F.regexp_replace(F.regexp_replace(x.try_cast("decimal(38,15)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return (
        F.when(F.isnan(x) | (size == float("inf")), None)
        .when((x == F.floor(x)) & (size < 1e15), x.cast("bigint").cast("string"))
        .when((size >= 1e-3) & (size < 1e7), F.regexp_replace(x.cast("string"), r"\.0$", ""))
        .when((size >= 1e-6) & (size < 1e21), plain)
        .otherwise(x.cast("string"))
    )


def text(v: Value, exact: T.DataType | None = None) -> Column:
    """Text of a string, number or boolean; null for the rest."""
    if v.kind == "string":
        return v.col
    if v.kind == "number":
        return number_text(v.col)
    if v.kind == "boolean":
        return v.col.cast("string")
    if v.kind == "variant":
        return F.when(tag(v) == "number", F.coalesce(F.when(schema(v) == "BIGINT", F.try_variant_get(v.col, "$", "string")), number_text(number(v)))).otherwise(
            F.coalesce(string(v), truth(v).cast("string"))
        )
    return F.lit(None).cast("string")


def is_null(v: Value) -> Column:
    return v.col.isNull() if v.kind != "variant" else (v.col.isNull() | F.is_variant_null(v.col))


