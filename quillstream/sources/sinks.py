"""Sinks and routing: NDJSON, delimited and raw text; tee, reject and split."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import Value, kind_of, number_text, text
from ..runtime import Scratch


def json_text(col: Column, t: T.DataType) -> Column:
    """JSON of one cell, numbers in the dialect's form."""
    if isinstance(t, T.NumericType):
        out = col.cast("string") if isinstance(t, (T.IntegralType, T.DecimalType)) else number_text(col)
    elif isinstance(t, T.BooleanType):
        out = col.cast("string")
    elif isinstance(t, (T.VariantType, T.StructType, T.ArrayType, T.MapType)):
        out = F.to_json(col)
    else:
        wrapped = F.to_json(F.array(col.cast("string")))
        out = F.when(col.isNotNull(), wrapped.substr(F.lit(2), F.length(wrapped) - 2))
    return F.coalesce(out, F.lit("null"))


def to_ndjson(df: DataFrame) -> DataFrame:
    """One `value` column of lines `{"a": 1, "b": "x"}`."""
    if df.columns == ["_raw"]:
        return df.select(F.col("_raw").alias("value"))
    return df.select(F.concat(F.lit("{"), F.concat_ws(", ", *cells(df)), F.lit("}")).alias("value"))


def cells(df: DataFrame) -> list[Column]:
    """`"name": value` of each column."""
    return [F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ": "), json_text(F.col(f"`{f.name}`"), f.dataType)) for f in df.schema.fields]


def to_json_array(df: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Lines of one JSON array: `[`, an indented object a line, `]`; in the rows' order.

    The lines and their places are written to a scratch table (`lines`) at once: a plan that is run
    twice may deal its rows in other ways, and then the ends would be put at other rows.
    """
    at = to_ndjson(df).withColumn("__i", F.monotonically_increasing_id())
    lines = (scratch or Scratch(df.sparkSession, "array")).save("lines", at)
    start, end = lines.agg(F.min("__i"), F.max("__i")).first()
    if start is None:
        return lines.sparkSession.createDataFrame([("[",), ("]",)], "value string").coalesce(1)
    first, last = F.when(F.col("__i") == start, F.lit("[\n")).otherwise(F.lit("")), F.when(F.col("__i") == end, F.lit("\n]")).otherwise(F.lit(","))
    return lines.orderBy("__i").select(F.concat(first, F.lit("  "), "value", last).alias("value"))


def to_raw(df: DataFrame) -> DataFrame:
    """The first column as bare text."""
    f = df.schema.fields[0]
    return df.select(text(Value(kind_of(f.dataType), F.col(f"`{f.name}`"))).alias("value"))


def write(df: DataFrame, path: str, form: str = "ndjson") -> None:
    if form == "json":
        scratch = Scratch(df.sparkSession, "array")
        to_json_array(df, scratch).write.mode("overwrite").text(path)
        scratch.drop("lines")
    elif form == "ndjson":
        to_ndjson(df).write.mode("overwrite").text(path)
    elif form == "raw":
        to_raw(df).write.mode("overwrite").text(path)
    elif form in ("csv", "tsv"):
        flat = df.select(*[text(Value(kind_of(f.dataType), F.col(f"`{f.name}`"))).alias(f.name) for f in df.schema.fields])
        flat.write.mode("overwrite").csv(path, header=True, sep="," if form == "csv" else "\t", escape='"')
    else:
        raise ValueError(f"unknown form {form}")


def split_by(df: DataFrame, field: str, path: str) -> DataFrame:
    """Write rows as NDJSON to one `<value>.jsonl` for each text of a field; returns (field, file, count).

    Each is a folder of parts, so that no value's rows meet in one task. Null goes to null.jsonl, as
    the text 'null' does; rows without the field or with a nested value in it are left out.
    """
    spark, f = df.sparkSession, df.schema[field]
    v = Value(kind_of(f.dataType), F.col(f"`{field}`"))
    key = F.when(F.is_variant_null(v.col), "null").otherwise(text(v)) if v.kind == "variant" else F.coalesce(text(v), F.lit("null"))
    if v.kind in ("array", "object"):
        key = F.when(v.col.isNull(), F.lit("null"))
    name = F.concat(F.regexp_replace("__key", r"[^A-Za-z0-9._-]", "_"), F.lit(".jsonl"))
    line = F.concat(F.lit("{"), F.concat_ws(", ", *cells(df)), F.lit("}"))
    rows = df.select(key.alias("__key"), line.alias("value")).filter("__key is not null").withColumn("__file", name)
    rows.select("value", "__file").write.mode("overwrite").partitionBy("__file").text(path)
    out = rows.groupBy(F.col("__key").alias(field), F.col("__file").alias("file")).agg(F.count("*").alias("count"))
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(conf)
    for status in fs.listStatus(base):  # one folder a value
        folder = status.getPath()
        if folder.getName().startswith("__file="):
            fs.rename(folder, jvm.org.apache.hadoop.fs.Path(base, folder.getName()[len("__file=") :]))
    return out


def route(df: DataFrame, query: str, tee: str | None = None, reject: str | None = None, out: str | None = None, **args) -> DataFrame:
    """Run a query over records, or over lines (`value`); write all input (tee), what WHERE turns away (reject) and the result (out).

    Of lines, tee gets every one that is not blank, malformed ones too.
    """
    from ..plans.engine import Plan, parse, variables
    from .json import records

    lines = df.select(F.rtrim(F.col("value"), F.lit(" \t\r")).alias("_raw")).filter("_raw != ''") if "_raw" not in df.columns else df.select("_raw")
    if "_raw" not in df.columns:
        df = records(df).filter("_valid").drop("_valid")
    plan = Plan(df, parse(query, variables(args)))
    if tee:
        lines.write.mode("overwrite").text(tee)
    if reject:
        plan.df.filter(~plan.passing()).select("_raw").write.mode("overwrite").text(reject)
    result = plan.frame()
    if out:
        to_ndjson(result).write.mode("overwrite").text(out)
    return result
