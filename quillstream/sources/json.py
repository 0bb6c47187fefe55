"""JSON sources: newline-delimited records, single documents and their scopes.

A record is strict JSON: the line is parsed as the first of two items of an array
whose second is a sentinel, which the lenient parser can only do if nothing trails.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import read_lines

_MARK = "quillstream-end-6f1c0d6e5b7a4a0c"


def allow_duplicates(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def records(lines: DataFrame) -> DataFrame:
    """(_raw, _v, _valid[, _pos]) of the lines (`value`) that begin with an object; `_valid` is false for malformed ones."""
    allow_duplicates(lines.sparkSession)
    raw = F.trim(F.col("value"), F.lit(" \t\r\n"))
    body = F.when(raw.endswith(","), F.rtrim(F.substring(raw, 1, F.length(raw) - 1), F.lit(" \t\r\n"))).otherwise(raw)
    both = _marked(body)
    keep = [c for c in lines.columns if c != "value"]
    # as the one item of an array, so that filters on the parsed record do not move below the parser and parse again
    out = lines.filter(raw.startswith("{")).select(*keep, body.alias("_raw"), F.explode(F.array(both)).alias("__b"))
    first = F.try_variant_get("__b", "$[0]", "variant")
    return out.select(*keep, "_raw", first.alias("_v"), _strict(F.col("__b")).alias("_valid"))  # what begins with a brace and parses is an object


def _marked(body: Column) -> Column:
    return F.try_parse_json(F.concat(F.lit("["), body, F.lit(f', "{_MARK}"]')))


def _strict(both: Column) -> Column:
    return F.coalesce(F.try_variant_get(both, "$[1]", "string") == _MARK, F.lit(False))


def read_ndjson(spark: SparkSession, path: str, ordered: bool = True) -> tuple[DataFrame, DataFrame]:
    """(valid records, malformed lines). ordered: number the records so that LIMIT and ties follow the file."""
    lines = spark.read.text(path)
    if ordered:
        lines = lines.withColumn("_pos", F.monotonically_increasing_id())
    found = records(lines)
    return found.filter("_valid").drop("_valid"), found.filter("not _valid").select("_raw")


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """One row for each whole file: (_raw, _v, _pos)."""
    allow_duplicates(spark)
    out = spark.read.text(path, wholetext=True).select(F.col("value").alias("_raw"), F.try_parse_json("value").alias("_v"))
    return out.filter(F.col("_v").isNotNull()).withColumn("_pos", F.monotonically_increasing_id())


def read_array(spark: SparkSession, path: str) -> DataFrame:
    """The objects of one JSON array that has `[`, `]` and each element on a line: (_raw, _v, _pos).

    No row holds the whole array, so its size is not bounded. Elements that are not objects are skipped.
    An error is raised where brackets, commas or elements are not as in such an array; `read_document` reads other forms.
    """
    allow_duplicates(spark)
    lines = read_lines(spark, path).select(F.trim("line", F.lit(" \t\r\n")).alias("value"), F.col("_n").alias("_pos"))
    value, place = F.col("value"), F.col("_pos")
    bare, body = ~value.endswith(","), F.regexp_replace("value", ",$", "")
    no_json = F.when(value.startswith("{"), False).otherwise(~_strict(_marked(body)))
    told = lines.agg(F.max(place), F.min_by(value, place), F.max_by(value, place), F.count_if(no_json), F.count_if(bare), F.sum(F.when(bare, place))).first()
    n = told[0] or 0
    ends = (3, 2 * n) if n > 2 else (2, 3)  # the brackets and the last element have no comma after them
    if tuple(told)[1:] != ("[", "]", 2, *ends):
        raise ValueError(f"{path} is not one JSON array with an element a line")
    found = records(lines)
    return found.withColumn("_v", F.when(F.col("_valid"), F.col("_v")).otherwise(F.raise_error(F.concat(F.lit("malformed element: "), F.substring("_raw", 1, 200))))).drop("_valid")


def descend(df: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    """Rows of a scope `[a.b.*]`: each `*` opens an array; elements that are not objects are skipped.

    `[*]` on an object opens each of its arrays and adds the array's name as `_array`.
    """
    if scope == ("*",):
        items = df.select("_pos", F.explode(F.coalesce(F.try_variant_get("_v", "$", "array<variant>"), F.array().cast("array<variant>"))).alias("_v")).withColumn("_array", F.lit(None).cast("string"))
        named = df.select("_pos", F.explode(F.try_variant_get("_v", "$", "map<string,variant>")).alias("_array", "__x"))
        named = named.select("_pos", F.explode(F.try_variant_get("__x", "$", "array<variant>")).alias("_v"), "_array")
        df = items.unionByName(named)
    else:
        path, place = "$", F.array("_pos")  # rows of a scope are ordered by their places, one for each star
        for part in scope:
            if part == "*":
                df = df.select(place.alias("_pos"), F.posexplode(F.try_variant_get("_v", path, "array<variant>")).alias("__i", "_v"))
                df = df.select(F.concat("_pos", F.array(F.col("__i").cast("bigint"))).alias("_pos"), "_v")
                path, place = "$", F.col("_pos")
            else:
                path += f"[{part}]" if part.isdigit() else "['" + part.replace("'", "\\'") + "']"
        if path != "$":
            df = df.select("_pos", F.try_variant_get("_v", path, "variant").alias("_v"))
    keep = [c for c in df.columns if c not in ("_v",)]
    return df.filter(F.schema_of_variant("_v").startswith("OBJECT")).select(*keep, F.to_json("_v").alias("_raw"), "_v")


def flatten(df: DataFrame) -> DataFrame:
    """(_pos, path, value): every leaf of every record under its dotted path, arrays as a.0, whatever their depth.

    Depth is not known to a plan, so records are walked by Arrow batches in Python; numbers keep their digits.
    """
    place = df.schema["_pos"].dataType.simpleString()

    def walk(batches):
        for batch in batches:
            row, path, value = [], [], []
            for i, raw in enumerate(batch.column("_raw").to_pylist()):
                for name, leaf in leaves(raw):
                    row.append(i)
                    path.append(name)
                    value.append(leaf)
            yield pa.RecordBatch.from_arrays([batch.column("_pos").take(pa.array(row, pa.int64())), pa.array(path, pa.string()), pa.array(value, pa.string())], names=["_pos", "path", "leaf"])

    raw = F.col("_raw") if "_raw" in df.columns else F.to_json("_v")
    return df.select("_pos", raw.alias("_raw")).mapInArrow(walk, f"_pos {place}, path string, leaf string").select("_pos", "path", F.parse_json("leaf").alias("value"))


class _Digits(str):
    """A number as it is written."""


def leaves(raw: str) -> list[tuple[str, str]]:
    """(dotted path, JSON text) of each leaf, in order; empty objects and arrays have none."""
    out, todo = [], [("", json.loads(raw, parse_int=_Digits, parse_float=_Digits))]
    while todo:
        path, x = todo.pop()
        if isinstance(x, (dict, list)):
            pairs = list(x.items() if isinstance(x, dict) else ((str(i), y) for i, y in enumerate(x)))
            todo += [(f"{path}.{k}" if path else k, y) for k, y in reversed(pairs)]
        else:
            out.append((path, str(x) if isinstance(x, _Digits) else json.dumps(x, ensure_ascii=False)))
    return out


def glob_regex(pattern: str) -> str:
    """`*` is one segment of a path, `**` all that is left."""
    out = ""
    for part in pattern.split("."):
        if part == "**":
            return rf"(?s)^{out}.*$" if not out else rf"(?s)^{out}\..+$"
        one = "[^.]*" if part == "*" else re.escape(part)
        out += rf"\.{one}" if out else one
    return f"^{out}$"
