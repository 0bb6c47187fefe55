"""Delimited and plain text sources."""

from __future__ import annotations

import re
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import NUMERIC

_PLACE = ("__file", "__block")
_STARTS = pa.schema([("__file", pa.string()), ("__block", pa.int64()), ("__first", pa.int64()), ("__end", pa.int64()), ("__before", pa.int64())])


def located(df: DataFrame) -> DataFrame:
    """The rows of a file source, with the file and the block of it that each is read from."""
    at = df.metadataColumn("_metadata")
    return df.select("*", at["file_path"].alias("__file"), at["file_block_start"].alias("__block"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, _n) of the lines that are not blank."""
    lines = located(spark.read.text(path)).select(F.regexp_replace("value", r"\r$", "").alias("line"), *_PLACE)
    return numbered(lines.filter(F.trim("line") != ""))


def numbered(df: DataFrame) -> DataFrame:
    """Adds _n to located rows, from 1 in input order: by the files' names, then by the place in the file.

    Spark packs the largest blocks first into partitions, so these do not follow the files. The rows of each
    block are counted first, and no row moves. Where Spark then packs the blocks in another way than it did for
    the count, as after a change of the cluster's cores, an error is raised.
    """
    at = df.withColumn("__i", F.monotonically_increasing_id())
    blocks = at.groupBy(*_PLACE).agg(F.min("__i").alias("first"), F.count("*").alias("rows")).collect()  # a few numbers a block
    starts, before = [], 0
    for b in sorted(blocks, key=lambda b: (_natural(b["__file"]), b["__block"])):
        starts.append((b["__file"], b["__block"], b["first"], b["first"] + b["rows"], before))
        before += b["rows"]
    table = pa.Table.from_pylist([dict(zip(_STARTS.names, s, strict=True)) for s in starts], schema=_STARTS)
    at = at.join(F.broadcast(df.sparkSession.createDataFrame(table)), list(_PLACE), "left")
    counted = (F.col("__i") >= F.col("__first")) & (F.col("__i") < F.col("__end"))
    n = F.when(counted, F.col("__before") + F.col("__i") - F.col("__first") + 1).otherwise(F.raise_error(F.lit("blocks were packed anew after their rows were counted")))
    return at.select(*[F.col(f"`{c}`") for c in df.columns if c not in _PLACE], n.alias("_n"))


def _natural(path: str) -> list:
    """Orders file names with the numbers in them as numbers: part-99999 comes before part-100000."""
    return [int(x) if i % 2 else x for i, x in enumerate(re.split(r"([0-9]+)", unquote(path)))]


def read_delimited(spark: SparkSession, path: str, delimiter: str = ",", header: bool = False, columns: list[str] | None = None, numbers: bool = True) -> DataFrame:
    """RFC 4180 records and their number (_n); names f1.. unless given. Cells that are numbers become numbers.

    A column of numbers alone becomes double, one of numbers and other text a variant of
    both. An empty unquoted cell is null, an empty quoted one the empty string; quoted
    numbers cannot be told from others.
    """
    df = spark.read.csv(path, sep=delimiter, header=header, multiLine=True, escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, inferSchema=False, emptyValue="")
    names = columns or (df.columns if header else [f"f{i + 1}" for i in range(len(df.columns))])
    cells = [f"c{i}" for i in range(len(df.columns))]
    df = located(df).toDF(*cells, *_PLACE)
    typed = [F.col(c) for c in cells]
    if numbers:
        is_number = lambda c: c.rlike(NUMERIC)
        row = df.agg(*[f(is_number(F.col(c))).alias(f"{k}_{c}") for c in cells for k, f in (("all", F.bool_and), ("any", F.bool_or))]).first()

        def value(c: str):
            text = F.col(c)
            if row[f"all_{c}"]:
                return text.try_cast("double")
            return F.when(is_number(text), text.try_cast("double").cast("variant")).otherwise(text.cast("variant")) if row[f"any_{c}"] else text

        typed = [value(c) for c in cells]
    return numbered(df).select(*[c.alias(n) for c, n in zip(typed, names, strict=True)], "_n")
