"""Reading the corpus tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import chunks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (as long) and the text, whatever else the table holds."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def keep_rows(docs: DataFrame, keep: Callable[[pa.Array], np.ndarray], text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns whatever their names, whose texts keep() marks True."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    names[at] = "text"

    def run(batches):
        for batch in chunks(batches):
            yield batch.filter(pa.array(keep(batch.column(at)), pa.bool_()))

    fields = T.StructType([T.StructField(n, f.dataType, f.nullable) for n, f in zip(names, docs.schema.fields, strict=True)])
    return docs.toDF(*names).mapInArrow(run, fields).toDF(*docs.columns)
