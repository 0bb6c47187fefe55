"""Queries over streams of NDJSON files."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession

from ..plans.engine import Plan, parse, variables
from ..sources.json import records
from ..sources.sinks import to_ndjson


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """Valid records of the NDJSON files that arrive in a folder."""
    return records(spark.readStream.text(path)).filter("_valid").drop("_valid")


def stream_query(df: DataFrame, text: str, **args) -> tuple[DataFrame, str]:
    """(streaming result, output mode): append for rows, complete for groups and totals."""
    q = parse(text, variables(args))
    plan = Plan(df, q)
    grouped = bool(q.group) or any(getattr(getattr(i, "expr", None), "name", "") in ("count", "sum", "avg", "min", "max", "variance", "stddev") for i in q.items)
    if q.into is not None:
        raise ValueError("a stream's output path is given to start()")
    if q.order and not grouped:
        raise ValueError("order by needs group by on a stream")
    return plan.frame(), "complete" if grouped else "append"


def start(df: DataFrame, mode: str, path: str, checkpoint: str, limit: int | None = None):
    """Write a streaming result as NDJSON, one folder a batch in complete mode; run to the end of the available input.

    With a limit the query stops as soon as that many rows are written.
    """
    left = [limit]
    running: list = []

    def write(batch: DataFrame, n: int) -> None:
        if left[0] is not None:
            if left[0] <= 0:
                return
            batch = batch.limit(left[0])
        to_ndjson(batch).write.mode("overwrite").text(f"{path}/batch={n}")
        if left[0] is not None:
            left[0] -= batch.sparkSession.read.text(f"{path}/batch={n}").count()
            if left[0] <= 0 and running:
                threading.Thread(target=running[0].stop).start()  # not from within the batch

    running.append(df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    return running[0]
