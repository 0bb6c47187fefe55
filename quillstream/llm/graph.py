"""Connected components of an edge table, without moving it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(node, component): the least node that edges (a, b) of longs reach, by large-star and small-star steps.

    Every round is two aggregations with map-side combining and two joins whose hot
    hubs AQE may split; its result is written to the shared folder. Rounds grow with
    the logarithm of the longest chain.
    """
    now = scratch.save(f"{label}-0", edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
    step = 0
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("m").alias("b"))).filter("a > b").distinct()
        step += 1
        nxt = scratch.save(f"{label}-{step}", small)
        now_mark = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if step > 1:
            scratch.drop(f"{label}-{step - 2}")
        now = nxt
        if now_mark == mark:
            break
        mark = now_mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
