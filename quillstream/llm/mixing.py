"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong
to). A small flow network routes each pattern's token capacity to source quotas;
the k-th repetition of a pattern costs k*k, a convex price, so fresh tokens are
spent before repeats. The flow then fixes for each pattern how many whole copies
all of its documents get and how many tokens a seeded subset adds.

Nulls: a null source is a source of its own, sorted last; a null text has size 0.
Repeated rows are separate documents. An empty table gives an empty mix.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import Scratch

#: Buckets of the seeded order per pattern: the one the quota ends in is cut document by document.
SEED_BUCKETS = 4096
#: Plans of up to this many patterns (a few hundred bytes each) are broadcast.
BROADCAST_PATTERNS = 10_000


def word_count(text: Column) -> Column:
    """Number of maximal runs outside {0x20, 0x09-0x0D}; null counts 0."""
    body = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, r"[\x20\x09-\x0D]+"))).cast("long")


def water_fill(total: float, weights: Sequence[float], caps: Sequence[float]) -> list[float]:
    """Shares of total by weight, none above its cap; what a cap cuts off is shared again by weight."""
    share = [0.0] * len(weights)
    open_ = [i for i, w in enumerate(weights) if w > 0]
    left = float(total)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > caps[i]]
        if not full:
            for i in open_:
                share[i] = unit * weights[i]
            break
        for i in full:
            share[i] = float(caps[i])
            left -= caps[i]
        open_ = [i for i in open_ if i not in set(full)]
    return share


def min_cost_flow(supply: Sequence[float], quota: Sequence[float], edges: Sequence[tuple[int, int]], epochs: int) -> dict[tuple[int, int], float]:
    """Tokens routed from patterns to sources: the most that fits, at least repetition cost.

    supply[p] is one pass over pattern p, available `epochs` times at cost 0, 1, 4, 9, ...;
    quota[s] is what source s wants. Successive shortest paths over the residual network.
    """
    n_p, n_s = len(supply), len(quota)
    source, sink = n_p + n_s, n_p + n_s + 1
    head: list[list[int]] = [[] for _ in range(n_p + n_s + 2)]
    to: list[int] = []
    cap: list[float] = []
    cost: list[float] = []

    def arc(a: int, b: int, c: float, w: float) -> None:
        for x, y, cc, ww in ((a, b, c, w), (b, a, 0.0, -w)):
            head[x].append(len(to))
            to.append(y)
            cap.append(cc)
            cost.append(ww)

    for p, size in enumerate(supply):
        for k in range(epochs):
            arc(source, p, float(size), float(k * k))
    routed = {}
    for p, s in edges:
        routed[(p, s)] = len(to)
        arc(p, n_p + s, math.inf, 0.0)
    for s, want in enumerate(quota):
        arc(n_p + s, sink, float(want), 0.0)
    tiny = 1e-9 * (1.0 + sum(supply))
    while True:
        dist = [math.inf] * len(head)
        via = [-1] * len(head)
        dist[source] = 0.0
        queue, queued = deque([source]), {source}
        while queue:
            x = queue.popleft()
            queued.discard(x)
            for e in head[x]:
                if cap[e] > tiny and dist[x] + cost[e] < dist[to[e]] - 1e-12:
                    dist[to[e]] = dist[x] + cost[e]
                    via[to[e]] = e
                    if to[e] not in queued:
                        queued.add(to[e])
                        queue.append(to[e])
        if via[sink] < 0:
            break
        push, x = math.inf, sink
        while x != source:
            push = min(push, cap[via[x]])
            x = to[via[x] ^ 1]
        x = sink
        while x != source:
            cap[via[x]] -= push
            cap[via[x] ^ 1] += push
            x = to[via[x] ^ 1]
    return {k: cap[e ^ 1] for k, e in routed.items()}


def mix_plan(patterns: list[tuple[tuple, int]], weights: Sequence[float], share: float, epochs: int) -> tuple[list, list[float], list[int], list[float]]:
    """(sources in order, their targets, their sizes, tokens for each pattern)."""
    order = lambda s: (s is None, s or "")
    sources = sorted({s for members, _ in patterns for s in members}, key=order)
    at = {s: i for i, s in enumerate(sources)}
    size = [0] * len(sources)
    for members, n in patterns:
        for s in members:
            size[at[s]] += n
    total = share * sum(n for _, n in patterns)
    targets = water_fill(total, [weights[i % len(weights)] for i in range(len(sources))], [epochs * n for n in size])
    flow = min_cost_flow([n for _, n in patterns], targets, [(p, at[s]) for p, (members, _) in enumerate(patterns) for s in members], epochs)
    tokens = [0.0] * len(patterns)
    for (p, _), f in flow.items():
        tokens[p] += f
    return sources, targets, size, tokens


def mix(
    spark: SparkSession,
    docs: DataFrame,
    members: Column,
    size: Column,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    epochs: int = 2,
    seed: int = 8,
    key: Sequence[str] = ("doc_id",),
    scratch: Scratch | None = None,
    from_sizes: bool = False,
) -> DataFrame:
    """docs with `members`, `size`, its first source's `source_size` and `target`, and `copies` (0 to epochs).

    members: array of the sources a document belongs to (non-empty; may hold null).
    key: columns that name a document; rows equal in key and size share one decision.
    Sizes are written to the shared folder and planned on; the decision of all but
    the documents of one seeded bucket a pattern is a function of the row, so texts
    are never shuffled. from_sizes: return only the key's columns, from the sizes.
    The tokens taken from each pattern come within one document of the flow.
    """
    scratch = scratch or Scratch(spark, "mix")
    frame = docs.withColumns({"__m": F.array_sort(members), "__n": size.cast("long")})
    frame = frame.withColumn("__h", F.xxhash64(F.lit(seed), *[F.col(c) for c in key], F.col("__n")))
    frame = frame.withColumn("__b", F.pmod("__h", F.lit(SEED_BUCKETS)).cast("int"))
    base = scratch.save("sizes", frame.select(*key, "__m", "__n", "__h", "__b"))
    if from_sizes:
        frame = base
    bucket = scratch.save("buckets", base.groupBy("__m", "__b").agg(F.sum("__n").alias("n")))
    rows = bucket.groupBy("__m").agg(F.sum("n").alias("n")).collect()
    rows.sort(key=lambda r: tuple((s is None, s or "") for s in r["__m"]))
    sources, targets, sizes, tokens = mix_plan([(tuple(r["__m"]), int(r["n"])) for r in rows], weights, share, epochs)
    at = {s: i for i, s in enumerate(sources)}
    plan = []
    for r, t in zip(rows, tokens, strict=True):
        n, lead = int(r["n"]), min(at[s] for s in r["__m"])
        whole = min(epochs, int((t + 1e-6) // n)) if n else 0
        plan.append((list(r["__m"]), sizes[lead], targets[lead], whole, max(0.0, t - whole * n) if whole < epochs else 0.0))
    schema = pa.schema([("__m", pa.list_(pa.string())), ("source_size", pa.int64()), ("target", pa.float64()), ("__whole", pa.int32()), ("__rest", pa.float64())])
    plan_df = spark.createDataFrame(pa.table([list(c) for c in zip(*plan, strict=True)] if plan else [[]] * 5, schema=schema))
    hint = F.broadcast if len(plan) <= BROADCAST_PATTERNS else (lambda d: d)
    # the bucket of the seeded order in which each pattern's remainder ends
    w = Window.partitionBy("__m").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    edge = bucket.withColumn("__before", F.coalesce(F.sum("n").over(w), F.lit(0))).join(hint(plan_df.select("__m", "__rest")), "__m")
    edge = edge.filter((F.col("__before") <= F.col("__rest")) & (F.col("__rest") < F.col("__before") + F.col("n"))).select("__m", F.col("__b").alias("__edge"), "__before", "__rest")
    edge = scratch.save("edge", edge)
    # in that bucket alone documents are ordered one by one
    units = base.join(hint(edge), "__m").filter("__b = __edge").groupBy("__m", "__h", "__before", "__rest").agg(F.sum("__n").alias("__u"))
    order = Window.partitionBy("__m").orderBy("__h").rowsBetween(Window.unboundedPreceding, -1)
    run = F.col("__before") + F.coalesce(F.sum("__u").over(order), F.lit(0))
    cut = scratch.save("cut", units.select("__m", "__h", (run + F.col("__u") / 2 <= F.col("__rest")).alias("__cut")))
    full = frame.join(hint(plan_df), "__m").join(hint(edge.select("__m", "__edge")), "__m", "left")
    on_edge = F.coalesce(F.col("__b") == F.col("__edge"), F.lit(False))
    inside = F.when(F.col("__edge").isNull(), F.col("__rest") > 0).otherwise(F.col("__b") < F.col("__edge"))
    sure = full.filter(~on_edge).withColumn("__extra", inside)
    split = full.filter(on_edge).join(cut, ["__m", "__h"]).withColumn("__extra", F.col("__cut")).drop("__cut")
    out = sure.unionByName(split)
    return out.withColumns({"members": F.col("__m"), "size": F.col("__n"), "copies": F.col("__whole") + F.col("__extra").cast("int")}).drop(
        "__m", "__n", "__h", "__b", "__whole", "__rest", "__edge", "__extra"
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tables import table

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    out = mix(spark, docs, F.array("source"), word_count(F.col("text")), from_sizes=True)
    return out.select("doc_id", "size", F.col("source_size").cast("long"), "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), F.col("members")[0].alias("source"))
