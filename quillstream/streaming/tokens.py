"""Token streams of language models: fragments in, complete JSON objects out.

Fragments of one stream are order-sensitive, so they are folded one stream at a time
(in parallel over streams): in batch by applyInArrow over position order, in
Structured Streaming by a buffer kept as state.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import Value, tag

#: API presets: path of the fragment in an envelope, and whether envelopes come as server-sent events.
PRESETS = {"ollama": ("$.response", False), "openai": ("$.choices[0].delta.content", True), "anthropic": ("$.delta.text", True)}


def strip_events(lines: DataFrame) -> DataFrame:
    """Server-sent event lines to their data; comments, blanks and [DONE] go."""
    data = F.regexp_replace("value", r"^data: ?", "")
    keep = (F.trim("value") != "") & ~F.col("value").startswith(":") & (F.trim(data) != "[DONE]")
    return lines.filter(keep).withColumn("value", data)


def fragments(lines: DataFrame, path: str, events: bool = False) -> DataFrame:
    """The lines' other columns and the string fragment at a path of each envelope."""
    if events:
        lines = strip_events(lines)
    keep = [c for c in lines.columns if c != "value"]
    return lines.select(*keep, F.try_variant_get(F.try_parse_json("value"), path, "string").alias("fragment")).filter("fragment is not null")


_MARKS = re.compile(r'[{}"\\]')


class Cutter:
    """Cuts complete `{...}` objects out of pieces of text as they come; text before an object is dropped."""

    def __init__(self):
        self.rest, self.at, self.start, self.depth, self.quoted = "", 0, -1, 0, False

    def feed(self, piece: str) -> list[str]:
        out, text, i = [], self.rest + piece, self.at
        while m := _MARKS.search(text, i):
            c, i = m.group(), m.end()
            if self.start < 0:
                if c == "{":
                    self.start, self.depth, self.quoted = i - 1, 1, False
            elif c == "\\":
                if self.quoted:
                    i += 1  # may lie beyond this piece
            elif c == '"':
                self.quoted = not self.quoted
            elif not self.quoted:
                self.depth += 1 if c == "{" else -1
                if self.depth == 0:
                    out.append(text[self.start : i])
                    self.start = -1
        keep = self.start if self.start >= 0 else len(text)
        self.rest, self.at, self.start = text[keep:], max(i, len(text)) - keep, 0 if self.start >= 0 else -1
        return out


def cut_objects(buffer: str) -> tuple[list[str], str]:
    """Complete objects of a buffer, and what is left of an unfinished one."""
    cutter = Cutter()
    return cutter.feed(buffer), cutter.rest


def accumulate(frame: DataFrame, stream: str, order: str) -> DataFrame:
    """(stream, n, _raw): the objects of each stream's fragments, in order; an unfinished one is dropped (see truncated)."""
    kind = dict(frame.dtypes)[stream]

    def fold(key: tuple, table: pa.Table) -> pa.Table:
        cutter = Cutter()
        found = [f for piece in _ordered(table, order) for f in cutter.feed(piece) if _is_object(f)]
        return _keyed(table, stream, key, {"n": pa.array(range(len(found)), pa.int64()), "_raw": pa.array(found, pa.string())})

    return frame.select(stream, order, "fragment").groupBy(stream).applyInArrow(fold, f"{stream} {kind}, n long, _raw string")


def _ordered(table: pa.Table, order: str) -> list[str]:
    return table.sort_by(order).column("fragment").to_pylist()


def _keyed(table: pa.Table, stream: str, key: tuple, columns: dict[str, pa.Array]) -> pa.Table:
    """Columns of one stream's rows, with its name."""
    n = len(next(iter(columns.values())))
    return pa.table({stream: pa.array([key[0].as_py()] * n, table.schema.field(stream).type), **columns})


def truncated(frame: DataFrame, stream: str, order: str) -> DataFrame:
    """(stream, bytes): streams that end within an object, and the bytes of it that were dropped."""
    kind = dict(frame.dtypes)[stream]

    def fold(key: tuple, table: pa.Table) -> pa.Table:
        cutter = Cutter()
        for piece in _ordered(table, order):
            cutter.feed(piece)
        left = len(cutter.rest.encode())
        return _keyed(table, stream, key, {"bytes": pa.array([left] * (left > 0), pa.int64())})

    return frame.select(stream, order, "fragment").groupBy(stream).applyInArrow(fold, f"{stream} {kind}, bytes long")


def _is_object(text: str) -> bool:
    try:
        return isinstance(json.loads(text), dict)
    except ValueError:
        return False


def accumulate_stream(frame: DataFrame, stream: str) -> DataFrame:
    """accumulate() over a streaming frame; the unfinished object of each stream is its state."""
    kind = dict(frame.dtypes)[stream]

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        buffer, n = state.get if state.exists else ("", 0)
        found: list[str] = []
        for pdf in batches:
            got, buffer = cut_objects(buffer + "".join(pdf["fragment"]))
            found += [f for f in got if _is_object(f)]
        state.update((buffer, n + len(found)))
        if found:
            yield pd.DataFrame({stream: [key[0]] * len(found), "n": range(n, n + len(found)), "_raw": found})

    return frame.groupBy(stream).applyInPandasWithState(fold, f"{stream} {kind}, n long, _raw string", "buffer string, n long", "append", "NoTimeout")


def expect(spec: str, variant: str = "_v") -> Column:
    """Whether an object has the fields of `name:type, ...` (string, number, boolean, any, enum(a,b))."""
    ok = F.lit(True)
    for name, kind in re.findall(r"([\w.]+)\s*:\s*(enum\([^)]*\)|\w+)", spec):
        v = F.try_variant_get(variant, "$" + "".join(f"['{p}']" for p in name.split(".")), "variant")
        t = tag(Value("variant", v))
        if kind.startswith("enum("):
            allowed = [x.strip() for x in kind[5:-1].split(",")]
            one = (t == "string") & F.try_variant_get(v, "$", "string").isin(allowed)
        elif kind == "any":
            one = v.isNotNull()
        else:
            one = t == {"bool": "boolean"}.get(kind, kind)
        ok = ok & F.coalesce(one, F.lit(False))
    return ok


def objects(df: DataFrame) -> DataFrame:
    """Accumulated objects as records: (_raw, _v, _pos)."""
    return df.select("_raw", F.try_parse_json("_raw").alias("_v"), F.col("n").alias("_pos"))


#: What a running aggregate keeps for rows before, and how two of them are joined.
_RUNNING = {"count": ("count", lambda a, b: a + b), "sum": ("sum", lambda a, b: F.coalesce(a + b, a, b)), "min": ("min", F.least), "max": ("max", F.greatest)}


def rolling(df: DataFrame, order: str, aggregates: dict[str, tuple[str, str | None]], by: list[str] | None = None) -> DataFrame:
    """Running (function, column) aggregates (count, sum, min, max) after each row: over each key's rows, or over all.

    Over all rows no task sees them all: rows are dealt by ranges of the order column (a
    number or a time), each range is aggregated by itself and gets the totals of those before.
    """
    made = {n: getattr(F, f)(F.col(c) if c else F.lit(1)) for n, (f, c) in aggregates.items()}
    upto = lambda keys: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if by:
        return df.select(*by, order, *[c.over(upto(by)).alias(n) for n, c in made.items()])
    at = F.unix_micros(order).cast("double") if isinstance(df.schema[order].dataType, T.TimestampType) else F.col(order).cast("double")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = df.select(at.alias("at")).approxQuantile("at", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    place = F.size(F.filter(F.array(*[F.lit(e) for e in sorted(set(edges))]), lambda e: e < at)) if edges else F.lit(0)
    df = df.withColumn("__range", place)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    totals = df.groupBy("__range").agg(*[c.alias(n) for n, c in made.items()])
    totals = totals.select("__range", *[getattr(F, {"count": "sum"}.get(f, f))(n).over(before).alias(f"__{n}") for n, (f, _) in aggregates.items()])
    run = df.select("__range", order, *[c.over(upto(["__range"])).alias(n) for n, c in made.items()]).join(F.broadcast(totals), "__range")  # as many rows as shuffle partitions
    joined = {n: _RUNNING[f][1](F.coalesce(F.col(f"__{n}"), F.lit(0)) if f == "count" else F.col(f"__{n}"), F.col(n)) for n, (f, _) in aggregates.items()}
    return run.select(order, *[c.alias(n) for n, c in joined.items()])


def rolling_tables(df: DataFrame, order: str, by: str, aggregates: dict[str, tuple[str, str | None]]) -> DataFrame:
    """(at, by, aggregates): the table of all groups so far after each row, `at` being the row's number from 1."""
    places = rolling(df, order, {"at": ("count", None)})
    rows = rolling(df, order, aggregates, [by]).join(places, order)
    until = F.coalesce(F.lead("at").over(Window.partitionBy(by).orderBy(order)) - 1, F.lit(df.count()))
    return rows.withColumn("__until", until).select(F.explode(F.sequence("at", "__until")).alias("at"), by, *aggregates)
