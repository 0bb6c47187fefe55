"""The scalar functions: name -> builder of a Value. Built-in column functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import Value, finite, is_null, literal, number, numeric, string, tag, text, truth

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIRST_SECOND, LAST_SECOND = -62135596800, 253402300799  # 0001-01-01T00:00:00Z and 9999-12-31T23:59:59Z


def _num(c: Column) -> Value:
    return Value("number", c)


def _str(c: Column) -> Value:
    return Value("string", c)


def length(v: Value) -> Value:
    if v.kind == "array":
        return _num(F.when(v.col.isNotNull(), F.size(v.col)).cast("double"))
    if v.kind == "object":
        return _num(F.when(v.col.isNotNull(), F.lit(0.0)))
    if v.kind == "variant":
        n = F.size(F.try_variant_get(v.col, "$", "array<variant>")).cast("double")
        return _num(F.when(tag(v) == "array", n).when(tag(v) == "object", 0.0).otherwise(F.octet_length(string(v)).cast("double")))
    return _num(F.octet_length(string(v)).cast("double"))


def concat(*vs: Value) -> Value:
    parts = [F.coalesce(string(v), F.when(tag(v) == "number", text(v))) if v.kind == "variant" else (text(v) if v.kind in ("string", "number") else F.lit(None).cast("string")) for v in vs]
    return _str(F.concat(*parts))


#: Widest pad; a wider one gives null.
WIDEST = 1 << 24


def _place(x: Column) -> Column:
    """A number as a place in a text: at least 0, at most the largest int; null stays."""
    return F.when(x > 0, F.least(x, F.lit(float(2**31 - 2))).cast("int")).when(x.isNotNull(), F.lit(0))


def substr(s: Value, start: Value, n: Value | None = None) -> Value:
    """From a start that cannot be told: null; of a length that cannot: all the rest."""
    c, first = string(s), _place(numeric(start))
    count = F.length(c) if n is None else F.coalesce(_place(numeric(n)), F.length(c))
    return _str(F.when(first < F.length(c), F.substring(c, first + 1, count)).when(first.isNotNull() & c.isNotNull(), F.lit("")))


def pad(side):
    def build(s: Value, n: Value, ch: Value | None = None) -> Value:
        width, fill = numeric(n), F.substring(string(ch), 1, 1) if ch is not None else F.lit(" ")
        c = string(s)
        return _str(F.when(F.octet_length(c) >= width, c).when(width <= WIDEST, side(c, F.when(width <= WIDEST, width).cast("int"), fill)))

    return build


def split(s: Value, d: Value) -> Value:
    c = string(d)
    quoted = F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return Value("array", F.when(c != "", F.split(string(s), quoted, -1)), type=T.ArrayType(T.StringType()))


def round_(x: Value, d: Value | None = None) -> Value:
    n = numeric(x)
    scale = F.pow(F.lit(10.0), numeric(d)) if d is not None else F.lit(1.0)
    y = n * scale
    half = F.when(y >= 0, F.floor(y + 0.5)).otherwise(F.ceil(y - 0.5)).cast("double")
    return _num(F.when(F.abs(y) < 9e15, half / scale).otherwise(n))


def whole(f):
    return lambda x: _num(F.when(F.abs(numeric(x)) < 9e18, f(numeric(x)).cast("double")).otherwise(numeric(x)))


def to_number(x: Value) -> Value:
    if x.kind in ("boolean", "variant"):
        flag = truth(x)
        return _num(F.coalesce(F.when(flag, 1.0).when(~flag, 0.0), numeric(x)))
    return _num(numeric(x))


def type_of(x: Value) -> Value:
    return _str(F.coalesce(tag(x), F.lit("null")))


def unify(vs: list[Value]) -> list[Value]:
    """Values of one kind: a common static kind, or all as text."""
    kinds = {v.kind for v in vs} - {"null"}
    if len(kinds) <= 1:
        kind = next(iter(kinds), "null")
        return [v if v.kind == kind else Value(kind, F.lit(None)) for v in vs]
    if kinds <= {"number", "variant"}:
        return [_num(numeric(v)) for v in vs]
    return [_str(text(v)) for v in vs]


def coalesce(*vs: Value) -> Value:
    vs = unify(list(vs))
    cols = [F.when(~is_null(v), v.col) if v.kind == "variant" else v.col for v in vs]
    return Value(vs[0].kind, F.coalesce(*cols))


def if_has(f: Value, then: Value, other: Value | None = None) -> Value:
    a, b = unify([then, other if other is not None else literal(None)])
    return Value(a.kind, F.when(f.there, a.col).otherwise(b.col))


# -- dates: UTC, whole seconds; the calendar is not checked, a zone or fraction is ignored


def seconds(v: Value) -> Column:
    if v.time is None:
        return _seconds(string(v))
    # a time without a zone is UTC
    at = v.time if isinstance(v.type, T.TimestampType) else F.convert_timezone(F.lit("UTC"), F.current_timezone(), v.time).cast("timestamp")
    return F.unix_seconds(at)


def _seconds(s: Column) -> Column:
    """Seconds of a text; one expression over the places of its fields, without regular expressions per field."""
    part = lambda at, n: F.substring(s, at, n).try_cast("int")
    y, m, d = part(1, 4), part(6, 2), part(9, 2)
    ok = s.rlike(r"^\d{4}-\d{2}-\d{2}") & m.between(1, 12) & d.between(1, 31)
    days = F.unix_date(F.make_date(F.when(ok, y), F.when(ok, m), F.lit(1))) + d - 1
    clock = F.when(s.rlike(r"^.{10}[T ]\d{2}:\d{2}:\d{2}"), part(12, 2) * 3600 + part(15, 2) * 60 + part(18, 2))
    return F.when(ok, days.cast("bigint") * 86400 + F.coalesce(clock, F.lit(0)))


def epoch(v: Value) -> Column:
    if v.time is not None:
        return seconds(v)
    return F.coalesce(F.floor(number(v).cast("double")).cast("bigint") if v.kind in ("number", "variant") else F.lit(None).cast("bigint"), seconds(v))


def from_seconds(n: Column) -> Value:
    ok = (n >= 0) & (n <= LAST_SECOND)
    return _str(F.when(ok, F.date_format(F.timestamp_seconds(F.when(ok, n)), "yyyy-MM-dd'T'HH:mm:ss'Z'")))


def date_part(ts: Value, part: Value) -> Value:
    n, name = epoch(ts), string(part)
    t = F.timestamp_seconds(F.when(n.between(FIRST_SECOND, LAST_SECOND), n)) if ts.time is None else ts.time
    out = F.when(name == "year", F.year(t)).when(name == "month", F.month(t)).when(name == "day", F.dayofmonth(t)).when(name == "hour", F.hour(t))
    return _num(out.when(name == "minute", F.minute(t)).when(name == "second", F.second(t)).when(name == "epoch", epoch(ts)).cast("double"))


def spans(n_seconds: int):
    return lambda n: _num(numeric(n) * n_seconds)


_NOW = lambda: F.current_timestamp()

FUNCTIONS = {
    "upper": lambda s: _str(F.translate(string(s), LOWER, UPPER)),
    "lower": lambda s: _str(F.translate(string(s), UPPER, LOWER)),
    "len": length,
    "trim": lambda s: _str(F.trim(string(s), F.lit(" \t\n\r"))),
    "concat": concat,
    "substr": substr,
    "replace": lambda s, a, b: _str(F.replace(string(s), string(a), string(b))),
    "lpad": pad(lambda c, n, f: F.lpad(c, n, f)),
    "rpad": pad(lambda c, n, f: F.rpad(c, n, f)),
    "split": split,
    "to_str": lambda x: _str(text(x)),
    "round": round_,
    "floor": whole(F.floor),
    "ceil": whole(F.ceil),
    "abs": lambda x: _num(F.abs(numeric(x))),
    "to_number": to_number,
    "type": type_of,
    "coalesce": coalesce,
    "isnull": coalesce,
    "ifhas": if_has,
    "now": lambda: _str(F.date_format(_NOW(), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
    "now_epoch": lambda: _num(F.unix_timestamp(_NOW()).cast("double")),
    "now_ms": lambda: _num(F.unix_millis(_NOW()).cast("double")),
    "from_epoch": lambda n: from_seconds(epoch(n)),
    "from_epoch_ms": lambda n: from_seconds(F.coalesce(F.floor(numeric(n) / 1000).cast("bigint"), seconds(n))),
    "to_epoch": lambda x: _num(epoch(x).cast("double")),
    "to_epoch_ms": lambda x: _num(F.coalesce(F.floor(number(x).cast("double")), (seconds(x) * 1000).cast("double"))),
    "date_part": date_part,
    "epoch_min": spans(60),
    "epoch_hour": spans(3600),
    "epoch_day": spans(86400),
    "epoch_week": spans(604800),
}


def arithmetic(op: str, a: Value, b: Value) -> Value:
    x, y = numeric(a), numeric(b)
    if op == "/":
        return _num(finite(F.when(y != 0, F.try_divide(x, y))))
    if op == "%":
        return _num(F.when(y != 0, F.try_mod(x, y)))
    return _num(finite({"+": x + y, "-": x - y, "*": x * y}[op]))


def template(body: str, lookup) -> Value:
    """`format("…{f}…")`: fields in braces; missing, null and nested ones are empty, an unmatched brace stays."""
    parts = []
    for piece in re.split(r"(\{[^{}]*\})", body):
        if re.fullmatch(r"\{[^{}]+\}", piece):
            parts.append(F.coalesce(text(lookup(piece[1:-1])), F.lit("")))
        elif piece:
            parts.append(F.lit(piece))
    return _str(F.concat(*parts) if parts else F.lit(""))
