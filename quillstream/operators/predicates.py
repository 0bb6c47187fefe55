"""Two-valued predicates as columns.

Every leaf is true or false, never unknown: a comparison with a missing field, or of
different kinds, is false. A filter already drops unknown rows, so positive leaves
stay bare and can be pushed into the scan; under NOT each is made false explicitly.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import Value, is_null, number, string, tag, truth
from ..plans.syntax import Bool, Leaf


def regex(pattern: str) -> str:
    """The dialect's regular expressions in Java's: no groups or counts, `|` at the top, anchors at branch ends."""
    branches, now, i, inside = [], "", 0, False
    while i < len(pattern):
        c = pattern[i]
        if inside:
            inside = c != "]"
            now += {"\\": r"\\", "[": r"\[", "&": r"\&"}.get(c, c)
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            now += {"s": r"[ \t\r\n]", "S": r"[^ \t\r\n]"}.get(pattern[i], "\\" + pattern[i])
        elif c == "[":
            inside = True
            now += c
            if pattern[i + 1 : i + 2] == "^":
                i += 1
                now += "^"
        elif c in "(){}":
            now += "\\" + c
        elif c == "|":
            branches.append(now)
            now = ""
        else:
            now += c
        i += 1
    branches.append(now)
    closed = [b[:-1] + r"\z" if b.endswith("$") and not b.endswith(r"\$") else b for b in branches]
    return "(?s)" + "|".join(f"(?:{b})" for b in closed)


def same(v: Value, wanted: object) -> Column:
    if wanted is None:
        return is_null(v) & v.there if v.kind != "variant" else F.is_variant_null(v.col)
    if isinstance(wanted, bool):
        return truth(v) == F.lit(wanted)
    if isinstance(wanted, (int, float)):
        return number(v) == F.lit(wanted)
    if v.time is not None:
        return _same_second(v, str(wanted))
    return string(v) == F.lit(wanted)


def _same_second(v: Value, wanted: str) -> Column:
    """A timestamp whose text is `wanted`, as a range that a scan can prune by."""
    try:
        at = datetime.strptime(wanted, "%Y-%m-%dT%H:%M:%SZ")
        after = at + timedelta(seconds=1)
    except (ValueError, OverflowError):
        return string(v) == F.lit(wanted)
    if at.strftime("%Y-%m-%dT%H:%M:%SZ") != wanted:  # fewer digits than the text of a time has
        return string(v) == F.lit(wanted)
    read = F.to_timestamp if isinstance(v.type, T.TimestampType) else F.to_timestamp_ntz
    first, after = (read(F.lit(t.strftime("%Y-%m-%d %H:%M:%S"))) for t in (at, after))
    return (v.time >= first) & (v.time < after)


def _contains(v: Value, wanted: object) -> Column:
    wanted = str(wanted)
    if v.kind == "array":
        # only texts are members; other elements never match
        return F.array_contains(v.col, wanted) if v.type is not None and isinstance(v.type.elementType, T.StringType) else F.when(v.col.isNotNull(), F.lit(False))
    text = string(v).contains(wanted)
    if v.kind != "variant":
        return text
    items = F.try_variant_get(v.col, "$", "array<variant>")
    listed = F.exists(items, lambda x: F.coalesce((F.schema_of_variant(x) == "STRING") & (F.try_variant_get(x, "$", "string") == wanted), F.lit(False)))
    return F.when(tag(v) == "array", listed).otherwise(text)


def _in(v: Value, wanted: tuple) -> Column:
    words = [str(w).lower() if isinstance(w, bool) else str(w) for w in wanted if w is not None]
    numbers = []
    for w in wanted:
        try:
            numbers.append(float(w) if not isinstance(w, bool) else None)
        except (TypeError, ValueError):
            pass
    numbers = [n for n in numbers if n is not None]
    found = []
    if v.kind in ("string", "variant") and words:
        found.append(string(v).isin(words))
    if v.kind == "number" and isinstance(v.type, T.IntegralType):
        # literals of the column's own kind, so that the scan can prune by them
        numbers = [int(n) for n in numbers if abs(n) < 2**63 and n == int(n)]
    if v.kind in ("number", "variant") and numbers:
        found.append(number(v).isin(numbers))
    if v.kind in ("boolean", "variant") and words:
        found.append(truth(v).cast("string").isin(words))
    return F.coalesce(*found) if len(found) > 1 else (found[0] if found else F.lit(False))


def leaf(p: Leaf, v: Value) -> Column:
    """One comparison; may be null for false."""
    if p.op == "has":
        return ~v.there if p.negated else v.there
    if p.op == "null":
        return ~is_null(v) if p.negated else is_null(v)
    if p.op == "=":
        return same(v, p.right)
    if p.op == "!=":
        kind = "boolean" if isinstance(p.right, bool) else "number" if isinstance(p.right, (int, float)) else "string"
        if v.exists is None and v.kind == kind and p.right is not None:
            equal = same(v, p.right)
            return (~equal | v.col.isNull()) if v.time is None else (~equal | v.time.isNull())
        return v.there & ~F.coalesce(same(v, p.right), F.lit(False))
    if p.op in (">", "<", ">=", "<="):
        if isinstance(p.right, bool) or not isinstance(p.right, (int, float)):
            return F.lit(False)
        x, y = number(v), F.lit(p.right)
        return {">": x > y, "<": x < y, ">=": x >= y, "<=": x <= y}[p.op]
    if p.op == "matches":
        found = string(v).rlike(regex(str(p.right)))
        return ~found if p.negated else found
    if p.op == "contains":
        found = _contains(v, p.right)
    elif p.op == "in":
        found = _in(v, p.right)
    else:
        s, w = string(v), str(p.right)
        found = {"like": lambda: s.like(w.replace("\\", "\\\\")), "starts_with": lambda: s.startswith(w), "ends_with": lambda: s.endswith(w)}[p.op]()
    return v.there & ~F.coalesce(found, F.lit(False)) if p.negated else found


def tree(p, value, under_not: bool = False) -> Column:
    """The column of a predicate tree; value(expression) binds the left sides."""
    if isinstance(p, Leaf):
        out = leaf(p, value(p.left))
        return F.coalesce(out, F.lit(False)) if under_not else out
    parts = [tree(x, value, under_not or p.op == "not") for x in p.items]
    if p.op == "not":
        return ~parts[0]
    out = parts[0]
    for x in parts[1:]:
        out = (out & x) if p.op == "and" else (out | x)
    return out


def two_valued(p, value) -> Column:
    """Never null: for CASE, rejects and the like."""
    return F.coalesce(tree(p, value, under_not=True), F.lit(False))


__all__ = ["Bool", "leaf", "regex", "same", "tree", "two_valued"]
