"""Binding of parsed queries to DataFrame plans.

Typed mode binds to the columns of a DataFrame; dynamic mode to the variant column
`_v` that the JSON sources make, beside `_raw` and `_pos`. Everything after parsing
is column expressions, so batch and streaming frames take the same path.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, is_dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.registry import FUNCTIONS, arithmetic, template, unify
from ..functions.values import Value, column_value, is_null, literal, number_text, numeric, schema, tag
from ..operators import predicates
from .syntax import AGGREGATES, Binary, Call, Case, Expand, Item, Leaf, Lit, Path, Query, Star, parse, split_queries


class BindError(ValueError):
    """A query that does not fit its input."""


def _json_path(parts: tuple[str, ...]) -> str:
    return "$" + "".join(f"[{p}]" if p.isdigit() else "['" + p.replace("'", "\\'") + "']" for p in parts)


#: What the names of hoisted paths begin with.
_HOISTED = "__path"


def _paths(e) -> set[tuple[str, ...]]:
    """Every path that an expression, item or query reads."""
    if isinstance(e, Path):
        return {e.parts}
    if isinstance(e, (list, tuple)):
        return set().union(*map(_paths, e)) if e else set()
    if is_dataclass(e):
        return set().union(*(_paths(getattr(e, f.name)) for f in fields(e)))
    return set()


@dataclass
class Scope:
    """Names that expressions see: a schema, or a variant, and the query's aliases."""

    schema: T.StructType
    aliases: dict
    hoisted: dict = field(default_factory=dict)  # paths of a variant that are columns already

    @property
    def dynamic(self) -> bool:
        return "_v" in self.schema.fieldNames() and "_raw" in self.schema.fieldNames()

    def fields(self) -> list[str]:
        return [f for f in self.schema.fieldNames() if f not in ("_pos", "_raw", "_v") and not f.startswith(_HOISTED)]

    def path(self, parts: tuple[str, ...]) -> Value:
        if self.dynamic and parts[0] not in self.fields():
            if parts in self.hoisted:
                name = self.hoisted[parts]
                return Value("variant", F.col(name), F.col(name).isNotNull(), field=True, schema=F.col(f"{name}s"))
            col = F.try_variant_get(F.col("_v"), _json_path(parts), "variant")
            return Value("variant", col, col.isNotNull(), field=True)
        col, kind = None, self.schema
        for p in parts:
            if isinstance(kind, T.StructType) and p in kind.fieldNames():
                col = F.col(f"`{p}`") if col is None else col.getField(p)
                kind = kind[p].dataType
            elif isinstance(kind, T.ArrayType) and p.isdigit():
                col, kind = F.get(col, int(p)), kind.elementType
            elif isinstance(kind, T.MapType):
                col, kind = F.try_element_at(col, F.lit(p)), kind.valueType
            else:
                return Value("null", F.lit(None), F.lit(False), field=True)
        return column_value(col, kind)

    def native(self, parts: tuple[str, ...]) -> Column | None:
        """The column itself, for output."""
        v = self.path(parts)
        if len(parts) == 1 and parts[0] in self.schema.fieldNames():
            return F.col(f"`{parts[0]}`")
        return v.col if v.kind != "null" else None

    # -- expressions
    def value(self, e) -> Value:
        if isinstance(e, Lit):
            return literal(e.value)
        if isinstance(e, Path):
            if len(e.parts) == 1 and e.parts[0] in self.aliases and self.aliases[e.parts[0]] != e:
                return replace(self, aliases={}).value(self.aliases[e.parts[0]])
            return self.path(e.parts)
        if isinstance(e, Binary):
            return arithmetic(e.op, self.value(e.left), self.value(e.right))
        if isinstance(e, Case):
            vs = unify([self.value(x) for _, x in e.whens] + [self.value(e.default) if e.default is not None else literal(None)])
            col = F.lit(None)
            for (cond, _), v in reversed(list(zip(e.whens, vs[:-1], strict=True))):
                col = F.when(predicates.two_valued(cond, self.value), v.col).otherwise(vs[-1].col if col is None or v is vs[-2] else col)
            return Value(vs[0].kind, col)
        if isinstance(e, Call):
            return self.call(e)
        raise BindError(f"cannot bind {e!r}")

    def call(self, e: Call) -> Value:
        if e.name in ("keys", "values", "to_entries"):
            return self.entries(e)
        if e.name == "format":
            return template(str(e.args[0].value), lambda f: self.path(tuple(f.split("."))))
        if e.name not in FUNCTIONS:
            raise BindError(f"unknown function {e.name}")
        try:
            return FUNCTIONS[e.name](*[self.value(a) for a in e.args])
        except TypeError:
            raise BindError(f"wrong number of arguments for {e.name}") from None

    def entries(self, e: Call) -> Value:
        if e.args:
            v = self.value(e.args[0])
            if v.kind == "variant":
                raw = F.to_json(v.col)
                return Value("array", _dynamic_entries(e.name, raw, v.col))
            if v.kind != "object":
                return Value("null", F.lit(None))
            names = F.json_object_keys(F.to_json(v.col))
            pairs = F.from_json(F.to_json(v.col), "map<string,string>")
            return Value("array", {"keys": names, "values": F.map_values(pairs), "to_entries": F.transform(names, lambda k: F.struct(k.alias("key"), F.element_at(pairs, k).alias("value")))}[e.name])
        if self.dynamic:
            return Value("array", _dynamic_entries(e.name, F.col("_raw"), F.col("_v")))
        names = self.fields()
        text = lambda n: F.to_json(F.array(self.native((n,)))).substr(F.lit(2), F.length(F.to_json(F.array(self.native((n,))))) - 2)
        if e.name == "keys":
            return Value("array", F.array(*[F.lit(n) for n in names]))
        if e.name == "values":
            return Value("array", F.array(*[text(n) for n in names]))
        return Value("array", F.array(*[F.struct(F.lit(n).alias("key"), text(n).alias("value")) for n in names]))


def _dynamic_entries(name: str, raw: Column, v: Column) -> Column:
    names = F.json_object_keys(raw)
    if name == "keys":
        return names
    pairs = F.try_variant_get(v, "$", "map<string,variant>")
    if name == "values":
        return F.transform(names, lambda k: F.element_at(pairs, k))
    return F.transform(names, lambda k: F.struct(k.alias("key"), F.element_at(pairs, k).alias("value")))


def output_name(item: Item) -> str:
    if item.alias:
        return item.alias
    if isinstance(item.expr, Path):
        return item.expr.parts[-1]
    if isinstance(item.expr, Call):
        return output_name(Item(item.expr.args[0])) if item.expr.name == "isnull" and item.expr.args else item.expr.name
    return "column"


def is_aggregate(e) -> bool:
    return isinstance(e, Call) and e.name in AGGREGATES and len(e.args) <= 1


def aggregate(e: Call, scope: Scope) -> Column:
    if e.name == "count" and not e.args:
        return F.count(F.lit(1))
    v = scope.value(e.args[0])
    if e.name == "count":
        return F.count(F.when(~is_null(v), F.lit(1)))
    x = numeric(v)
    return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "variance": F.var_pop, "stddev": F.stddev_pop}[e.name](x)


def unique_names(items: list[Item]) -> list[str]:
    """Output names of aggregates: a collision gets the argument's name, then a number."""
    out: list[str] = []
    for item in items:
        name = output_name(item)
        if name in out and not item.alias and isinstance(item.expr, Call) and item.expr.args and isinstance(item.expr.args[0], Path):
            name = f"{name}_{item.expr.args[0].parts[-1]}"
        base, n = name, 2
        while name in out and not item.alias:
            name, n = f"{base}_{n}", n + 1
        out.append(name)
    return out


def _read(query: Query) -> tuple:
    """The parts of a query that read fields."""
    return (query.items, query.where, query.group, query.having, [k for k, _ in query.order])


class Plan:
    """One query over one frame."""

    def __init__(self, df: DataFrame, query: Query):
        aliases = {i.alias: i.expr for i in query.items if isinstance(i, Item) and i.alias and not is_aggregate(i.expr)}
        scope = Scope(df.schema, aliases)
        if scope.dynamic:
            # each path is taken out of the variant once, and its kind told once
            used = sorted(p for p in _paths(_read(query)) if p[0] not in scope.fields())
            scope.hoisted = {p: f"{_HOISTED}{i}_" for i, p in enumerate(used)}
            df = df.withColumns({n: F.try_variant_get(F.col("_v"), _json_path(p), "variant") for p, n in scope.hoisted.items()})
            df = df.withColumns({f"{n}s": F.schema_of_variant(F.col(n)) for n in scope.hoisted.values()})
            scope.schema = df.schema
        self.df, self.query, self.scope = df, query, scope

    def passing(self) -> Column:
        """Whether a row passes WHERE; never null."""
        return predicates.two_valued(self.query.where, self.scope.value) if self.query.where is not None else F.lit(True)

    def frame(self) -> DataFrame:
        q, df = self.query, self.df
        if q.where is not None:
            df = df.filter(predicates.tree(q.where, self.scope.value))
        if q.group:
            return self.grouped(df)
        if any(isinstance(i, Item) and is_aggregate(i.expr) for i in q.items):
            items = [i for i in q.items if isinstance(i, Item) and is_aggregate(i.expr)]
            return df.agg(*[aggregate(i.expr, self.scope).alias(n) for i, n in zip(items, unique_names(items), strict=True)])
        return self.rows(df)

    def order_columns(self, scope: Scope, names: list[str]) -> list[tuple[Column, bool]]:
        out = []
        for key, down in self.query.order:
            if isinstance(key, int):
                if not 1 <= key <= len(names):
                    raise BindError(f"no column {key}")
                key = Path((names[key - 1],))
            v = scope.value(key)
            native = scope.native(key.parts) if v.kind != "variant" and isinstance(key, Path) and key.parts[0] not in scope.aliases else None
            out += _sort_keys(v, native if native is not None else v.col, down)
        return out

    def sort(self, df: DataFrame, columns: list[tuple[Column, bool]]) -> DataFrame:
        keys = [c.desc_nulls_last() if down else c.asc_nulls_last() for c, down in columns]
        if "_pos" in df.columns:
            keys.append(F.col("_pos"))
        return df.orderBy(*keys)

    def limited(self, df: DataFrame) -> DataFrame:
        return df.limit(self.query.limit) if self.query.limit is not None else df

    def grouped(self, df: DataFrame) -> DataFrame:
        q, keys, keep = self.query, [], []
        by_expr = {i.expr: i.alias for i in q.items if isinstance(i, Item) and i.alias}
        aliases = {i.alias: i.expr for i in q.items if isinstance(i, Item) and i.alias}
        for k, e in enumerate(q.group):
            name = None
            if isinstance(e, Path) and len(e.parts) == 1 and e.parts[0] in aliases:
                name, e = e.parts[0], aliases[e.parts[0]]
            plain = replace(self.scope, aliases={})
            default = next((i.expr for i in q.items if isinstance(i, Item) and isinstance(i.expr, Call) and i.expr.name == "isnull" and i.expr.args[0] == e), None)
            v = plain.value(default if default is not None else e)
            name = name or by_expr.get(e) or (".".join(e.parts) if isinstance(e, Path) else e.name if isinstance(e, Call) else f"__gb_{k}")
            if v.exists is not None:
                keep.append(v.there)
            native = plain.native(e.parts) if isinstance(e, Path) and default is None else None
            if v.kind == "variant":
                # texts (after s) and whole numbers (after j) stand for themselves; other numbers are written
                # alike (1.0 as 1) if a double holds all their digits; the rest is JSON
                digits = F.length(F.regexp_replace(F.to_json(v.col), "[^0-9]", ""))
                whole, words = (F.try_variant_get(v.col, "$", t) for t in ("bigint", "string"))
                other = F.when((tag(v) == "number") & (digits <= 15), number_text(numeric(v))).otherwise(F.to_json(v.col))
                col = F.when(schema(v) == "STRING", F.concat(F.lit("s"), words)).when(schema(v) == "BIGINT", F.concat(F.lit("j"), whole.cast("string"))).otherwise(F.concat(F.lit("j"), other))
            else:
                col = native if native is not None else v.col
            keys.append((name, col, v.kind == "variant"))
        for there in keep:
            df = df.filter(there)
        items = [i for i in q.items if isinstance(i, Item) and is_aggregate(i.expr)]
        names = unique_names(items)
        made = [aggregate(i.expr, self.scope).alias(n) for i, n in zip(items, names, strict=True)]
        marked = df.groupBy(*[c.alias(f"__k{i}") for i, (_, c, _) in enumerate(keys)])
        out = marked.agg(*made) if made else marked.agg(F.count(F.lit(1)).alias("__n"))
        shown = [(_grouped_value(F.col(f"__k{i}")) if dyn else F.col(f"__k{i}")).alias(n) for i, (n, _, dyn) in enumerate(keys)]
        out = out.select(*shown, *[F.col(f"`{n}`") for n in names])
        inner = Scope(out.schema, {})
        if q.having is not None:
            out = out.filter(predicates.tree(q.having, lambda e: _flat(inner, e, out.columns)))
        if q.order:
            by = []
            for k, down in q.order:
                name = _sort_name(k, out.columns)
                by += _sort_keys(column_value(F.col(f"`{name}`"), out.schema[name].dataType), F.col(f"`{name}`"), down)
            out = self.sort(out, by)
        return self.limited(out)

    def projection(self, scope: Scope) -> tuple[dict[str, Column], Expand | None, str | None]:
        q, out = self.query, {}
        expand = next((i for i in q.items if isinstance(i, Expand)), None)
        for item in q.items or [Star()]:
            if isinstance(item, Star):
                if scope.dynamic:
                    out["_v"] = F.col("_v")
                for name in scope.fields():
                    if name not in item.remove:
                        out[name] = F.col(f"`{name}`")
                for extra in item.add:
                    out[extra.alias] = scope.value(extra.expr).col
            elif isinstance(item, Item):
                native = scope.native(item.expr.parts) if isinstance(item.expr, Path) else None
                col = native if native is not None else replace(scope, aliases={}).value(item.expr).col
                out[output_name(item)] = col
        return out, expand, (expand.alias or expand.path.parts[-1]) if expand else None

    def rows(self, df: DataFrame) -> DataFrame:
        q, scope = self.query, self.scope
        if scope.dynamic and not q.items:
            df = df.select("_raw", *[c for c in ("_pos",) if c in df.columns])
            df = df.orderBy("_pos").limit(q.limit) if q.limit is not None and "_pos" in df.columns else self.limited(df)
            return df.select("_raw")
        columns, expand, name = self.projection(scope)
        hidden = {}
        if q.order:
            for i, (c, down) in enumerate(self.order_columns(scope, list(columns))):
                hidden[f"__o{i}"] = (c, down)
        pos = ["_pos"] if "_pos" in df.columns and (q.order or q.limit is not None) else []
        if expand is not None:
            v = scope.value(expand.path)
            if expand.delimiter is not None:
                arr = FUNCTIONS["split"](v, literal(expand.delimiter)).col
            elif v.kind == "variant":
                arr = F.coalesce(F.try_variant_get(v.col, "$", "array<variant>"), F.try_variant_get(F.try_parse_json(F.try_variant_get(v.col, "$", "string")), "$", "array<variant>"))
            elif v.kind == "string":
                arr = F.from_json(v.col, "array<string>")
            elif v.kind == "array":
                arr = v.col
            else:
                raise BindError("expand needs an array")
            columns.pop(name, None)
            columns[name] = F.explode(arr)
        out = df.select(*[F.col(p) for p in pos], *[c.alias(n) for n, (c, _) in hidden.items()], *[c.alias(n) for n, c in columns.items()])
        if q.distinct:
            out = self.distinct(out, list(columns), list(hidden), pos)
        if q.order:
            out = self.sort(out, [(F.col(n), down) for n, (_, down) in hidden.items()])
        elif pos:
            out = out.orderBy("_pos")
        return self.limited(out).select(*[F.col(f"`{n}`") for n in columns])

    def distinct(self, df: DataFrame, names: list[str], hidden: list[str], pos: list[str]) -> DataFrame:
        kinds = dict(df.dtypes)
        if not any(kinds[n] == "variant" for n in names) and not pos:
            return df.dropDuplicates(names)
        keys = [(F.to_json(F.col(f"`{n}`")) if kinds[n] == "variant" else F.col(f"`{n}`")).alias(f"__d{i}") for i, n in enumerate(names)]
        rest = [c for c in df.columns if c not in pos]
        first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.col("_pos")) if pos else F.first(F.struct(*[F.col(f"`{c}`") for c in rest]))
        out = df.groupBy(*keys).agg(first.alias("__r"), *[F.min(p).alias(p) for p in pos])
        return out.select(*pos, *[F.col("__r").getField(c).alias(c) for c in rest])


def _flat(scope: Scope, e, columns: list[str]) -> Value:
    """Group output names may hold dots; an aggregate call names its column."""
    if isinstance(e, Path) and ".".join(e.parts) in columns:
        name = ".".join(e.parts)
        return column_value(F.col(f"`{name}`"), scope.schema[name].dataType)
    if is_aggregate(e) and e.name in columns:
        return column_value(F.col(f"`{e.name}`"), scope.schema[e.name].dataType)
    return scope.value(e)


def _grouped_value(key: Column) -> Column:
    """The variant that a group key's text stands for."""
    rest = F.substring(key, 2, 2**31 - 1)
    return F.when(key.startswith("s"), rest.cast("variant")).otherwise(F.try_parse_json(F.when(~key.startswith("s"), rest)))


def _sort_keys(v: Value, col: Column, down: bool) -> list[tuple[Column, bool]]:
    """A variant sorts by its number, then by its text."""
    if v.kind != "variant":
        return [(col, down)]
    return [(F.when(tag(v) == "number", numeric(v)), down), (F.when(tag(v) == "string", F.try_variant_get(v.col, "$", "string")), down)]


def _sort_name(key, columns: list[str]) -> str:
    if isinstance(key, int):
        return columns[key - 1]
    name = ".".join(key.parts) if isinstance(key, Path) else key.name
    if name not in columns:
        raise BindError(f"no column {name} to order by")
    return name


def variables(args: dict | None = None) -> dict[str, object]:
    return {f"ENV.{k}": v for k, v in os.environ.items()} | (args or {})


def query(df: DataFrame, text: str, **args) -> DataFrame:
    """The rows of one query over a frame; $name in the text is an argument, $ENV.NAME the environment.

    A query with INTO writes its rows to that path as NDJSON and returns the lines written (`value`).
    """
    q = parse(text, variables(args))
    out = Plan(scoped(df, q) if q.scope else df, q).frame()
    if q.into is None:
        return out
    from ..sources.sinks import write

    write(out, q.into)
    return df.sparkSession.read.text(q.into)


def scoped(df: DataFrame, q: Query) -> DataFrame:
    from ..sources.json import descend

    return descend(df, q.scope)


def flat_query(df: DataFrame, text: str, **args) -> DataFrame:
    """(_pos, path, value): the flattened leaves of records that pass a query whose paths may hold `*` and `**`.

    Without a scope WHERE is asked of each leaf by itself, so `a = 1 and b = 2` finds none. A
    scope `[a.*]` groups the leaves under each path of that form; all of a group's leaves pass
    if WHERE does, where a comparison holds if any leaf of the group that its glob names
    passes it. `[*]` takes every array in turn. Selected fields are globs too, and an alias
    replaces what is left of the path after the scope. Other clauses are ignored.
    """
    from ..sources.json import flatten, glob_regex

    q = parse(text, variables(args), globs=True)
    flat = flatten(df)
    names = F.split("path", r"\.")
    if q.scope == ("*",):
        depth = F.array_position(F.transform(names, lambda x: x.rlike("^[0-9]+$")), True).cast("int")
        flat = flat.withColumn("__depth", depth).filter("__depth > 1")
    elif q.scope:
        flat = flat.withColumn("__depth", F.lit(len(q.scope)))
    if q.scope:
        flat = flat.filter(F.size(names) > F.col("__depth"))
        flat = flat.withColumns({"__prefix": F.concat_ws(".", F.slice(names, 1, F.col("__depth"))), "__rest": F.concat_ws(".", F.slice(names, F.col("__depth") + 1, F.size(names)))})
        if q.scope != ("*",):
            flat = flat.filter(F.col("__prefix").rlike(glob_regex(".".join(q.scope))))
    else:
        flat = flat.withColumns({"__prefix": F.lit(None).cast("string"), "__rest": F.col("path")})
    if q.where is not None:
        leaf = Value("variant", F.col("value"), F.col("value").isNotNull(), field=True)

        def holds(p) -> Column:
            if not isinstance(p, Leaf):
                parts = [holds(x) for x in p.items]
                out = ~parts[0] if p.op == "not" else parts[0]
                for x in parts[1:]:
                    out = (out & x) if p.op == "and" else (out | x)
                return out
            if not isinstance(p.left, Path):
                raise BindError("flat queries compare fields only")
            one = F.col("__rest").rlike(glob_regex(".".join(p.left.parts))) & F.coalesce(predicates.leaf(p, leaf), F.lit(False))
            return F.max(one).over(Window.partitionBy("_pos", "__prefix")) if q.scope else one  # a group is part of one record

        flat = flat.withColumn("__pass", holds(q.where)).filter("__pass")
    rest = F.col("__rest")
    items = [i for i in q.items if isinstance(i, Item)]
    if items:
        for i in items:
            if not isinstance(i.expr, Path):
                raise BindError("flat queries select fields only")
        hit = lambda i: F.col("__rest").rlike(glob_regex(".".join(i.expr.parts)))
        rest = F.coalesce(*[F.when(hit(i), F.lit(i.alias) if i.alias else F.col("__rest")) for i in items])
    return flat.select("_pos", F.concat_ws(".", "__prefix", rest).alias("path"), "value", rest.isNotNull().alias("__keep")).filter("__keep").drop("__keep")


def query_all(df: DataFrame, text: str, **args) -> list[DataFrame]:
    """Every query of a `;` separated text over one cached frame."""
    parts = split_queries(text)
    if len(parts) > 1:
        df = df.cache()
    return [query(df, p, **args) for p in parts]
