import json
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quillstream.operators.predicates import regex
from quillstream.plans import catalog
from quillstream.plans.engine import query, query_all
from quillstream.plans.syntax import ParseError, parse, split_queries
from quillstream.sources.json import flatten, glob_regex, read_array, read_document, records
from quillstream.sources.sinks import split_by, to_ndjson, write
from quillstream.sources.text import read_delimited, read_lines
from quillstream.streaming.tokens import PRESETS, Cutter, accumulate, cut_objects, expect, fragments, objects, rolling, truncated

SF = "/root/testdata/sf0.001"


def recs(spark, *lines):
    return records(spark.createDataFrame(list(enumerate(lines)), "_pos long, value string"))


def good(spark, *lines):
    return recs(spark, *lines).filter("_valid").drop("_valid")


@pytest.mark.parametrize("text", ["", "select", "select a limit x", "select a where", "select a + 1", "where a > 1 where b > 1", "select a where b between 1 and 2", "select a order by 1.5"])
def test_parse_errors(text):
    with pytest.raises(ParseError):
        parse(text)


def test_parse_forms():
    assert len(split_queries("select 'a;b' as x; where c = 1")) == 2
    assert parse("group by a select a, count() limit 3").limit == 3
    assert parse("select a-b where x = $n", {"n": 4}).where.right == 4


def test_regex_translation():
    assert regex("a(b{1}|c$") == r"(?s)(?:a\(b\{1\})|(?:c\z)"


def test_malformed_records(spark):
    bad = ['{"a":2,,}', '{"a":01}', '{"a":tru}', '{"a":2}}', '{"a":1} x', '{"a":1} ]', "{'a':1}", '{"a":NaN}']
    assert recs(spark, *bad).filter("_valid").count() == 0
    assert recs(spark, '{"a":1}', '{"a":1},', '{"a":1,"a":2}', "[1]", "").filter("_valid").count() == 3


MIXED = ['{"i":0,"v":5}', '{"i":1,"v":"5"}', '{"i":2,"v":"x"}', '{"i":3,"v":null}', '{"i":4}', '{"i":5,"v":true}', '{"i":6,"v":["x","y"]}', '{"i":7,"v":{"k":1}}']
TRUTH = {
    "v = 5": [0], "v = '5'": [1], "v != 5": [1, 2, 3, 5, 6, 7], "v = null": [3], "v is null": [3, 4], "v is not null": [0, 1, 2, 5, 6, 7], "v > 4": [0],
    "v = true": [5], "v contains 'x'": [2, 6], "v not contains 'x'": [0, 1, 3, 5, 7], "v in (5, 'x')": [0, 1, 2], "v not in ('x')": [0, 1, 3, 5, 6, 7],
    "v matches 'x'": [2], "v not matches 'x'": [1], "has(v)": [0, 1, 2, 3, 5, 6, 7], "not has(v)": [4], "not (v = 5)": [1, 2, 3, 4, 5, 6, 7],
    "v + 1 = 6": [0, 1], "len(v) > 1": [6], "v.k = 1": [7], "v.0 = 'x'": [6], "v between [5 and 6)": [0],
}


@pytest.mark.parametrize("where", TRUTH)
def test_two_valued_truth_table(spark, where):
    out = query(good(spark, *MIXED), f"where {where}")
    assert sorted(json.loads(r[0])["i"] for r in out.collect()) == TRUTH[where]


def test_dynamic_groups_and_output(spark):
    df = good(spark, '{"k":1,"v":2}', '{"k":1.0,"v":"3"}', '{"k":"1","v":4}', '{"v":9}', '{"k":null,"v":1}')
    out = {r[0] for r in to_ndjson(query(df, "select k, sum(v) as s, count() group by k")).collect()}
    assert out == {'{"k": 1, "s": 5, "count": 2}', '{"k": "1", "s": 4, "count": 1}', '{"k": null, "s": 1, "count": 1}'}


def test_order_limit_expand(spark):
    df = good(spark, '{"a":[1,2],"n":"b"}', '{"a":[],"n":"a"}', '{"n":"c"}', '{"a":"[3]","n":"d"}')
    assert [r[0] for r in to_ndjson(query(df, "select n, expand(a) as x order by n desc")).collect()] == ['{"n": "d", "x": 3}', '{"n": "b", "x": 1}', '{"n": "b", "x": 2}']
    assert [r[0] for r in to_ndjson(query(df, "select n limit 2")).collect()] == ['{"n": "b"}', '{"n": "a"}']


def test_scope_and_flatten(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"u": {"list": [{"id": 1, "t": {"x": [5, 6]}}, 7, {"id": 2}]}}')
    doc = read_document(spark, str(tmp_path))
    assert query(doc, "[u.list.*] select id where id > 1").count() == 1
    assert {r["path"] for r in flatten(doc).collect()} == {"u.list.0.id", "u.list.0.t.x.0", "u.list.0.t.x.1", "u.list.1", "u.list.2.id"}


def test_scalars(spark):
    row = query(spark.range(1), "select substr('hello', 1, 3) as a, lpad('abcdef', 3, '*') as b, round(1.005, 2) as c, 5 % 0 as d, to_epoch('2025-02-30') as e, upper('aé') as f, type(nothere) as g, -5 % 3 as h").first()
    assert tuple(row) == ("ell", "abcdef", 1.0, None, 1740873600.0, "Aé", "null", -2.0)


def test_multi_query(spark):
    assert [d.count() for d in query_all(spark.range(10), "select id where id > 6; select id where id < $n", n=2)] == [3, 2]


def test_token_streams(spark):
    assert cut_objects('x {"a":"}{"} {"b":{"c":1}} {"d"') == (['{"a":"}{"}', '{"b":{"c":1}}'], '{"d"')
    path, events = PRESETS["openai"]
    lines = []
    for s in ("p", "q"):
        for i, part in enumerate(['noise {"na', 'me":"' + s, '","n":', "3}", ' {"cut']):
            lines.append((s, i, "data: " + json.dumps({"choices": [{"delta": {"content": part}}]})))
        lines.append((s, 9, "data: [DONE]"))
    found = accumulate(fragments(spark.createDataFrame(lines, "s string, i long, value string"), path, events), "s", "i")
    assert sorted(r["_raw"] for r in found.collect()) == ['{"name":"p","n":3}', '{"name":"q","n":3}']
    assert objects(found).filter(expect("name:enum(p,z), n:number")).count() == 1


def test_streaming_rows(spark, tmp_path):
    from quillstream.streaming.run import read_stream, start, stream_query

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(MIXED))
    out, mode = stream_query(read_stream(spark, str(tmp_path / "in")), "select i where i > 4")
    start(out, mode, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.text(f"{tmp_path}/out").count() == 3


NAMES = [
    "flagship", "where_type_mismatch", "group_case_alias", "distinct_order_limit", "fn_lpad", "json_path", "rolling_group", "rolling_global", "rolling_tables", "keys", "values", "entries",
    "substr_far", "pad_far", "date_far", "time_equal", "in_mixed", "contains_numbers", "having_alone", "split_counts", "scope_array", "scope_auto", "equal_null", "dynamic_order", "flat_where",
    "flat_select", "flat_scope", "flat_auto", "sink_csv", "sink_json_array", "sink_raw", "into_path", "delimited_cells", "route_lines", "preset_openai",
]


@pytest.mark.parametrize("name", NAMES)
def test_catalog_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "customer", "part", "events", "orders", "nation", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = catalog.queries()[name](spark, SF)
    want = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]

    def plain(v):
        if hasattr(v, "asDict"):
            v = v.asDict()
        if isinstance(v, list):
            return [plain(x) for x in v]
        return round(v, 4) + 0.0 if isinstance(v, float) else v

    key = lambda rows: sorted(str([plain(v) for v in r]) for r in rows)
    assert key(tuple(r) for r in got.select(*[F.col(f"`{n}`") for n in names]).collect()) == key(want.fetchall())


def test_two_stars_keep_order(spark):
    rows = [(2**33 + i, json.dumps({"a": [{"b": [{"x": 100 * i + 10 * j + k} for k in range(3)]} for j in range(3)]})) for i in range(4)]
    doc = spark.createDataFrame(rows, "_pos long, _raw string").withColumn("_v", F.parse_json("_raw"))
    got = [r[0] for r in to_ndjson(query(doc, "[a.*.b.*] select x limit 20")).collect()]
    assert got == [f'{{"x": {100 * i + 10 * j + k}}}' for i in range(4) for j in range(3) for k in range(3)][:20]


def test_flatten_has_no_depth(spark):
    deep = '{"a":' * 30 + '[1.50,{"z":null}]' + "}" * 30
    doc = spark.createDataFrame([(0, deep), (1, '{"e":{},"f":[]}')], "_pos long, _raw string")
    got = {(r["_pos"], r["path"], r["v"]) for r in flatten(doc).select("_pos", "path", F.to_json("value").alias("v")).collect()}
    path = ".".join(["a"] * 30)
    assert got == {(0, f"{path}.0", "1.5"), (0, f"{path}.1.z", "null")}


def test_globs():
    hit = lambda pattern, *paths: [bool(re.search(glob_regex(pattern), p)) for p in paths]
    assert hit("a.*.c", "a.b.c", "a.c", "a.b.b.c") == [True, False, False]
    assert hit("a.**", "a.b", "a.b.c", "a", "b.a") == [True, True, False, False]
    assert hit("**", "x", "x.y") == [True, True]
    assert hit("a+b", "a+b", "aab") == [True, False]


def test_split_delimiters_are_literal(spark):
    df = spark.createDataFrame([("a\\Eb.c", "\\E"), ("a.b", "."), ("ab", ""), ("a|b", "|")], "s string, d string")
    assert [r[0] for r in query(df, "select split(s, d) as x").collect()] == [["a", "b.c"], ["a", "b"], None, ["a", "b"]]


def test_split_by_keeps_columns_and_leaves_nested_out(spark, tmp_path):
    df = spark.createDataFrame([("k1", 1, "x"), (None, 2, "y/z"), ("null", 3, "x"), ("k1", 4, None)], "key string, n long, v string")
    told = {(r["v"], r["file"], r["count"]) for r in split_by(df, "v", str(tmp_path / "a")).collect()}
    assert told == {("x", "x.jsonl", 2), ("y/z", "y_z.jsonl", 1), ("null", "null.jsonl", 1)}
    lines = sorted(r[0] for r in spark.read.text(str(tmp_path / "a" / "x.jsonl")).collect())
    assert lines == ['{"key": "k1", "n": 1, "v": "x"}', '{"key": "null", "n": 3, "v": "x"}']
    nested = spark.createDataFrame([([1],), ([],)], "a array<int>")
    assert split_by(nested, "a", str(tmp_path / "b")).count() == 0


def test_json_array_of_many_tasks(spark, tmp_path):
    n, kept = 40_000, {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.files.maxPartitionBytes")}
    df = spark.range(0, n, 1, 5).select((F.col("id") * 7919 % n).alias("k"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else these few rows meet in one task
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        write(df.orderBy("k"), str(tmp_path / "x"), "json")
        rows = query(read_array(spark, str(tmp_path / "x")), "select k, v").selectExpr("cast(k as long) as k", "cast(v as string) as v").collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    files = sorted((tmp_path / "x").glob("part-*"))
    assert len(files) > 1
    doc = json.loads("".join(f.read_text() for f in files))
    assert [r["k"] for r in doc] == list(range(n)) and sorted((r["k"], r["v"]) for r in rows) == [(r["k"], r["v"]) for r in doc]


@pytest.mark.parametrize("bad", ["", "[", "]", "[]", '{"a":1}', '[\n{"a":1},\n]', '[\n{"a":1}\n{"a":2}\n]', '[\n{"a":1}', '{"a":1}\n]', '[\n[\n]', "[\nx,\n1\n]", '[\n{"a":1}\n]\n]', '[\n{"a":1}},\n1\n]', '[\n{"a":1,},\n{"a":1}\n]', "[\n,\n1\n]"])
def test_no_array_of_lines(spark, tmp_path, bad):
    (tmp_path / "a.json").write_text(bad)
    with pytest.raises(Exception, match="not one JSON array|malformed element"):
        read_array(spark, str(tmp_path)).select(F.to_json("_v")).collect()


def test_array_of_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n  {"a":1},\n\n  7,\n"]",\n [1, 2],\n {"a":","}\t\n]\n')
    (tmp_path / "empty").mkdir()
    write(spark.range(0), str(tmp_path / "empty"), "json")
    assert [(r["_pos"], r["_raw"]) for r in read_array(spark, str(tmp_path / "a.json")).collect()] == [(2, '{"a":1}'), (6, '{"a":","}')]
    assert read_array(spark, str(tmp_path / "empty")).count() == 0


def parts(folder, sizes, line):
    """Text files of these numbers of lines, in the order of their names; Spark reads the largest first."""
    folder.mkdir()
    at = 0
    for i, n in enumerate(sizes):
        (folder / f"part-{i}.txt").write_text("".join(line(at + j) + "\n" for j in range(n)))
        at += n
    return at


def test_delimited_numbers_follow_the_files(spark, tmp_path):
    n = parts(tmp_path / "d", [3, 0, 900, 1, 40_000, 2, 9, 5, 700, 4, 80_000, 6], lambda i: f"{i};{i if i % 2 else 'x'}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        rows = read_delimited(spark, str(tmp_path / "d"), ";", columns=["__file", "a.b"]).selectExpr("__file as k", "_n", "schema_of_variant(`a.b`) as t").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["_n"], r["k"], r["t"] == "DOUBLE") for r in rows) == [(i + 1, float(i), i % 2 == 1) for i in range(n)]


def test_line_numbers_follow_the_files(spark, tmp_path):
    n = parts(tmp_path / "d", [3, 0, 900, 1, 40_000, 2, 9, 5, 700, 4, 80_000, 6], lambda i: f" {i}\r\n \r")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        rows = read_lines(spark, str(tmp_path / "d")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["_n"], r["line"]) for r in rows) == [(i + 1, f" {i}") for i in range(n)]


def test_numbers_are_not_given_to_blocks_packed_anew(spark, tmp_path):
    parts(tmp_path / "d", [30_000, 10, 50_000], lambda i: f"{i};x")
    rows = read_delimited(spark, str(tmp_path / "d"), ";")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000000")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        with pytest.raises(Exception, match="packed anew"):
            rows.agg(F.sum("_n")).collect()
    finally:
        for k in ("openCostInBytes", "maxPartitionBytes", "minPartitionNum"):
            spark.conf.unset(f"spark.sql.files.{k}")
    assert rows.agg(F.max("_n")).first()[0] == 80_010


def test_empty_json_array(spark, tmp_path):
    write(spark.range(0), str(tmp_path / "x"), "json")
    assert [r[0] for r in spark.read.text(str(tmp_path / "x")).collect()] == ["[", "]"]


def test_cutter_does_not_depend_on_pieces(spark):
    text = 'no } "quote { {"a":"}\\"{"} x {"b":{"c":"\\\\"}}{"d":1'
    whole, rest = cut_objects(text)
    for n in (1, 2, 3, 7):
        cutter = Cutter()
        found = [o for i in range(0, len(text), n) for o in cutter.feed(text[i : i + n])]
        assert (found, cutter.rest) == (whole, rest)
    rows = spark.createDataFrame([("p", 0, '{"a":1} {"b"'), ("q", 0, '{"a":1}')], "s string, i long, fragment string")
    assert [tuple(r) for r in truncated(rows, "s", "i").collect()] == [("p", 4)]


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet(f"{SF}/orders.parquet")
    plan = lambda where: query(df, f"select o_orderkey where {where}")._jdf.queryExecution().executedPlan().toString()
    assert "In(o_custkey, [3,5])" in plan("o_custkey in (3, 5)")
    assert "EqualTo(o_orderstatus,F)" in plan("o_orderstatus != 'F'")
    assert "GreaterThanOrEqual(o_orderdate" in plan("o_orderdate = '1996-01-02T00:00:00Z'")


def test_no_task_holds_all_rows_of_a_rolling_total(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("o"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("v"))
    out = rolling(df, "o", {"n": ("count", None), "m": ("count", "v"), "s": ("sum", "v"), "hi": ("max", "v")})
    held = {r["o"]: r["v"] for r in df.collect()}
    n = m = s = 0
    hi = None
    want = []
    for o in sorted(held):
        v = held[o]
        n, m, s = n + 1, m + (v is not None), s + (v or 0)
        hi = v if hi is None else max(hi, hi if v is None else v)
        want.append((o, n, m, s if m else None, hi))
    assert sorted(tuple(r) for r in out.collect()) == want
    assert "SinglePartition" not in out.filter("n > 3")._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]


def test_limit_stops_a_stream(spark, tmp_path):
    from quillstream.streaming.run import read_stream, start, stream_query

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(MIXED))
    out, mode = stream_query(read_stream(spark, str(tmp_path / "in")), "select i where i > 1")
    start(out, mode, str(tmp_path / "out"), str(tmp_path / "cp"), limit=2).awaitTermination()
    assert spark.read.text(f"{tmp_path}/out").count() == 2
