"""Named queries over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import Scratch
from .engine import flat_query, query, query_all

ISO = "strftime({}, '%Y-%m-%dT%H:%M:%SZ')"
LETTERS = "'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
OPEN_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

#: name -> (table, query in the dialect, SQL). Doubles of the result are rounded to DIGITS on both sides.
DIGITS = 4
QUERIES: dict[str, tuple[str, str, str]] = {
    # projection and filter
    "select_fields": ("orders", "select o_orderkey, o_orderstatus as status", "select o_orderkey, o_orderstatus as status from orders"),
    "select_star": ("region", "select *", "select * from region"),
    "star_add": ("nation", "select * add n_nationkey * 2 as twice", "select *, cast(n_nationkey * 2 as double) as twice from nation"),
    "star_remove": ("nation", "select * remove n_regionkey", "select n_nationkey, n_name from nation"),
    "alias_where": ("customer", "select c_name as who, c_acctbal as bal where bal > 5000", "select c_name as who, c_acctbal as bal from customer where c_acctbal > 5000"),
    "computed_arith": ("lineitem", "select l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) as net, l_quantity + 1 as q1, l_quantity - 1 as q0", "select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as net, l_quantity + 1 as q1, l_quantity - 1 as q0 from lineitem"),
    "computed_alias_where": ("lineitem", "select l_orderkey, l_linenumber, l_quantity * 2 as dbl where dbl > 90", "select l_orderkey, l_linenumber, l_quantity * 2 as dbl from lineitem where l_quantity * 2 > 90"),
    "case_when": ("orders", "select o_orderkey, case when o_totalprice > 200000 then 'big' when o_totalprice > 100000 then 'mid' else 'small' end as size", "select o_orderkey, case when o_totalprice > 200000 then 'big' when o_totalprice > 100000 then 'mid' else 'small' end as size from orders"),
    "case_no_else": ("orders", "select o_orderkey, case when o_orderstatus = 'F' then 1 end as f", "select o_orderkey, case when o_orderstatus = 'F' then 1 end as f from orders"),
    "coalesce_op": ("supplier", "select s_suppkey, s_acctbal / 0 // s_nationkey as v", "select s_suppkey, cast(s_nationkey as double) as v from supplier"),
    "duplicate_names": ("nation", "select n_name as a, n_nationkey as a", "select n_nationkey as a from nation"),
    # predicates
    "where_eq": ("orders", "select o_orderkey where o_orderstatus = 'F'", "select o_orderkey from orders where o_orderstatus = 'F'"),
    "where_neq": ("orders", "select o_orderkey where o_orderstatus != 'F'", "select o_orderkey from orders where o_orderstatus <> 'F'"),
    "where_range": ("lineitem", "select l_orderkey, l_linenumber where l_quantity >= 10 and l_quantity < 12", "select l_orderkey, l_linenumber from lineitem where l_quantity >= 10 and l_quantity < 12"),
    "where_and_or": ("customer", "select c_custkey where c_mktsegment = 'BUILDING' and c_acctbal > 0 or c_nationkey = 3", "select c_custkey from customer where (c_mktsegment = 'BUILDING' and c_acctbal > 0) or c_nationkey = 3"),
    "where_not_group": ("customer", "select c_custkey where not (c_acctbal > 0 or c_nationkey = 3)", "select c_custkey from customer where not (c_acctbal > 0 or c_nationkey = 3)"),
    "where_type_mismatch": ("customer", "select c_custkey where c_name > 5 or c_custkey = '7'", "select c_custkey from customer where false"),
    "where_missing_field": ("customer", "select c_custkey where nothere != 5 or nothere is not null", "select c_custkey from customer where false"),
    "not_missing_field": ("region", "select r_name where not (nothere = 5)", "select r_name from region"),
    "like_prefix": ("part", "select p_partkey where p_type like 'STANDARD%'", "select p_partkey from part where p_type like 'STANDARD%'"),
    "like_underscore": ("part", "select p_partkey where p_brand like 'Brand#_3'", "select p_partkey from part where p_brand like 'Brand#_3'"),
    "contains": ("documents", "select doc_id where text contains 'the'", "select doc_id from documents where contains(text, 'the')"),
    "not_contains": ("documents", "select doc_id where text not contains 'the'", "select doc_id from documents where not contains(text, 'the')"),
    "starts_with": ("pages", "select page_id where url starts_with 'https://'", "select page_id from pages where starts_with(url, 'https://')"),
    "ends_with": ("pages", "select page_id where url ends_with '/'", "select page_id from pages where ends_with(url, '/')"),
    "in_strings": ("customer", "select c_custkey where c_mktsegment in ('BUILDING', 'MACHINERY')", "select c_custkey from customer where c_mktsegment in ('BUILDING', 'MACHINERY')"),
    "in_numbers": ("part", "select p_partkey where p_size in (1, 5, 15)", "select p_partkey from part where p_size in (1, 5, 15)"),
    "not_in": ("customer", "select c_custkey where c_mktsegment not in ('BUILDING', 'MACHINERY')", "select c_custkey from customer where c_mktsegment not in ('BUILDING', 'MACHINERY')"),
    "is_null": ("lineitem", "select l_orderkey, l_linenumber where (l_tax / l_discount) is null", "select l_orderkey, l_linenumber from lineitem where l_tax / nullif(l_discount, 0) is null"),
    "is_not_null": ("lineitem", "select l_orderkey, l_linenumber where (l_tax / l_discount) is not null", "select l_orderkey, l_linenumber from lineitem where l_tax / nullif(l_discount, 0) is not null"),
    "has_key": ("nation", "select n_name where has(n_name) and not has(nothere)", "select n_name from nation"),
    "matches_regex": ("pages", r"select page_id where url matches '^https://[a-z]+\.[a-z]+'", r"select page_id from pages where regexp_matches(url, '^https://[a-z]+\.[a-z]+')"),
    "matches_alternatives": ("pages", r"select page_id where url matches '\d\d$|/$'", r"select page_id from pages where regexp_matches(url, '\d\d$|/$')"),
    "not_matches": ("pages", r"select page_id where url not matches '\.html$'", r"select page_id from pages where not regexp_matches(url, '\.html$')"),
    "between_cc": ("lineitem", "select l_orderkey, l_linenumber where l_quantity between [10 and 12]", "select l_orderkey, l_linenumber from lineitem where l_quantity >= 10 and l_quantity <= 12"),
    "between_oo": ("lineitem", "select l_orderkey, l_linenumber where l_quantity between (10 and 12)", "select l_orderkey, l_linenumber from lineitem where l_quantity > 10 and l_quantity < 12"),
    "between_co": ("lineitem", "select l_orderkey, l_linenumber where l_quantity between [10 and 12)", "select l_orderkey, l_linenumber from lineitem where l_quantity >= 10 and l_quantity < 12"),
    "between_oc": ("lineitem", "select l_orderkey, l_linenumber where l_quantity between (10 and 12]", "select l_orderkey, l_linenumber from lineitem where l_quantity > 10 and l_quantity <= 12"),
    "expr_lhs": ("lineitem", "select l_orderkey, l_linenumber where l_quantity * 2 between [20 and 24] and len(l_returnflag) = 1", "select l_orderkey, l_linenumber from lineitem where l_quantity * 2 between 20 and 24 and strlen(l_returnflag) = 1"),
    # aggregates
    "count_rows": ("lineitem", "select count()", 'select count(*) as "count" from lineitem'),
    "count_expr": ("lineitem", "select count(l_tax / l_discount) as n", "select count(l_tax / nullif(l_discount, 0)) as n from lineitem"),
    "sum_avg": ("lineitem", "select sum(l_quantity) as s, avg(l_extendedprice) as a", "select sum(l_quantity) as s, round(avg(l_extendedprice), 4) as a from lineitem"),
    "min_max": ("lineitem", "select min(l_extendedprice) as lo, max(l_extendedprice) as hi, max(l_returnflag) as none", "select min(l_extendedprice) as lo, max(l_extendedprice) as hi, cast(null as double) as none from lineitem"),
    "stddev_variance": ("lineitem", "select l_returnflag, stddev(l_quantity) as sd, variance(l_quantity) as va group by l_returnflag", "select l_returnflag, round(stddev_pop(l_quantity), 4) as sd, round(var_pop(l_quantity), 4) as va from lineitem group by 1"),
    "agg_expr": ("lineitem", "select l_linestatus, sum(l_extendedprice * (1 - l_discount)) as revenue group by l_linestatus", "select l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue from lineitem group by 1"),
    "group_one": ("orders", "select o_orderstatus, count() as n group by o_orderstatus", "select o_orderstatus, count(*) as n from orders group by 1"),
    "group_two": ("lineitem", "select count() as n, avg(l_discount) as d group by l_returnflag, l_linestatus", "select l_returnflag, l_linestatus, count(*) as n, round(avg(l_discount), 4) as d from lineitem group by 1, 2"),
    "group_alias": ("orders", "select o_orderpriority as pri, count() as n group by pri", "select o_orderpriority as pri, count(*) as n from orders group by 1"),
    "group_func": ("customer", "select lower(c_mktsegment) as seg, sum(c_acctbal) as bal group by lower(c_mktsegment)", f"select translate(c_mktsegment, {OPEN_LETTERS}) as seg, round(sum(c_acctbal), 4) as bal from customer group by 1"),
    "group_case_alias": ("lineitem", "select case when l_quantity > 25 then 'hi' else 'lo' end as band, count() as n group by band", "select case when l_quantity > 25 then 'hi' else 'lo' end as band, count(*) as n from lineitem group by 1"),
    "group_missing_key": ("orders", "select count() as n group by nothere", "select null as nothere, count(*) as n from orders where false group by 1"),
    "having": ("customer", "select c_nationkey, count() as n, sum(c_acctbal) as bal group by c_nationkey having n >= 60 and bal > 0", "select c_nationkey, count(*) as n, round(sum(c_acctbal), 4) as bal from customer group by 1 having count(*) >= 60 and sum(c_acctbal) > 0"),
    "group_order_limit": ("lineitem", "select l_suppkey, sum(l_quantity) as q group by l_suppkey order by q desc, l_suppkey limit 7", "select l_suppkey, sum(l_quantity) as q from lineitem group by 1 order by q desc, l_suppkey limit 7"),
    "global_agg_empty": ("orders", "select count() as n, sum(o_totalprice) as s where o_totalprice < 0", "select count(*) as n, sum(o_totalprice) as s from orders where o_totalprice < 0"),
    "flagship": ("lineitem", "select l_returnflag, l_linestatus, count() as n, avg(l_quantity) as q where l_discount between [0.05 and 0.07] group by l_returnflag, l_linestatus order by l_returnflag, l_linestatus", "select l_returnflag, l_linestatus, count(*) as n, round(avg(l_quantity), 4) as q from lineitem where l_discount between 0.05 and 0.07 group by 1, 2 order by 1, 2"),
    # order, limit, distinct
    "order_multi": ("customer", "select c_mktsegment, c_custkey order by c_mktsegment desc, c_custkey limit 20", "select c_mktsegment, c_custkey from customer order by 1 desc, 2 limit 20"),
    "order_ordinal": ("customer", "select c_nationkey, c_custkey order by 1, 2 desc limit 20", "select c_nationkey, c_custkey from customer order by 1, 2 desc limit 20"),
    "order_alias": ("lineitem", "select l_orderkey, l_linenumber, l_extendedprice * l_tax as t order by t desc, l_orderkey, l_linenumber limit 15", "select l_orderkey, l_linenumber, round(l_extendedprice * l_tax, 4) as t from lineitem order by l_extendedprice * l_tax desc, 1, 2 limit 15"),
    "top_n": ("orders", "select o_orderkey, o_totalprice order by o_totalprice desc, o_orderkey limit 10", "select o_orderkey, o_totalprice from orders order by 2 desc, 1 limit 10"),
    "distinct_one": ("customer", "select distinct c_mktsegment", "select distinct c_mktsegment from customer"),
    "distinct_two": ("lineitem", "select distinct l_returnflag, l_linestatus", "select distinct l_returnflag, l_linestatus from lineitem"),
    "distinct_order_limit": ("customer", "select distinct c_nationkey order by c_nationkey desc limit 5", "select distinct c_nationkey from customer order by 1 desc limit 5"),
    # unnest
    "expand_array": ("embeddings", "select vec_id, expand(embedding) as x", "select vec_id, unnest(embedding) as x from embeddings"),
    "expand_split": ("conversations", "select conv_id, turn, expand(split(text, ' ')) as w", "select conv_id, turn, unnest(string_split(text, ' ')) as w from conversations"),
    # strings
    "fn_upper": ("documents", "select doc_id, upper(lang) as l, upper(source) as s", f"select doc_id, translate(lang, {LETTERS}) as l, translate(source, {LETTERS}) as s from documents"),
    "fn_lower": ("customer", "select c_custkey, lower(c_name) as n", f"select c_custkey, translate(c_name, {OPEN_LETTERS}) as n from customer"),
    "fn_len": ("documents", "select doc_id, len(text) as n", "select doc_id, cast(strlen(text) as double) as n from documents"),
    "fn_len_array": ("embeddings", "select vec_id, len(embedding) as n", "select vec_id, cast(len(embedding) as double) as n from embeddings"),
    "fn_trim": ("part", "select p_partkey, trim(concat('  ', p_name, ' ')) as n", "select p_partkey, p_name as n from part"),
    "fn_concat": ("customer", "select c_custkey, concat(c_name, ':', c_nationkey) as n", "select c_custkey, c_name || ':' || c_nationkey as n from customer"),
    "fn_substr": ("part", "select p_partkey, substr(p_name, 2, 4) as a, substr(p_name, 3) as b", "select p_partkey, substr(p_name, 3, 4) as a, substr(p_name, 4) as b from part"),
    "fn_replace": ("pages", "select page_id, replace(url, 'http', 'ftp') as u", "select page_id, replace(url, 'http', 'ftp') as u from pages"),
    "fn_lpad": ("part", "select p_partkey, lpad(p_brand, 12, '*x') as p, lpad(p_name, 3, '*') as q", "select p_partkey, case when strlen(p_brand) >= 12 then p_brand else lpad(p_brand, 12, '*') end as p, case when strlen(p_name) >= 3 then p_name else lpad(p_name, 3, '*') end as q from part"),
    "fn_rpad": ("part", "select p_partkey, rpad(p_brand, 12, '.') as p", "select p_partkey, case when strlen(p_brand) >= 12 then p_brand else rpad(p_brand, 12, '.') end as p from part"),
    "fn_split": ("part", "select p_partkey, len(split(p_type, ' ')) as n", "select p_partkey, cast(len(string_split(p_type, ' ')) as double) as n from part"),
    "fn_format": ("nation", 'select format("{n_name} is {n_nationkey} {nothere}") as s', "select n_name || ' is ' || n_nationkey || ' ' as s from nation"),
    "fn_to_str": ("part", "select p_partkey, to_str(p_size) as s", "select p_partkey, cast(p_size as varchar) as s from part"),
    # numbers, types, nulls
    "fn_round": ("lineitem", "select l_orderkey, l_linenumber, round(l_extendedprice) as r, round(l_discount * 3, 1) as d", "select l_orderkey, l_linenumber, case when l_extendedprice >= 0 then floor(l_extendedprice + 0.5) else ceil(l_extendedprice - 0.5) end as r, floor(l_discount * 3 * 10.0 + 0.5) / 10.0 as d from lineitem"),
    "fn_floor_ceil_abs": ("customer", "select c_custkey, floor(c_acctbal) as f, ceil(c_acctbal) as c, abs(c_acctbal) as a", "select c_custkey, floor(c_acctbal) as f, ceil(c_acctbal) as c, abs(c_acctbal) as a from customer"),
    "fn_to_number": ("customer", "select c_custkey, to_number(substr(c_name, 9)) as n, to_number(c_name) as bad", "select c_custkey, case when regexp_matches(substr(c_name, 10), '^-?(0|[1-9][0-9]*)$') then cast(substr(c_name, 10) as double) end as n, cast(null as double) as bad from customer"),
    "fn_type": ("embeddings", "select vec_id, type(vec_id) as a, type(embedding) as b, type(nothere) as c", "select vec_id, 'number' as a, 'array' as b, 'null' as c from embeddings"),
    "fn_isnull": ("supplier", "select s_suppkey, isnull(nothere, 'none') as v", "select s_suppkey, 'none' as v from supplier"),
    "fn_coalesce": ("supplier", "select s_suppkey, coalesce(s_acctbal / 0, nothere, s_nationkey) as v", "select s_suppkey, cast(s_nationkey as double) as v from supplier"),
    "fn_ifhas": ("nation", "select n_name, ifhas(n_name, 'yes', 'no') as a, ifhas(nothere, 'yes', 'no') as b", "select n_name, 'yes' as a, 'no' as b from nation"),
    "div_zero_null": ("lineitem", "select l_orderkey, l_linenumber, l_tax / l_discount as r", "select l_orderkey, l_linenumber, round(l_tax / nullif(l_discount, 0), 4) as r from lineitem"),
    "mod": ("customer", "select c_custkey, c_custkey % 7 as m, (0 - c_custkey) % 7 as neg, c_custkey % 0 as z", "select c_custkey, cast(c_custkey % 7 as double) as m, cast(-(c_custkey % 7) as double) as neg, cast(null as double) as z from customer"),
    # dates
    "to_epoch": ("orders", "select o_orderkey, to_epoch(o_orderdate) as e, to_epoch_ms(o_orderdate) as ms", "select o_orderkey, floor(epoch(o_orderdate)) as e, floor(epoch(o_orderdate)) * 1000 as ms from orders"),
    "from_epoch": ("events", "select event_id, from_epoch(to_epoch(ts)) as s, from_epoch_ms(1000 * event_id) as t", f"select event_id, {ISO.format('ts')} as s, {ISO.format('make_timestamp(event_id * 1000000)')} as t from events"),
    "date_parts": ("orders", "select o_orderkey, date_part(o_orderdate, 'year') as y, date_part(o_orderdate, 'month') as m, date_part(o_orderdate, 'day') as d, date_part(o_orderdate, 'hour') as h", "select o_orderkey, cast(year(o_orderdate) as double) as y, cast(month(o_orderdate) as double) as m, cast(day(o_orderdate) as double) as d, cast(hour(o_orderdate) as double) as h from orders"),
    "date_clock": ("events", "select event_id, date_part(ts, 'minute') as m, date_part(ts, 'second') as s, date_part(ts, 'epoch') as e", "select event_id, cast(minute(ts) as double) as m, cast(floor(second(ts)) as double) as s, floor(epoch(ts)) as e from events"),
    "epoch_arith": ("orders", "select o_orderkey, from_epoch(to_epoch(o_orderdate) + epoch_day(3) + epoch_hour(2) + epoch_min(1) + epoch_week(1)) as later", f"select o_orderkey, {ISO.format('o_orderdate + interval 10 day + interval 2 hour + interval 1 minute')} as later from orders"),
    # objects
    "keys": (
        "nation", "select n_nationkey, to_str(n_name) as s, len(keys()) as n, keys() as k",
        "select n_nationkey, n_name as s, cast(3 as double) as n, ['n_nationkey', 'n_name', 'n_regionkey'] as k from nation",
    ),
    "values": ("nation", "select n_nationkey, values() as v", """select n_nationkey, [cast(n_nationkey as varchar), '"' || n_name || '"', cast(n_regionkey as varchar)] as v from nation"""),
    "entries": (
        "nation", "select n_nationkey, to_entries() as e",
        """select n_nationkey, [{'key': 'n_nationkey', 'value': cast(n_nationkey as varchar)}, {'key': 'n_name', 'value': '"' || n_name || '"'}, {'key': 'n_regionkey', 'value': cast(n_regionkey as varchar)}] as e from nation""",
    ),
    # odd arguments
    "substr_far": ("part", "select p_partkey, substr(p_name, 99999999999) as a, substr(p_name, 2, 99999999999) as b, substr(p_name, nothere) as c, substr(p_name, 1, nothere) as d, substr(p_name, 0 - 3, 2) as e", "select p_partkey, '' as a, substr(p_name, 3) as b, cast(null as varchar) as c, substr(p_name, 2) as d, substr(p_name, 1, 2) as e from part"),
    "pad_far": ("part", "select p_partkey, lpad(p_brand, 99999999999, '*') as a, rpad(p_brand, 0 - 5, '*') as b", "select p_partkey, cast(null as varchar) as a, p_brand as b from part"),
    "date_far": ("part", "select p_partkey, date_part(99999999999999999, 'year') as y, date_part(p_name, 'year') as n, date_part('1969-12-31T23:59:59Z', 'year') as b", "select p_partkey, cast(null as double) as y, cast(null as double) as n, cast(1969 as double) as b from part"),
    "split_text": ("part", "select p_partkey, expand(split(p_type, 'A')) as w", "select p_partkey, unnest(string_split(p_type, 'A')) as w from part"),
    "time_equal": ("orders", "select o_orderkey, o_orderdate as d where o_orderdate = '1996-01-02T00:00:00Z' or o_orderdate != '1996-01-02T00:00:00Z' and o_orderkey < 20", "select o_orderkey, o_orderdate as d from orders where o_orderdate = timestamp '1996-01-02' or o_orderkey < 20"),
    "in_mixed": ("orders", "select o_orderkey where o_custkey in (3, 5.0, 7.5, 'x') or o_orderkey not in (1, 2, 3) and o_orderkey < 9", "select o_orderkey from orders where o_custkey in (3, 5) or (o_orderkey not in (1, 2, 3) and o_orderkey < 9)"),
    "contains_numbers": ("embeddings", "select vec_id where embedding contains '0' or vec_id = 1", "select vec_id from embeddings where vec_id = 1"),
    "unary_minus": ("part", "select p_partkey, p_size * -1 as neg where p_size > -5", "select p_partkey, cast(p_size * -1 as double) as neg from part"),
    "having_alone": ("part", "select p_partkey having p_partkey > 3", "select p_partkey from part"),
    "clause_order": ("part", "limit 3 order by p_partkey where p_size > 1 select p_partkey", "select p_partkey from part where p_size > 1 order by p_partkey limit 3"),
    "now_parts": ("region", "select r_name, len(now()) as n, floor(now_ms() / 1000000000000) as ms, floor(now_epoch() / 1000000000) as s", "select r_name, cast(20 as double) as n, cast(1 as double) as ms, cast(1 as double) as s from region"),
}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to DIGITS places, for comparison with other engines."""
    return df.select(*[F.round(F.col(f"`{f.name}`"), DIGITS).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def _run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    table, text, _ = QUERIES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return rounded(query(spark.read.parquet(f"{sf_dir}/{table}.parquet"), text))

    return run


def json_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the JSON in events.props, bound dynamically."""
    from ..sources.json import records

    lines = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("_pos"), F.col("props").alias("value"))
    return records(lines).filter("_valid").drop("_valid")


def _dynamic(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(json_events(spark, sf_dir), text)


def _dynamic_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = query(json_events(spark, sf_dir), "select k, count() as n, sum(k) as s group by k")
    return out.select(F.try_variant_get("k", "$", "double").alias("k"), "n", "s")


def _reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .engine import Plan
    from .syntax import parse

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.filter(~Plan(orders, parse("select * where o_totalprice > 100000 and o_orderstatus = 'F'")).passing()).select("o_orderkey")


def _split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows counted in the files that split_by writes, beside its summary."""
    from ..sources.sinks import split_by

    path = f"{Scratch(spark, 'split').base}/out"
    told = split_by(query(spark.read.parquet(f"{sf_dir}/orders.parquet"), "select o_orderkey, o_orderstatus"), "o_orderstatus", path)
    lines = spark.read.text(f"{path}/*.jsonl").select("value", F.element_at(F.split(F.input_file_name(), "/"), -2).alias("file"))
    held = lines.groupBy("file").agg(F.count("*").alias("n"), F.sum(F.get_json_object("value", "$.o_orderkey").cast("long")).alias("keys"))
    return told.withColumnRenamed("o_orderstatus", "key").join(held, "file").select("key", "file", F.col("count").alias("n"), (F.col("count") - F.col("n")).alias("lost"), "keys")


def _multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = query_all(spark.read.parquet(f"{sf_dir}/customer.parquet"), "select c_custkey as k where c_acctbal < 0; select c_custkey as k where c_nationkey = 1")
    return a.unionByName(b)


def _rolling(by: list[str] | None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..streaming.tokens import rolling

        events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value")
        return rounded(rolling(events, "event_id", {"n": ("count", None), "s": ("sum", "value"), "lo": ("min", "value"), "hi": ("max", "value")}, by))

    return run


def _flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.json import flatten

    return flatten(json_events(spark, sf_dir)).select(F.col("_pos").alias("event_id"), "path", F.try_variant_get("value", "$", "double").alias("v"))


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as one nested document: (_pos, _raw, _v)."""
    from ..sources.json import allow_duplicates

    allow_duplicates(spark)
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    one = F.struct("turn", "role", (F.col("role") == "user").alias("asks"), F.when(F.col("turn") % 2 == 0, F.col("turn")).alias("even"))
    docs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    docs = docs.select(F.col("conv_id").alias("_pos"), F.to_json(F.struct("conv_id", "turns"), {"ignoreNullFields": "false"}).alias("_raw"))
    return docs.withColumn("_v", F.parse_json("_raw"))


def _scoped(text: str, columns: dict[str, str]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = query(_nested(spark, sf_dir), text)
        return out.select(*[F.try_variant_get(n, "$", t).alias(n) if dict(out.dtypes)[n] == "variant" else F.col(n).cast(t).alias(n) for n, t in columns.items()])

    return run


def _flat(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: flat_query(_nested(spark, sf_dir), text).select(F.col("_pos").alias("conv_id"), "path", F.to_json("value").alias("v"))


def _written(form: str) -> Callable[[SparkSession, str], DataFrame]:
    """customer through a sink and back through the source that reads its form."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..sources import json, sinks, text

        path = f"{Scratch(spark, form).base}/out"
        rows = query(spark.read.parquet(f"{sf_dir}/customer.parquet"), "select c_custkey, c_name, c_mktsegment as seg order by c_custkey")
        if form == "raw":
            sinks.write(rows.select("c_name"), path, "raw")
            return text.read_lines(spark, path).select("line", F.col("_n").cast("long").alias("n"))
        if form == "into":
            return query(rows, f"select c_custkey, c_name, seg into '{path}'").select("value")
        sinks.write(rows, path, form)
        if form == "ndjson":
            return _fields(query(json.read_ndjson(spark, path)[0], "select c_custkey, c_name, seg"))
        if form == "json":
            return _fields(query(json.read_array(spark, path), "select c_custkey, c_name, seg"))
        back = text.read_delimited(spark, path, "," if form == "csv" else "\t", header=True)
        return back.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "seg")

    return run


def _fields(out: DataFrame) -> DataFrame:
    return out.select(F.try_variant_get("c_custkey", "$", "long").alias("c_custkey"), *[F.try_variant_get(c, "$", "string").alias(c) for c in ("c_name", "seg")])


def _mixed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that are numbers become numbers, others stay text."""
    from ..sources.text import read_delimited

    path = f"{Scratch(spark, 'cells').base}/in"
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").orderBy("p_partkey")
    cell = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_brand"))
    parts.select(F.concat_ws(";", F.col("p_partkey").cast("string"), cell).alias("value")).write.text(path)
    got = query(read_delimited(spark, path, ";", columns=["k", "c"]), "select k, _n, type(c) as t, c + 1 as more")
    return got.select(F.col("k").cast("long").alias("k"), F.col("_n").cast("long").alias("n"), "t", "more")


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines counted in what tee, reject and out get; some lines are malformed."""
    from ..sources.sinks import route

    base = Scratch(spark, "route").base
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    bad = F.when(F.col("event_id") % 10 == 0, F.concat("props", F.lit("}"))).when(F.col("event_id") % 10 == 1, F.lit(" ")).otherwise(F.col("props"))
    route(events.select(bad.alias("value")), "select * where k > 50", *(f"{base}/{n}" for n in ("tee", "reject", "out")))
    counts = [spark.read.text(f"{base}/{n}").agg(F.count("*").alias("n")).select(F.lit(n).alias("to"), "n") for n in ("tee", "reject", "out")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def _preset(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """Turns as envelopes of a model's API, their fragments accumulated and checked."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..streaming.tokens import PRESETS, accumulate, expect, fragments, objects

        turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
        body = F.to_json(F.struct("turn", "role"))
        cut = turns.select("conv_id", F.posexplode(F.array(F.substring(body, 1, 7), body.substr(F.lit(8), F.length(body)))).alias("i", "f"), "turn")
        wrap = {
            "ollama": F.struct(F.lit("m").alias("model"), F.col("f").alias("response"), F.lit(False).alias("done")),
            "openai": F.struct(F.array(F.struct(F.struct(F.col("f").alias("content")).alias("delta"))).alias("choices")),
            "anthropic": F.struct(F.struct(F.col("f").alias("text")).alias("delta")),
        }[name]
        path, events = PRESETS[name]
        line = F.concat(F.lit("data: "), F.to_json(wrap)) if events else F.to_json(wrap)
        found = accumulate(fragments(cut.select("conv_id", (F.col("turn") * 2 + F.col("i")).alias("at"), line.alias("value")), path, events), "conv_id", "at")
        kept = objects(found).select("_raw", "_v", "_pos").filter(expect("turn:number, role:enum(user, system)"))
        return query(kept, "select role, count() as n group by role").select(F.try_variant_get("role", "$", "string").alias("role"), "n")

    return run


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.tokens import rolling_tables

    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "value")
    return rounded(rolling_tables(events, "event_id", "event_type", {"n": ("count", None), "s": ("sum", "value")}))


def _llm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's turns as fragments of one stream that spells JSON objects."""
    from ..streaming.tokens import accumulate

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    body = F.to_json(F.struct("turn", "role"))
    cut = turns.select("conv_id", F.posexplode(F.array(F.concat(F.lit("noise "), F.substring(body, 1, 5)), body.substr(F.lit(6), F.length(body)))).alias("i", "fragment"), "turn")
    return accumulate(cut.select("conv_id", (F.col("turn") * 2 + F.col("i")).alias("at"), "fragment"), "conv_id", "at").select("conv_id", "n", F.get_json_object("_raw", "$.role").alias("role"))


_FLAT_TURNS = "with t as (select *, row_number() over (partition by conv_id order by turn, role) - 1 as i from conversations) "
SPECIAL = {
    "json_path": (_dynamic_group, "select cast(json_extract(props, '$.k') as double) as k, count(*) as n, sum(cast(json_extract(props, '$.k') as double)) as s from events group by 1"),
    "json_where_raw": (_dynamic("where k > 50"), "select props as _raw from events where cast(json_extract(props, '$.k') as double) > 50"),
    "json_global": (_dynamic("select count() as n, min(k) as lo, max(k) as hi, count(nothere) as none where has(k)"), "select count(*) as n, min(cast(json_extract(props, '$.k') as double)) as lo, max(cast(json_extract(props, '$.k') as double)) as hi, 0 as none from events"),
    "flat_paths": (_flatten, "select event_id, 'k' as path, cast(json_extract(props, '$.k') as double) as v from events"),
    "reject_complement": (_reject, "select o_orderkey from orders where not (o_totalprice > 100000 and o_orderstatus = 'F')"),
    "split_counts": (_split_counts, "select o_orderstatus as key, o_orderstatus || '.jsonl' as file, count(*) as n, 0 as lost, sum(o_orderkey)::bigint as keys from orders group by 1, 2"),
    "multi_query_union": (_multi, "select c_custkey as k from customer where c_acctbal < 0 union all select c_custkey from customer where c_nationkey = 1"),
    "rolling_global": (_rolling(None), "select event_id, count(*) over (order by event_id rows unbounded preceding) as n, round(sum(value) over w, 4) as s, round(min(value) over w, 4) as lo, round(max(value) over w, 4) as hi from events window w as (order by event_id rows unbounded preceding)"),
    "rolling_group": (_rolling(["user_id"]), "select user_id, event_id, count(*) over (partition by user_id order by event_id rows unbounded preceding) as n, round(sum(value) over w, 4) as s, round(min(value) over w, 4) as lo, round(max(value) over w, 4) as hi from events window w as (partition by user_id order by event_id rows unbounded preceding)"),
    "rolling_tables": (
        _tables,
        "with r as (select *, row_number() over (order by event_id) as pos from events),"
        " g as (select event_type, pos, count(*) over w as n, sum(value) over w as s, lead(pos) over (partition by event_type order by event_id) as nxt from r window w as (partition by event_type order by event_id rows unbounded preceding))"
        ' select r.pos as "at", g.event_type, g.n, round(g.s, 4) as s from r join g on g.pos <= r.pos and coalesce(g.nxt, 9223372036854775807) > r.pos',
    ),
    "scope_array": (_scoped("[turns.*] select turn, role where turn > 0", {"turn": "long", "role": "string"}), "select turn, role from conversations where turn > 0"),
    "scope_auto": (_scoped("[*] select count() as n group by _array", {"_array": "string", "n": "long"}), "select 'turns' as _array, count(*) as n from conversations"),
    "equal_true": (_scoped("[turns.*] select turn, role where asks = true", {"turn": "long", "role": "string"}), "select turn, role from conversations where role = 'user'"),
    "equal_false": (_scoped("[turns.*] select turn, role where asks = false", {"turn": "long", "role": "string"}), "select turn, role from conversations where role <> 'user'"),
    "equal_null": (_scoped("[turns.*] select turn where even = null", {"turn": "long"}), "select turn from conversations where turn % 2 <> 0"),
    "dynamic_order": (_scoped("[turns.*] select role, count() as n where has(even) and turn >= 0 group by role order by role", {"role": "string", "n": "long"}), "select role, count(*) as n from conversations group by 1"),
    "flat_where": (_flat("where turns.*.turn >= 1"), _FLAT_TURNS + "select conv_id, 'turns.' || i || '.turn' as path, cast(turn as varchar) as v from t where turn >= 1"),
    "flat_select": (_flat("select turns.*.role"), _FLAT_TURNS + "select conv_id, 'turns.' || i || '.role' as path, '\"' || role || '\"' as v from t"),
    "flat_scope": (_flat("[turns.*] select role as who where turn >= 1 and role = 'user'"), _FLAT_TURNS + "select conv_id, 'turns.' || i || '.who' as path, '\"' || role || '\"' as v from t where turn >= 1 and role = 'user'"),
    "flat_auto": (_flat("[*] select asks where role = 'user' or turn < 1"), _FLAT_TURNS + "select conv_id, 'turns.' || i || '.asks' as path, case when role = 'user' then 'true' else 'false' end as v from t where role = 'user' or turn < 1"),
    "sink_csv": (_written("csv"), "select c_custkey, c_name, c_mktsegment as seg from customer"),
    "sink_tsv": (_written("tsv"), "select c_custkey, c_name, c_mktsegment as seg from customer"),
    "sink_ndjson": (_written("ndjson"), "select c_custkey, c_name, c_mktsegment as seg from customer"),
    "sink_json_array": (_written("json"), "select c_custkey, c_name, c_mktsegment as seg from customer"),
    "sink_raw": (_written("raw"), "select c_name as line, row_number() over (order by c_custkey) as n from customer"),
    "into_path": (_written("into"), """select '{"c_custkey": ' || c_custkey || ', "c_name": "' || c_name || '", "seg": "' || c_mktsegment || '"}' as value from customer"""),
    "delimited_cells": (_mixed_cells, "select p_partkey as k, row_number() over (order by p_partkey) as n, case when p_size % 2 = 0 then 'number' else 'string' end as t, case when p_size % 2 = 0 then cast(p_size + 1 as double) end as more from part"),
    "route_lines": (
        _routes,
        """with e as (select event_id % 10 as d, cast(json_extract(props, '$.k') as double) as k from events)
        select 'tee' as "to", count(*) as n from e where d <> 1 union all select 'reject', count(*) from e where d > 1 and k <= 50 union all select 'out', count(*) from e where d > 1 and k > 50""",
    ),
    **{f"preset_{n}": (_preset(n), "select role, count(*) as n from conversations where role in ('user', 'system') group by 1") for n in ("ollama", "openai", "anthropic")},
    "llm_accumulate": (_llm, "select conv_id, row_number() over (partition by conv_id order by turn) - 1 as n, role from conversations"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _run(n) for n in QUERIES} | {n: f for n, (f, _) in SPECIAL.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, _, sql) in QUERIES.items()} | {n: sql for n, (_, sql) in SPECIAL.items()}
