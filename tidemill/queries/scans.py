"""Scans, projections, predicates, scalar expressions, sort and limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions import money, prefix, safe_divide
from tidemill.operators import with_ties
from tidemill.plans import run
from tidemill.queries.base import Query, day, m
from tidemill.sources import Catalog, register
from tidemill.streaming import hourly

LINE = f"l_orderkey, l_linenumber, {m('l_quantity')} as quantity, {m('l_extendedprice')} as price"


def _safe_divide(t: Catalog) -> DataFrame:
    p, d = money("l_extendedprice"), money("l_discount")
    return t.lineitem.groupBy("l_orderkey").agg(safe_divide(F.sum(p).cast("double"), F.sum(d).cast("double")).alias("ratio"))


def _prefix_in(t: Catalog) -> DataFrame:
    return t.customer.filter(prefix(F.col("c_mktsegment"), 2).isin("AU", "BU")).select("c_custkey", prefix(F.col("c_mktsegment"), 4).alias("seg"))


def _with_ties(t: Catalog) -> DataFrame:
    per_part = t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return with_ties(per_part, [("n", "desc")], 25)


def _events_hourly(t: Catalog) -> DataFrame:
    return hourly(t.events).select(F.col("hour").cast("string").alias("hour"), "event_type", "n")


def _parameters(t: Catalog) -> DataFrame:
    register(t.spark, t.sf_dir, "part")
    return run(t.spark, "select p_partkey, p_name from part where p_size between :low and :high and p_type = :kind", low=5, high=20, kind="PROMO")


QUERIES = [
    Query("scan_select_star", "select * from nation"),
    Query("scan_pruned_filter", f"select {LINE} from lineitem where l_quantity >= 45 and l_shipdate >= timestamp '1998-01-01 00:00:00'"),
    Query("scan_subquery", f"select k, p from (select l_orderkey as k, {m('l_extendedprice')} as p, l_tax from lineitem) s where p > 90000"),
    Query("scan_no_table", "select 1 as one, 'x' as letter"),
    Query("scan_values", "select a, b from (values (1, 'x'), (2, 'y')) v(a, b)"),
    Query("scan_recursive_cte", "with recursive c(n) as (select 1 union all select n + 1 from c where n < 20) select cast(n as bigint) as n, cast(n * n as bigint) as sq from c"),
    Query("filter_compare_const", f"select {LINE} from lineitem where l_quantity < 3 and 60000 > l_extendedprice and l_returnflag = 'R' and l_linestatus <> 'F'"),
    Query("filter_compare_columns", "select l_orderkey, l_partkey, l_suppkey from lineitem where l_partkey < l_suppkey and l_orderkey >= l_partkey"),
    Query("filter_compare_double", "select l_orderkey, cast(l_quantity as bigint) as q from lineitem where l_extendedprice > l_quantity * 1900.0"),
    Query("filter_between", f"select {LINE} from lineitem where l_discount between 0.045 and 0.065 and l_quantity between 10 and 12"),
    Query("filter_in_list", "select p_partkey, p_brand, p_size from part where p_size in (1, 7, 23, 49) and p_brand in ('Brand#11', 'Brand#23', 'Brand#45')"),
    Query("filter_not_in_list", "select p_partkey, p_type from part where p_type not in ('ECONOMY', 'PROMO', 'SMALL') and p_size not in (3, 4, 5)"),
    Query("filter_like_prefix", "select p_partkey, p_name from part where p_name like 'red%'"),
    Query("filter_like_contains", "select p_partkey, p_name from part where p_name like '%o%t%'"),
    Query("filter_like_suffix", "select p_partkey, p_name from part where p_name like '%bolt'"),
    Query("filter_like_exact", "select n_nationkey, n_name from nation where n_name like 'NATION_0'"),
    Query("filter_not_like", "select p_partkey, p_name from part where p_name not like '%bolt%'"),
    Query("filter_like_underscore", "select n_nationkey, n_name from nation where n_name like 'NATION__'"),
    Query("filter_ilike_regex", "select p_partkey, p_name from part where p_name ilike 'RED%' or regexp_like(p_name, '^b[a-z]+ [a-c]')", "select p_partkey, p_name from part where p_name ilike 'RED%' or regexp_matches(p_name, '^b[a-z]+ [a-c]')"),
    Query("filter_prefix_slice_in", _prefix_in, "select c_custkey, substring(c_mktsegment, 1, 4) as seg from customer where substring(c_mktsegment, 1, 2) in ('AU', 'BU')"),
    Query("filter_bool_logic", f"select {LINE} from lineitem where (l_returnflag = 'A' and not (l_quantity < 40 or l_linestatus = 'O')) or (l_returnflag = 'N' and l_quantity > 49)"),
    Query("filter_bool_column", "select p_partkey, big from (select p_partkey, p_size > 40 as big from part) p where big"),
    Query("filter_null_tests", "select k, v is null as no_v, (v > 0) is true as pos, (v > 0) is not false as maybe, (v > 0) is unknown as unk from (select c_custkey as k, case when c_custkey % 3 = 0 then null else c_acctbal end as v from customer) c where v is null or v > 9000", "select k, v is null as no_v, (v > 0) is true as pos, (v > 0) is not false as maybe, (v > 0) is null as unk from (select c_custkey as k, case when c_custkey % 3 = 0 then null else c_acctbal end as v from customer) c where v is null or v > 9000"),
    Query("filter_is_distinct_from", "select o_orderkey, a, b from (select o_orderkey, nullif(o_orderstatus, 'F') as a, nullif(o_orderstatus, 'O') as b from orders) o where a is distinct from b"),
    Query("filter_is_not_distinct_from", "select o_orderkey from (select o_orderkey, nullif(o_orderstatus, 'P') as a, nullif(substring(o_orderpriority, 1, 1), '1') as b from orders) o where a is not distinct from b"),
    Query("filter_row_compare", "select p_partkey from part where struct(p_brand, p_size) = struct('Brand#23', 15) or (p_size < 3)", "select p_partkey from part where (p_brand, p_size) = ('Brand#23', 15) or (p_size < 3)"),
    Query("filter_date_const", f"select o_orderkey, {day('o_orderdate')} as d from orders where {day('o_orderdate')} >= date '1997-01-31' + interval '1' month and {day('o_orderdate')} < date '1997-03-01' + interval '10' day"),
    Query("project_arith", f"select l_orderkey, l_linenumber, cast({m('l_extendedprice')} * (1 - {m('l_discount')}) as double) as net, cast({m('l_extendedprice')} + {m('l_tax')} - 1 as double) as shifted, -l_linenumber as neg, l_partkey % 7 as r, abs(l_linenumber - 4) as dist from lineitem where l_quantity > 48"),
    Query("project_const", "select n_nationkey, 1 as i, 'text' as s, true as b, cast(null as int) as nothing from nation"),
    Query("project_safe_divide", _safe_divide, f"select l_orderkey, cast(sum({m('l_extendedprice')}) as double) / nullif(cast(sum({m('l_discount')}) as double), 0) as ratio from lineitem group by l_orderkey"),
    Query("project_case_multi", "select p_partkey, case when p_size < 10 then 'small' when p_size < 30 then 'medium' when p_size < 45 then 'large' else 'huge' end as band, case p_type when 'PROMO' then 1 when 'SMALL' then 2 end as code from part"),
    Query("project_bool", "select n_nationkey, n_regionkey = 1 as is_one, n_name like '%1' as ends_one from nation"),
    Query("project_extract_year", f"select o_orderkey, cast(extract(year from o_orderdate) as int) as y, cast(extract(month from o_orderdate) as int) as mo, cast(extract(day from o_orderdate) as int) as dd, cast(extract(quarter from o_orderdate) as int) as qq from orders where o_totalprice > 400000"),
    Query("project_date_interval", f"select o_orderkey, cast({day('o_orderdate')} + interval '1' month as date) as next_month, cast({day('o_orderdate')} - interval '90' day as date) as earlier, cast(date_trunc('month', o_orderdate) as date) as month_start, cast(datediff(date '2001-01-01', {day('o_orderdate')}) as bigint) as age from orders", f"select o_orderkey, cast({day('o_orderdate')} + interval '1' month as date) as next_month, cast({day('o_orderdate')} - interval '90' day as date) as earlier, cast(date_trunc('month', o_orderdate) as date) as month_start, cast(date_diff('day', {day('o_orderdate')}, date '2001-01-01') as bigint) as age from orders"),
    Query("project_substring", "select c_custkey, substring(c_mktsegment, 1, 3) as head, substr(c_name, 10, 4) as mid, upper(c_mktsegment) as up, lower(c_mktsegment) as low, cast(length(c_name) as bigint) as len, concat(c_mktsegment, '-', c_name) as both, trim('  x ') as trimmed, replace(c_mktsegment, 'E', 'e') as swapped from customer"),
    Query("project_coalesce_nullif", "select o_orderkey, coalesce(nullif(o_orderstatus, 'O'), 'open') as st, greatest(o_orderkey, o_custkey) as hi, least(o_orderkey, o_custkey) as lo from orders"),
    Query("project_cast", "select p_partkey, cast(p_size as string) as s, cast(cast(p_size as string) as int) as i, cast(p_retailprice as decimal(15,2)) as d, cast(p_partkey as double) as f from part", "select p_partkey, cast(p_size as varchar) as s, cast(cast(p_size as varchar) as int) as i, cast(p_retailprice as decimal(15,2)) as d, cast(p_partkey as double) as f from part"),
    Query("project_math", "select p_partkey, cast(floor(p_retailprice / 100) as bigint) as f, cast(ceil(p_retailprice / 100) as bigint) as c, sqrt(cast(p_size as double)) as sq, power(cast(p_size as double), 2.0) as pw from part", "select p_partkey, cast(floor(p_retailprice / 100) as bigint) as f, cast(ceil(p_retailprice / 100) as bigint) as c, sqrt(cast(p_size as double)) as sq, power(cast(p_size as double), 2.0) as pw from part"),
    Query("sort_mixed_limit", f"select o_orderpriority, {m('o_totalprice')} as price, o_orderkey from orders order by o_orderpriority asc nulls last, price desc nulls last, o_orderkey asc limit 50"),
    Query("sort_nulls_order", "select k, v from (select c_custkey as k, nullif(c_mktsegment, 'BUILDING') as v from customer) c order by v desc nulls last, k limit 40"),
    Query("sort_alias_ordinal", f"select c_nationkey as nk, cast(count(*) as bigint) as n from customer group by c_nationkey order by 2 desc, nk limit 10"),
    Query("topn", f"select l_orderkey, l_partkey, l_suppkey, {m('l_extendedprice')} as price from lineitem order by price desc, l_orderkey, l_partkey, l_suppkey limit 20"),
    Query("limit_zero", "select n_nationkey from nation limit 0"),
    Query("limit_offset", f"select o_orderkey, {m('o_totalprice')} as price from orders order by price desc, o_orderkey limit 15 offset 30"),
    Query("with_ties", _with_ties, "select l_partkey, n from (select l_partkey, count(*) as n, rank() over (order by count(*) desc) as r from lineitem group by l_partkey) t where r <= 25"),
    Query("events_hourly", _events_hourly, "select cast(date_trunc('hour', ts) as varchar) as hour, event_type, count(*) as n from events group by 1, 2"),
    Query("events_json_field", "select event_id, get_json_object(props, '$.k') as k from events where event_type = 'purchase'", "select event_id, json_extract_string(props, '$.k') as k from events where event_type = 'purchase'"),
    Query("scan_range_function", "select id as n, id * id as sq from range(1, 50)", "select range as n, range * range as sq from range(1, 50)"),
    Query("scan_explode_function", "select p_partkey, w from part lateral view explode(split(p_name, ' ')) t as w", "select p_partkey, unnest(string_split(p_name, ' ')) as w from part"),
    Query("filter_any_array", "select p_partkey, p_size from part where array_contains(array(1, 7, 23, 49), p_size)", "select p_partkey, p_size from part where p_size = any([1, 7, 23, 49])"),
    Query("filter_all_array", "select p_partkey, p_type from part where not array_contains(array('ECONOMY', 'PROMO'), p_type)", "select p_partkey, p_type from part where p_type <> all(['ECONOMY', 'PROMO'])"),
    Query("filter_similar_to", "select p_partkey, p_name from part where p_name rlike '^(?:(red|blue) [a-c].*)$'", "select p_partkey, p_name from part where p_name similar to '(red|blue) [a-c].*'"),
    Query("filter_row_order", "select p_partkey from part where struct(p_brand, p_size) >= struct('Brand#34', 25) and struct(p_type, p_size) < struct('PROMO', 10)", "select p_partkey from part where (p_brand, p_size) >= ('Brand#34', 25) and (p_type, p_size) < ('PROMO', 10)"),
    Query("filter_collate", "select p_partkey, p_name from part where p_name collate UTF8_LCASE = 'RED BOLT'", "select p_partkey, p_name from part where p_name collate nocase = 'RED BOLT'"),
    Query("filter_parameters", _parameters, "select p_partkey, p_name from part where p_size between 5 and 20 and p_type = 'PROMO'"),
    Query("project_trigonometry", "select p_partkey, round(sin(p_size), 9) as s, round(cos(p_size), 9) as c, round(atan2(p_size, 3), 9) as a, round(ln(p_size + 1), 9) as l, round(exp(p_size / 50.0D), 9) as e, cast(round(cast(p_retailprice as decimal(15,2)), 1) as double) as r, sign(p_size - 25) as sg from part", "select p_partkey, round(sin(p_size), 9) as s, round(cos(p_size), 9) as c, round(atan2(p_size, 3), 9) as a, round(ln(p_size + 1), 9) as l, round(exp(p_size / 50.0), 9) as e, cast(round(cast(p_retailprice as decimal(15,2)), 1) as double) as r, cast(sign(p_size - 25) as double) as sg from part"),
    Query("project_now", "select n_nationkey, now() > timestamp '2020-01-01 00:00:00' as later, current_date >= date '2020-01-01' as today from nation", "select n_nationkey, cast(now() as timestamp) > timestamp '2020-01-01 00:00:00' as later, current_date >= date '2020-01-01' as today from nation"),
    Query("project_to_char", "select o_orderkey, date_format(o_orderdate, 'yyyy-MM-dd HH:mm') as d, lpad(cast(o_custkey as string), 8, '0') as k from orders", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M') as d, lpad(cast(o_custkey as varchar), 8, '0') as k from orders"),
    Query("project_position", "select p_partkey, cast(position('o' in p_name) as bigint) as at, left(p_name, 3) as l, right(p_name, 2) as r, reverse(p_type) as rev, split_part(p_name, ' ', 2) as second, cast(ascii(p_name) as bigint) as code from part"),
    Query("project_narrow_casts", "select p_partkey, cast(p_size as smallint) as i2, cast(cast(p_size as float) / 4 as double) as f4, rpad(substring(p_type, 1, 6), 6, ' ') as c6 from part", "select p_partkey, cast(p_size as smallint) as i2, cast(cast(p_size as float) / 4 as double) as f4, rpad(substring(p_type, 1, 6), 6, ' ') as c6 from part"),
    Query("project_array", "select p_partkey, array(p_size, 3, 7)[0] as first, cast(size(array(p_size, 3, 7)) as bigint) as n, array_contains(array(p_size, 3, 7), 7) as has, cast(array_max(array(p_size, 3, 7)) as bigint) as top, array_join(sort_array(split(p_name, ' ')), '|') as words from part", "select p_partkey, [p_size, 3, 7][1] as first, len([p_size, 3, 7]) as n, list_contains([p_size, 3, 7], 7) as has, cast(list_max([p_size, 3, 7]) as bigint) as top, array_to_string(list_sort(string_split(p_name, ' ')), '|') as words from part"),
    Query("project_map_json", "select p_partkey, map('size', p_size, 'half', p_size div 2)['half'] as half, get_json_object(concat('{\"a\": {\"b\": ', p_size, '}}'), '$.a.b') as b from part", "select p_partkey, map {'size': p_size, 'half': p_size // 2}['half'] as half, json_extract_string('{\"a\": {\"b\": ' || p_size || '}}', '$.a.b') as b from part"),
]
