"""Aggregates and window functions."""

from __future__ import annotations

from tidemill.queries.base import Query, average, day, m, total

Q, P = m("l_quantity"), m("l_extendedprice")
BIG = "row_number() over (partition by o_custkey order by o_orderdate, o_orderkey)"

QUERIES = [
    Query("agg_group_sum_avg", f"select l_returnflag, l_linestatus, {total(Q)} as sum_qty, {average(P)} as avg_price, count(*) as n from lineitem group by l_returnflag, l_linestatus"),
    Query("agg_char_key", "select l_returnflag, count(*) as n from lineitem group by l_returnflag"),
    Query("agg_keys_only", "select l_returnflag, l_linestatus from lineitem group by l_returnflag, l_linestatus"),
    Query("agg_ungrouped", f"select {total(Q)} as q, {average(P)} as a, count(*) as n, cast(min({P}) as double) as lo, cast(max({P}) as double) as hi from lineitem"),
    Query("agg_empty_input", f"select {total(Q)} as q, count(*) as n, count(l_quantity) as nq, min(l_orderkey) as lo, max(l_returnflag) as hi from lineitem where l_quantity < 0"),
    Query("agg_empty_grouped", f"select l_returnflag, count(*) as n from lineitem where l_quantity < 0 group by l_returnflag"),
    Query("agg_count_col", "select o_custkey, count(v) as n_v, count(*) as n from (select o_custkey, nullif(o_orderstatus, 'F') as v from orders) o group by o_custkey"),
    Query("agg_count_distinct", "select l_suppkey, count(distinct l_partkey) as parts from lineitem group by l_suppkey"),
    Query("agg_mixed_distinct", f"select l_returnflag, count(distinct l_partkey) as parts, count(l_partkey) as n, count(distinct l_suppkey) as supps, {total(Q)} as q from lineitem group by l_returnflag"),
    Query("agg_sum_distinct", "select l_returnflag, cast(sum(distinct l_linenumber) as bigint) as s, cast(min(distinct l_linenumber) as bigint) as lo, cast(avg(distinct l_linenumber) as double) as a from lineitem group by l_returnflag"),
    Query("agg_min_max", f"select o_custkey, min({day('o_orderdate')}) as first_day, max({day('o_orderdate')}) as last_day, min(o_orderpriority) as lo, max(o_orderstatus) as hi, cast(max({m('o_totalprice')}) as double) as top from orders group by o_custkey"),
    Query("agg_conditional_sum", f"select l_suppkey, {total(f'case when l_returnflag = {chr(39)}R{chr(39)} then {P} else 0 end')} as returned, cast(sum(case when l_quantity > 25 then 1 else 0 end) as bigint) as big from lineitem group by l_suppkey"),
    Query("agg_expression_argument", f"select l_linestatus, cast(sum({P} * (1 - {m('l_discount')}) * (1 + {m('l_tax')})) as double) as charge from lineitem group by l_linestatus"),
    Query("agg_having", f"select l_orderkey, {total(Q)} as q from lineitem group by l_orderkey having sum({Q}) > 250 and count(*) > 3"),
    Query("agg_of_agg", "select n, count(*) as customers from (select o_custkey, count(*) as n from orders group by o_custkey) o group by n"),
    Query("agg_group_by_expr", f"select cast(extract(year from o_orderdate) as int) as y, substring(o_orderpriority, 1, 1) as p, count(*) as n from orders group by cast(extract(year from o_orderdate) as int), substring(o_orderpriority, 1, 1)"),
    Query("agg_null_keys", "select k, count(*) as n from (select nullif(c_mktsegment, 'BUILDING') as k from customer) c group by k"),
    Query("agg_rollup", f"select l_returnflag, l_linestatus, {total(Q)} as q, cast(grouping(l_returnflag) + grouping(l_linestatus) as bigint) as lvl from lineitem group by rollup (l_returnflag, l_linestatus)"),
    Query("agg_cube", f"select l_returnflag, l_linestatus, {total(Q)} as q from lineitem group by cube (l_returnflag, l_linestatus)"),
    Query("agg_grouping_sets", "select o_orderstatus, o_orderpriority, count(*) as n, cast(grouping(o_orderstatus) as bigint) as gs from orders group by grouping sets ((o_orderstatus, o_orderpriority), (o_orderpriority), ())"),
    Query("agg_filter_clause", f"select l_suppkey, count(*) filter (where l_returnflag = 'R') as r, cast(sum({Q}) filter (where l_linestatus = 'O') as double) as open_qty from lineitem group by l_suppkey"),
    Query("agg_statistics", "select l_returnflag, round(stddev_samp(l_linenumber), 6) as sd, round(var_pop(l_linenumber), 6) as vp, bool_and(l_quantity > 0) as all_pos, bool_or(l_quantity > 49) as any_big from lineitem group by l_returnflag"),
    Query("agg_string_list", "select n_regionkey, concat_ws(',', sort_array(collect_list(n_name))) as names from nation group by n_regionkey", "select n_regionkey, string_agg(n_name, ',' order by n_name) as names from nation group by n_regionkey"),
    Query("agg_percentile", "select l_returnflag, percentile(l_linenumber, 0.5) as med from lineitem group by l_returnflag", "select l_returnflag, cast(quantile_cont(l_linenumber, 0.5) as double) as med from lineitem group by l_returnflag"),
    Query("win_row_number", f"select o_orderkey, o_custkey, cast({BIG} as bigint) as rn from orders"),
    Query("win_rank_dense", "select p_partkey, cast(rank() over (partition by p_brand order by p_size desc) as bigint) as rk, cast(dense_rank() over (partition by p_brand order by p_size desc) as bigint) as dr from part"),
    Query("win_percent_cume", "select p_partkey, percent_rank() over (partition by p_type order by p_size) as pr, cume_dist() over (partition by p_type order by p_size) as cd from part"),
    Query("win_running_sum", f"select o_orderkey, cast(sum({m('o_totalprice')}) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and current row) as double) as running, cast(sum({m('o_totalprice')}) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and 1 following) as double) as near from orders"),
    Query("win_range_frame", "select p_partkey, count(*) over (partition by p_brand order by p_size range between 2 preceding and 2 following) as n from part"),
    Query("win_lag_lead", "select o_orderkey, lag(o_orderkey, 1) over w as prev, lead(o_orderkey, 2, -1) over w as nxt, cast(ntile(4) over w as bigint) as tile, first_value(o_orderkey) over w as fst from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)"),
    Query("win_nth_value", "select o_orderkey, nth_value(o_orderkey, 2) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and unbounded following) as second from orders"),
    Query("win_two_specs", f"select c_custkey, cast(rank() over (partition by c_nationkey order by {m('c_acctbal')} desc, c_custkey) as bigint) as in_nation, cast(rank() over (partition by c_mktsegment order by {m('c_acctbal')} desc, c_custkey) as bigint) as in_segment from customer"),
    Query("win_expression", f"select c_custkey, cast({m('c_acctbal')} as double) - cast(max({m('c_acctbal')}) over (partition by c_nationkey) as double) as gap from customer"),
    Query("win_top_per_group", f"select o_custkey, o_orderkey from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by {m('o_totalprice')} desc, o_orderkey) as rn from orders) o where rn <= 2"),
    Query("agg_array", "select n_regionkey, array_join(transform(sort_array(array_agg(n_nationkey)), x -> cast(x as string)), ',') as ks from nation group by n_regionkey", "select n_regionkey, array_to_string(list_sort(array_agg(n_nationkey)), ',') as ks from nation group by n_regionkey"),
    Query("agg_two_arguments", "select l_returnflag, round(corr(l_quantity, l_extendedprice), 6) as r, round(covar_pop(l_quantity, l_linenumber), 6) as cp, round(covar_samp(l_quantity, l_linenumber), 6) as cs, round(regr_slope(l_extendedprice, l_quantity), 4) as slope from lineitem group by l_returnflag"),
    Query("agg_max_by", "select o_custkey, max_by(o_orderstatus, o_orderkey) as last, min_by(o_orderpriority, o_orderkey) as first from orders group by o_custkey"),
    # Beside count(distinct) Spark keeps a sketch for each key; above distinct rows it keeps one a group, with the same bits, as repeats don't change it.
    Query("agg_approximate", "select l_returnflag, abs(approx_count_distinct(l_partkey) - count(l_partkey)) <= 0.2 * count(l_partkey) as near from (select distinct l_returnflag, l_partkey from lineitem) t group by l_returnflag", "select l_returnflag, abs(approx_count_distinct(l_partkey) - count(distinct l_partkey)) <= 0.2 * count(distinct l_partkey) as near from lineitem group by l_returnflag"),
    Query("agg_approximate_percentile", "select l_returnflag, abs(approx_percentile(l_quantity, 0.5) - percentile(l_quantity, 0.5)) <= 2 as near from lineitem group by l_returnflag", "select l_returnflag, abs(approx_quantile(l_quantity, 0.5) - quantile_cont(l_quantity, 0.5)) <= 2 as near from lineitem group by l_returnflag"),
    Query("agg_min_by_group_generated", "select cast(g as bigint) as grp, cast(min(v) as double) as lo from (select id % 4 as g, cast(id % 1000 + 100 as decimal(15,2)) as v from range(1, 200001) union all select g, cast(v as decimal(15,2)) from (values (0, 5), (1, 7), (2, 9), (3, 11)) x(g, v)) t group by g", "select cast(g as bigint) as grp, cast(min(v) as double) as lo from (select range % 4 as g, cast(range % 1000 + 100 as decimal(15,2)) as v from range(1, 200001) union all select g, cast(v as decimal(15,2)) from (values (0, 5), (1, 7), (2, 9), (3, 11)) x(g, v)) t group by g"),
    Query("win_groups_frame", "select p_partkey, count(*) over (partition by p_brand order by d range between 1 preceding and 1 following) as n from (select p_partkey, p_brand, dense_rank() over (partition by p_brand order by p_size) as d from part) x", "select p_partkey, count(*) over (partition by p_brand order by p_size groups between 1 preceding and 1 following) as n from part"),
    Query("win_exclude_current", f"select o_orderkey, cast(sum({m('o_totalprice')}) over w - {m('o_totalprice')} as double) as others, count(*) over w - 1 as n from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and 2 following)", f"select o_orderkey, coalesce(cast(sum({m('o_totalprice')}) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and 2 following exclude current row) as double), 0) as others, count(*) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and 2 following exclude current row) as n from orders"),
]
