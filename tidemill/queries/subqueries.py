"""Subqueries of every form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions import money
from tidemill.operators import quantified, top_per_group
from tidemill.queries.base import Query, m, total
from tidemill.sources import Catalog

PRICE = m("o_totalprice")


def _any_lt(t: Catalog) -> DataFrame:
    sub = t.supplier.filter(F.col("s_nationkey") < 5)
    return quantified(t.customer, F.col("c_acctbal"), "<", "ANY", sub, "s_acctbal").select("c_custkey")


def _all_ge(t: Catalog) -> DataFrame:
    sub = t.supplier.filter(F.col("s_nationkey") < 5)
    return quantified(t.customer, F.col("c_acctbal"), ">=", "ALL", sub, "s_acctbal").select("c_custkey")


def _all_correlated(t: Catalog) -> DataFrame:
    return quantified(t.orders, money("o_totalprice"), ">=", "ALL", t.orders.withColumn("p", money("o_totalprice")), "p", on=[("o_custkey", "o_custkey")]).select("o_orderkey")


def _any_equal(t: Catalog) -> DataFrame:
    return quantified(t.nation, F.col("n_nationkey"), "=", "ANY", t.supplier.filter(F.col("s_acctbal") > 5000), "s_nationkey").select("n_nationkey")


def _all_distinct(t: Catalog) -> DataFrame:
    return quantified(t.nation, F.col("n_nationkey"), "<>", "ALL", t.supplier.filter(F.col("s_acctbal") > 5000), "s_nationkey").select("n_nationkey")


def _all_equal(t: Catalog) -> DataFrame:
    return quantified(t.nation, F.col("n_regionkey"), "=", "ALL", t.supplier.select((F.col("s_suppkey") % 1 + 2).cast("int").alias("v")), "v").select("n_nationkey")


def _any_distinct(t: Catalog) -> DataFrame:
    sub = t.supplier.select("s_nationkey", (F.col("s_nationkey") % 2).cast("int").alias("v"))
    return quantified(t.nation, F.col("n_regionkey"), "<>", "ANY", sub, "v", on=[("n_nationkey", "s_nationkey")]).select("n_nationkey")


def _dearest(t: Catalog, n: int) -> DataFrame:
    """The n dearest orders of each customer.

    Spark runs a correlated LIMIT whose ORDER BY columns aren't selected as a row number without an order, above a sort
    that the shuffle by key undoes. Here the window states the order, with NULLs last on both columns as in the SQL's engine.
    """
    order = [F.desc_nulls_last("o_totalprice"), F.asc_nulls_last("o_orderkey")]
    return top_per_group(t.orders.filter(F.col("o_custkey").isNotNull()), ["o_custkey"], order, n).select("o_custkey", "o_orderkey")


def _dearest_one(t: Catalog) -> DataFrame:
    return t.customer.join(_dearest(t, 1), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("o_orderkey").alias("best"))


def _dearest_two(t: Catalog) -> DataFrame:
    return t.customer.join(_dearest(t, 2), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey")


QUERIES = [
    Query("sub_exists", "select c_custkey from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_totalprice > 350000)"),
    Query("sub_not_exists", "select c_custkey from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_orderstatus = 'P')"),
    Query("sub_exists_nonequi", "select l1.l_orderkey, l1.l_suppkey from lineitem l1 where l1.l_quantity > 45 and exists (select 1 from lineitem l2 where l2.l_orderkey = l1.l_orderkey and l2.l_suppkey <> l1.l_suppkey) and not exists (select 1 from lineitem l3 where l3.l_orderkey = l1.l_orderkey and l3.l_suppkey <> l1.l_suppkey and l3.l_returnflag = 'R')"),
    Query("sub_exists_in_or", "select c_custkey from customer c where c_acctbal > 9000 or exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_totalprice > 400000)"),
    Query("sub_exists_projected", "select n_nationkey, exists (select 1 from supplier s where s.s_nationkey = n.n_nationkey and s.s_acctbal > 8000) as rich from nation n"),
    Query("sub_in", "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'FURNITURE')"),
    Query("sub_in_correlated", "select o_orderkey from orders o where o_orderkey in (select l_orderkey from lineitem l where l.l_suppkey < o.o_custkey and l.l_quantity > 49)"),
    Query("sub_not_in", "select n_nationkey from nation where n_nationkey not in (select s_nationkey from supplier where s_acctbal > 5000)"),
    Query("sub_not_in_with_null", "select n_nationkey from nation where n_nationkey not in (select nullif(s_nationkey, 3) from supplier)"),
    Query("sub_in_multi_column", "select l_orderkey, l_linenumber from lineitem where (l_orderkey, l_linenumber) in (select o_orderkey, cast(1 as int) from orders where o_totalprice > 300000)"),
    Query("sub_quantified_any", _any_lt, "select c_custkey from customer where c_acctbal < any (select s_acctbal from supplier where s_nationkey < 5)"),
    Query("sub_quantified_all", _all_ge, "select c_custkey from customer where c_acctbal >= all (select s_acctbal from supplier where s_nationkey < 5)"),
    Query("sub_quantified_all_correlated", _all_correlated, f"select o_orderkey from orders o where {PRICE} >= all (select {m('i.o_totalprice')} from orders i where i.o_custkey = o.o_custkey)"),
    Query("sub_quantified_eq_any", _any_equal, "select n_nationkey from nation where n_nationkey = any (select s_nationkey from supplier where s_acctbal > 5000)"),
    Query("sub_quantified_ne_all", _all_distinct, "select n_nationkey from nation where n_nationkey <> all (select s_nationkey from supplier where s_acctbal > 5000)"),
    Query("sub_scalar_uncorrelated", f"select o_orderkey from orders where {PRICE} > (select max({PRICE}) * 0.8 from orders)"),
    Query("sub_scalar_correlated", f"select l_orderkey, l_partkey from lineitem l where {m('l_quantity')} * 5 < (select sum({m('i.l_quantity')}) / count(*) from lineitem i where i.l_partkey = l.l_partkey)", f"select l_orderkey, l_partkey from lineitem l where {m('l_quantity')} * 5 < (select cast(sum({m('i.l_quantity')}) as double) / count(*) from lineitem i where i.l_partkey = l.l_partkey)"),
    Query("sub_scalar_in_select", "select n_nationkey, (select max(c_custkey) from customer c where c.c_nationkey = n.n_nationkey and c.c_acctbal > 9900) as top from nation n"),
    Query("sub_scalar_count_zero", "select n_nationkey, (select count(*) from supplier s where s.s_nationkey = n.n_nationkey and s.s_acctbal > 9000) as n from nation n"),
    Query("sub_scalar_having", f"select l_suppkey, {total(m('l_extendedprice'))} as rev from lineitem group by l_suppkey having sum({m('l_extendedprice')}) > (select sum({m('l_extendedprice')}) / 90 from lineitem)"),
    Query("sub_correlated_topn", _dearest_one, "select c_custkey, (select o_orderkey from orders o where o.o_custkey = c.c_custkey order by o_totalprice desc, o_orderkey limit 1) as best from customer c"),
    Query("sub_lateral", _dearest_two, "select c.c_custkey, t.o_orderkey from customer c, lateral (select o_orderkey from orders o where o.o_custkey = c.c_custkey order by o_totalprice desc, o_orderkey limit 2) t"),
    Query("sub_derived_grouped", f"select c.c_mktsegment, cast(sum(t.n) as bigint) as n from customer c join (select o_custkey, count(*) as n from orders group by o_custkey) t on c.c_custkey = t.o_custkey group by c.c_mktsegment"),
    Query("cte_reused", "with o as (select o_custkey, count(*) as n from orders group by o_custkey) select a.o_custkey from o a where a.n = (select max(n) from o)"),
    Query("cte_nested", "with a as (select c_custkey, c_nationkey from customer where c_acctbal > 0), b as (select c_nationkey, count(*) as n from a group by c_nationkey) select b.c_nationkey, b.n from b where exists (select 1 from a where a.c_nationkey = b.c_nationkey)"),
    Query("cte_correlation_keys", "select k.o_custkey, count(*) as n from (select distinct o_custkey from orders where o_totalprice > 300000) k join orders o on o.o_custkey = k.o_custkey group by k.o_custkey"),
    Query("sub_scalar_order_by", "select n_nationkey from (select n_nationkey, (select count(*) from supplier s where s.s_nationkey = n.n_nationkey) as k from nation n) t order by k desc, n_nationkey limit 7", "select n_nationkey from nation n order by (select count(*) from supplier s where s.s_nationkey = n.n_nationkey) desc, n_nationkey limit 7"),
    Query("sub_scalar_group_by", "select rn, count(*) as n from (select (select r_name from region r where r.r_regionkey = t.n_regionkey) as rn from nation t) x group by rn", "select (select r_name from region r where r.r_regionkey = t.n_regionkey) as rn, count(*) as n from nation t group by 1"),
    Query("sub_scalar_window_key", "select c_custkey, cast(row_number() over (partition by reg order by c_custkey) as bigint) as rn from (select c_custkey, (select n_regionkey from nation n where n.n_nationkey = c.c_nationkey) as reg from customer c) x", "select c_custkey, cast(row_number() over (partition by (select n_regionkey from nation n where n.n_nationkey = c.c_nationkey) order by c_custkey) as bigint) as rn from customer c"),
    Query("sub_correlated_union", "select c_custkey, (select count(*) from (select o_orderkey as k from orders o where o.o_custkey = c.c_custkey union all select s_suppkey as k from supplier s where s.s_nationkey = c.c_nationkey) u) as n from customer c"),
    Query("sub_correlated_distinct", "select n_nationkey, (select count(*) from (select distinct c_mktsegment from customer c where c.c_nationkey = n.n_nationkey and c.c_acctbal > 8000) t) as segments from nation n"),
    Query("sub_correlated_group_by", "select c_custkey from customer c where exists (select o_orderstatus from orders o where o.o_custkey = c.c_custkey group by o_orderstatus having count(*) > 5)"),
    Query("sub_correlated_outer_join", "select n_nationkey, (select count(c.c_custkey) from supplier s left join customer c on c.c_nationkey = s.s_nationkey and c.c_acctbal > 9000 where s.s_nationkey = n.n_nationkey) as n from nation n"),
    Query("sub_array", "select n_nationkey, coalesce((select array_join(transform(sort_array(collect_list(s_suppkey)), x -> cast(x as string)), ',') from supplier s where s.s_nationkey = n.n_nationkey), '') as supps from nation n", "select n_nationkey, array_to_string(list_sort(array(select s_suppkey from supplier s where s.s_nationkey = n.n_nationkey)), ',') as supps from nation n"),
    Query("sub_quantified_eq_all", _all_equal, "select n_nationkey from nation where n_regionkey = all (select cast(s_suppkey % 1 + 2 as int) from supplier)"),
    Query("sub_quantified_ne_any", _any_distinct, "select n_nationkey from nation n where n_regionkey <> any (select cast(s_nationkey % 2 as int) from supplier s where s.s_nationkey = n.n_nationkey)"),
]
