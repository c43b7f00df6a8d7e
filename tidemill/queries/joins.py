"""Joins of every kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions import money
from tidemill.operators import asof_join, range_join
from tidemill.queries.base import Query, m, total
from tidemill.sources import Catalog


def _asof(t: Catalog) -> DataFrame:
    left = t.events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = t.events.filter("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"))
    return asof_join(left, right, ["user_id"], "ts", "view_ts").select("event_id", F.col("view_ts").alias("last_ts"))


def _range(t: Catalog) -> DataFrame:
    bands = t.region.select(F.col("r_regionkey").alias("band"), (900 + 200 * F.col("r_regionkey")).cast("decimal(15,2)").alias("low"), (1100 + 200 * F.col("r_regionkey")).cast("decimal(15,2)").alias("high"))
    return range_join(t.part.withColumn("price", money("p_retailprice")), bands, "price", "low", "high", 200).select("p_partkey", "band")


QUERIES = [
    Query("join_inner", f"select o.o_orderkey, c.c_name, {m('o.o_totalprice')} as price from orders o join customer c on o.o_custkey = c.c_custkey where c.c_mktsegment = 'BUILDING'"),
    Query("join_comma_where", "select n.n_name, r.r_name from nation n, region r where n.n_regionkey = r.r_regionkey and r.r_name <> 'ASIA'"),
    Query("join_using", "select n_name, s_suppkey from (select n_nationkey as k, n_name from nation) n join (select s_nationkey as k, s_suppkey from supplier) s using (k)"),
    Query("join_inner_multikey", "select a.l_orderkey, a.l_linenumber, a.l_partkey as p1, b.l_partkey as p2 from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber where a.l_partkey < b.l_partkey"),
    Query("join_theta_residual", f"select o.o_orderkey, l.l_linenumber, l.l_partkey from orders o join lineitem l on o.o_orderkey = l.l_orderkey and {m('l.l_extendedprice')} * 3 > {m('o.o_totalprice')} and l.l_shipdate > o.o_orderdate"),
    Query("join_expression_key", "select a.n_nationkey, b.s_suppkey from nation a join supplier b on a.n_nationkey + 1 = b.s_nationkey * 1"),
    Query("join_left", "select c.c_custkey, o.o_orderkey from customer c left join (select * from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'P') o on c.c_custkey = o.o_custkey"),
    Query("join_left_on_filter", "select c.c_custkey, o.o_orderkey from customer c left join orders o on c.c_custkey = o.o_custkey and o.o_totalprice > 400000 and c.c_acctbal > 0"),
    Query("join_left_where_null", "select c.c_custkey from customer c left join (select * from orders where o_totalprice > 300000) o on c.c_custkey = o.o_custkey where o.o_orderkey is null"),
    Query("join_right", "select o.o_orderkey, p.p_partkey from (select * from lineitem where l_quantity > 49) l join orders o on l.l_orderkey = o.o_orderkey right join part p on l.l_partkey = p.p_partkey"),
    Query("join_full", "select a.k as ak, b.k as bk, a.n as an, b.n as bn from (select c_nationkey % 10 as k, count(*) as n from customer where c_nationkey % 10 < 7 group by c_nationkey % 10) a full join (select s_nationkey % 10 as k, count(*) as n from supplier where s_nationkey % 10 > 3 group by s_nationkey % 10) b on a.k = b.k"),
    Query("join_semi", "select c.c_custkey, c.c_name from customer c left semi join (select * from orders where o_totalprice > 350000) o on c.c_custkey = o.o_custkey", "select c.c_custkey, c.c_name from customer c semi join (select * from orders where o_totalprice > 350000) o on c.c_custkey = o.o_custkey"),
    Query("join_anti", "select o.o_orderkey from orders o left anti join lineitem l on o.o_orderkey = l.l_orderkey", "select o.o_orderkey from orders o anti join lineitem l on o.o_orderkey = l.l_orderkey"),
    Query("join_cross_scalar", f"select c.c_custkey, cast({m('c.c_acctbal')} as double) as bal, t.top from customer c cross join (select cast(max({m('c_acctbal')}) as double) as top from customer) t where c.c_acctbal * 2 > t.top"),
    Query("join_cross", "select n.n_nationkey, r.r_regionkey from nation n cross join region r"),
    Query("join_nonequi", "select r.r_regionkey, n.n_nationkey from region r join nation n on r.r_regionkey * 5 < n.n_nationkey and n.n_nationkey < r.r_regionkey * 5 + 4"),
    Query("join_left_nonequi", "select r.r_regionkey, n.n_nationkey from region r left join nation n on n.n_nationkey < r.r_regionkey - 1"),
    Query("join_star_aggregate", f"select r.r_name, p.p_type, {total(m('l.l_extendedprice'))} as revenue, count(*) as n from lineitem l join part p on l.l_partkey = p.p_partkey join supplier s on l.l_suppkey = s.s_suppkey join nation n on s.s_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey group by r.r_name, p.p_type"),
    Query("join_disjunctive_filter", "select s.s_suppkey, c.c_custkey from supplier s join customer c on s.s_nationkey = c.c_nationkey where (s.s_nationkey = 3 and c.c_mktsegment = 'BUILDING') or (s.s_nationkey = 7 and c.c_mktsegment = 'MACHINERY')"),
    Query("join_natural", "select k, n_name, s_suppkey from (select n_nationkey as k, n_name from nation) n natural join (select s_nationkey as k, s_suppkey from supplier) s"),
    Query("join_interval", "select a.event_id, b.event_id as then_id from events a join events b on a.user_id = b.user_id and b.ts > a.ts and b.ts <= a.ts + interval '6' hour where a.event_type = 'click' and b.event_type = 'purchase'"),
    Query("join_range", _range, f"select p.p_partkey, b.r_regionkey as band from part p join region b on {m('p.p_retailprice')} >= 900 + 200 * b.r_regionkey and {m('p.p_retailprice')} < 1100 + 200 * b.r_regionkey"),
    Query("join_asof", _asof, "select a.event_id, b.ts as last_ts from (select * from events where event_type = 'purchase') a asof left join (select * from events where event_type = 'view') b on a.user_id = b.user_id and a.ts >= b.ts"),
]
