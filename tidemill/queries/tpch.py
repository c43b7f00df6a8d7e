"""Decision-support queries in the shape of TPC-H, over the columns that the tables have."""

from __future__ import annotations

from tidemill.queries.base import Query, average, day, m, total

#: As wide as the columns need: products of narrow decimals stay within 18 digits, which are one long.
Q, P, D, T = "cast(l_quantity as decimal(12,2))", "cast(l_extendedprice as decimal(12,2))", "cast(l_discount as decimal(4,2))", "cast(l_tax as decimal(4,2))"
NET = f"{P} * cast(1 - {D} as decimal(4,2))"
YEAR = "cast(extract(year from {}) as int)"

Q01 = f"""
select l_returnflag, l_linestatus, {total(Q)} as sum_qty, {total(P)} as sum_base_price, {total(NET)} as sum_disc_price,
       {total(f"{NET} * cast(1 + {T} as decimal(4,2))")} as sum_charge, {average(Q)} as avg_qty, {average(P)} as avg_price, {average(D)} as avg_disc, count(*) as count_order
from lineitem where {day("l_shipdate")} <= date '2001-11-01' - interval '90' day
group by l_returnflag, l_linestatus order by l_returnflag, l_linestatus"""

QUERIES = [
    Query("q01", Q01),
    Query("q03", f"""
select l_orderkey, {total(NET)} as revenue, {day("o_orderdate")} as o_day
from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
where c_mktsegment = 'BUILDING' and {day("o_orderdate")} < date '1998-03-15' and {day("l_shipdate")} > date '1998-03-15'
group by l_orderkey, {day("o_orderdate")} order by revenue desc, o_day, l_orderkey limit 10"""),
    Query("q04", f"""
select o_orderpriority, count(*) as order_count from orders
where {day("o_orderdate")} >= date '1997-07-01' and {day("o_orderdate")} < date '1997-07-01' + interval '3' month
  and exists (select 1 from lineitem where l_orderkey = o_orderkey and l_shipdate > o_orderdate)
group by o_orderpriority"""),
    Query("q05", f"""
select n_name, {total(NET)} as revenue
from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey join orders on c_custkey = o_custkey
     join lineitem on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey and s_nationkey = n_nationkey
where r_name = 'ASIA' and {day("o_orderdate")} >= date '1996-01-01' and {day("o_orderdate")} < date '1998-01-01'
group by n_name""", f"""
select n_name, {total(NET)} as revenue
from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
     join supplier on l_suppkey = s_suppkey and c_nationkey = s_nationkey
     join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
where r_name = 'ASIA' and {day("o_orderdate")} >= date '1996-01-01' and {day("o_orderdate")} < date '1998-01-01'
group by n_name"""),
    Query("q06", f"""
select {total(f"{P} * {D}")} as revenue from lineitem
where {day("l_shipdate")} >= date '1997-01-01' and {day("l_shipdate")} < date '1997-01-01' + interval '1' year
  and {D} between 0.06 - 0.01 and 0.06 + 0.01 and l_quantity < 24"""),
    Query("q07", f"""
select supp_nation, cust_nation, l_year, {total("volume")} as revenue from (
  select n1.n_name as supp_nation, n2.n_name as cust_nation, {YEAR.format("l_shipdate")} as l_year, {NET} as volume
  from lineitem join supplier on s_suppkey = l_suppkey join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
       join nation n1 on s_nationkey = n1.n_nationkey join nation n2 on c_nationkey = n2.n_nationkey
  where ((n1.n_name = 'NATION_3' and n2.n_name = 'NATION_7') or (n1.n_name = 'NATION_7' and n2.n_name = 'NATION_3'))
    and {day("l_shipdate")} between date '1996-01-01' and date '1999-12-31') shipping
group by supp_nation, cust_nation, l_year"""),
    Query("q08", f"""
select o_year, cast(sum(case when nation_name = 'NATION_8' then volume else 0 end) as double) / cast(sum(volume) as double) as mkt_share from (
  select {YEAR.format("o_orderdate")} as o_year, {NET} as volume, n2.n_name as nation_name
  from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey join orders on l_orderkey = o_orderkey
       join customer on o_custkey = c_custkey join nation n1 on c_nationkey = n1.n_nationkey join region on n1.n_regionkey = r_regionkey
       join nation n2 on s_nationkey = n2.n_nationkey
  where r_name = 'AMERICA' and {day("o_orderdate")} between date '1996-01-01' and date '1999-12-31' and p_type = 'ECONOMY') all_nations
group by o_year"""),
    Query("q10", f"""
select c_custkey, c_name, {total(NET)} as revenue, cast({m("c_acctbal")} as double) as acctbal, n_name
from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join nation on c_nationkey = n_nationkey
where {day("o_orderdate")} >= date '1997-10-01' and {day("o_orderdate")} < date '1997-10-01' + interval '3' month and l_returnflag = 'R'
group by c_custkey, c_name, cast({m("c_acctbal")} as double), n_name order by revenue desc, c_custkey limit 20"""),
    Query("q12", f"""
select l_linestatus, cast(sum(case when o_orderpriority in ('1-URGENT', '2-HIGH') then 1 else 0 end) as bigint) as high_line_count,
       cast(sum(case when o_orderpriority <> '1-URGENT' and o_orderpriority <> '2-HIGH' then 1 else 0 end) as bigint) as low_line_count
from orders join lineitem on o_orderkey = l_orderkey
where l_returnflag in ('R', 'A') and o_orderdate < l_shipdate and {day("l_shipdate")} >= date '1997-01-01' and {day("l_shipdate")} < date '1998-01-01'
group by l_linestatus"""),
    Query("q13", """
select c_count, count(*) as custdist from (
  select c_custkey, count(o_orderkey) as c_count from customer left join orders on c_custkey = o_custkey and o_orderpriority not like '%URGENT%'
  group by c_custkey) c_orders
group by c_count"""),
    Query("q14", f"""
select 100.0 * cast(sum(case when p_type like 'PROMO%' then {NET} else 0 end) as double) / cast(sum({NET}) as double) as promo_revenue
from lineitem join part on l_partkey = p_partkey where {day("l_shipdate")} >= date '1997-09-01' and {day("l_shipdate")} < date '1997-09-01' + interval '1' month"""),
    Query("q15", f"""
with revenue as (select l_suppkey as supplier_no, sum({NET}) as total_revenue from lineitem
  where {day("l_shipdate")} >= date '1997-01-01' and {day("l_shipdate")} < date '1997-01-01' + interval '3' month group by l_suppkey)
select s_suppkey, s_name, cast(total_revenue as double) as total_revenue from supplier join revenue on s_suppkey = supplier_no
where total_revenue = (select max(total_revenue) from revenue)"""),
    Query("q16", """
select p_brand, p_type, p_size, count(distinct l_suppkey) as supplier_cnt from lineitem join part on p_partkey = l_partkey
where p_brand <> 'Brand#45' and p_type not like 'MED%' and p_size in (3, 9, 14, 19, 23, 36, 45, 49)
  and l_suppkey not in (select s_suppkey from supplier where s_acctbal < 0)
group by p_brand, p_type, p_size"""),
    Query("q17", f"""
select cast(sum({P}) as double) / 7.0 as avg_yearly from lineitem join part on p_partkey = l_partkey
where p_brand = 'Brand#23' and {Q} < (select 0.5 * cast(sum({m("i.l_quantity")}) as double) / count(*) from lineitem i where i.l_partkey = p_partkey)"""),
    Query("q18", f"""
select c_name, c_custkey, o_orderkey, {day("o_orderdate")} as o_day, cast({m("o_totalprice")} as double) as price, cast(q as double) as qty
from (select l_orderkey, sum({Q}) as q from lineitem group by l_orderkey having sum({Q}) > 200) l
join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
order by price desc, o_day, o_orderkey limit 100""", f"""
select c_name, c_custkey, o_orderkey, {day("o_orderdate")} as o_day, cast({m("o_totalprice")} as double) as price, {total(Q)} as qty
from customer join orders on c_custkey = o_custkey join lineitem on o_orderkey = l_orderkey
where o_orderkey in (select l_orderkey from lineitem group by l_orderkey having sum({Q}) > 200)
group by c_name, c_custkey, o_orderkey, {day("o_orderdate")}, cast({m("o_totalprice")} as double)
order by price desc, o_day, o_orderkey limit 100"""),
    Query("q19", f"""
select {total(NET)} as revenue from lineitem join part on p_partkey = l_partkey
where (p_brand = 'Brand#12' and l_quantity between 1 and 11 and p_size between 1 and 5)
   or (p_brand = 'Brand#23' and l_quantity between 10 and 20 and p_size between 1 and 10)
   or (p_brand = 'Brand#34' and l_quantity between 20 and 30 and p_size between 1 and 15)"""),
    Query("q20", f"""
select s_suppkey, s_name from supplier join nation on s_nationkey = n_nationkey
where n_regionkey = 2 and s_suppkey in (
  select l_suppkey from lineitem where l_partkey in (select p_partkey from part where p_name like 'red%')
  group by l_suppkey having sum({Q}) > 0.02 * (select sum({Q}) from lineitem where l_returnflag = 'R') / 10)"""),
    Query("q21", """
select s_name, count(*) as numwait from supplier join nation on s_nationkey = n_nationkey join (
  select l_suppkey, late, min(l_suppkey) over w as lo, max(l_suppkey) over w as hi,
         min(case when late and l_returnflag = 'R' then l_suppkey end) over w as late_lo, max(case when late and l_returnflag = 'R' then l_suppkey end) over w as late_hi
  from (select l_orderkey, l_suppkey, l_returnflag, l_shipdate > o_orderdate as late from lineitem join orders on o_orderkey = l_orderkey where o_orderstatus = 'F') x
  window w as (partition by l_orderkey)) l on s_suppkey = l_suppkey
where n_regionkey = 1 and late and lo <> hi and coalesce(late_lo = l_suppkey and late_hi = l_suppkey, true)
group by s_name order by numwait desc, s_name limit 100""", """
select s_name, count(*) as numwait from supplier join lineitem l1 on s_suppkey = l1.l_suppkey join orders on o_orderkey = l1.l_orderkey join nation on s_nationkey = n_nationkey
where o_orderstatus = 'F' and l1.l_shipdate > o_orderdate and n_regionkey = 1
  and exists (select 1 from lineitem l2 where l2.l_orderkey = l1.l_orderkey and l2.l_suppkey <> l1.l_suppkey)
  and not exists (select 1 from lineitem l3 where l3.l_orderkey = l1.l_orderkey and l3.l_suppkey <> l1.l_suppkey and l3.l_shipdate > o_orderdate and l3.l_returnflag = 'R')
group by s_name order by numwait desc, s_name limit 100"""),
    Query("q22", f"""
select cntry, count(*) as numcust, {total("bal")} as totacctbal from (
  select c_nationkey % 7 as cntry, {m("c_acctbal")} as bal from customer
  where c_nationkey % 7 in (1, 2, 4, 6) and {m("c_acctbal")} > (select cast(sum({m("c_acctbal")}) as double) / count(*) from customer where c_acctbal > 0)
    and not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')) custsale
group by cntry"""),
]
