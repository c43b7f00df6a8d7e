"""DISTINCT, DISTINCT ON and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators import distinct_on
from tidemill.queries.base import Query
from tidemill.sources import Catalog


def _distinct_on(t: Catalog) -> DataFrame:
    return distinct_on(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey")


A, B = "select c_nationkey as k from customer where c_nationkey < 15", "select s_nationkey as k from supplier where s_nationkey > 9"

QUERIES = [
    Query("distinct_rows", "select distinct l_returnflag, l_linestatus, l_linenumber from lineitem"),
    Query("distinct_keys", "select distinct o_custkey from orders where o_totalprice > 200000"),
    Query("distinct_on_keys", _distinct_on, "select distinct on (o_custkey) o_custkey, o_orderkey from orders order by o_custkey, o_orderdate desc, o_orderkey"),
    Query("union_all", f"{A} union all {B}"),
    Query("union_distinct", f"{A} union {B}"),
    Query("union_mixed_types", "select p_partkey as k, p_brand as s from part where p_size = 1 union all select cast(n_nationkey as bigint), n_name from nation"),
    Query("intersect_rows", f"{A} intersect {B}"),
    Query("intersect_all_rows", f"{A} intersect all {B}"),
    Query("except_rows", f"{A} except {B}"),
    Query("except_all_rows", f"{A} except all {B}"),
]
