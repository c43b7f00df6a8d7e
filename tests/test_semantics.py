"""NULLs, empty inputs and other cases that the generated tables don't have, against the oracle and by hand."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.compare import assert_same
from tidemill.functions import day, exact_avg, money, prefix, safe_divide
from tidemill.operators import distinct_on, quantified, single_row_join, top_per_group, with_ties

TABLES = {
    "t_null": ("k int, v decimal(15,2), s string, d date, b boolean", "(1, 1.50, 'x', date '2001-01-31', true), (1, null, null, null, null), (2, 7.00, '', date '2000-02-29', false), (null, 3.00, 'y', null, true), (null, null, 'y', date '1999-12-31', null), (3, -2.25, 'x', null, false)"),
    "t_left": ("k int, x int", "(1, 10), (1, 11), (2, 20), (null, 30), (4, null)"),
    "t_right": ("k int, x int", "(1, 5), (2, 25), (2, 26), (null, 7), (5, 50)"),
    "t_like": ("s string", "('abc'), ('abcd'), ('xabc'), ('xabcx'), ('a_c'), ('a%c'), (''), (null)"),
    "t_case": ("x int", "(1), (2), (3), (null)"),
    "t_multi": ("k int, y int", "(1, 1), (1, 2)"),
    "t_ties": ("k int, score int", "(1, 5), (2, 9), (3, 9), (4, 7), (5, 7), (6, null), (7, 7)"),
}

SAME = [
    "select k, s from t_null where not (v > 1)",
    "select k from t_null where v > 1 or b",
    "select k, count(*) as n, count(v) as nv, cast(sum(v) as double) as sv, min(s) as ms, max(d) as md from t_null group by k",
    "select cast(sum(v) as double) as sv, cast(avg(v) as double) as av, min(v) as mi, count(*) as n from t_null where k = 99",
    "select l.k as lk, l.x as lx, r.x as rx from t_left l join t_right r on l.k = r.k",
    "select l.k as lk, l.x as lx, r.x as rx from t_left l left join t_right r on l.k = r.k",
    "select l.k as lk, l.x as lx, r.x as rx from t_left l left join t_right r on l.k = r.k and r.x > 10",
    "select l.k as lk, l.x as lx, r.x as rx from t_left l left join t_right r on l.k = r.k where r.x > 10",
    "select l.k as lk, r.k as rk, r.x as rx from t_left l right join t_right r on l.k = r.k",
    "select l.k as lk, r.k as rk from t_left l full join t_right r on l.k = r.k",
    "select k, x from t_left l where exists (select 1 from t_right r where r.k = l.k)",
    "select k, x from t_left l where not exists (select 1 from t_right r where r.k = l.k)",
    "select k, x from t_left where k in (select k from t_right)",
    "select k, x from t_left where k not in (select k from t_right)",
    "select k, x from t_left where k not in (select k from t_right where k is not null)",
    "select k, x from t_left where k not in (select k from t_right where x > 1000)",
    "select k, (select count(*) from t_right r where r.k = l.k) as n, (select max(x) from t_right r where r.k = l.k) as m from t_left l",
    "select s from t_like where s like 'abc'",
    "select s from t_like where s like '%abc'",
    "select s from t_like where s like 'abc%'",
    "select s from t_like where s like '%abc%'",
    "select s from t_like where s like 'a_c'",
    "select s from t_like where s not like 'a%'",
    "select x, case when x = 1 then 'a' when x = 2 then 'b' when x > 2 then 'c' end as y, case x when 1 then 10 when 3 then 30 end as z, nullif(x, 2) as w, coalesce(x, -1) as v from t_case",
    "select k, v from t_null order by v asc nulls first, k nulls first limit 3",
    "select distinct k, b from t_null",
    "select k from t_left union select k from t_right",
    "select k from t_left intersect select k from t_right",
    "select k from t_left except select k from t_right",
    "select k, score, cast(rank() over (order by score desc nulls last) as bigint) as r from t_ties",
    "select k, cast(sum(score) over (order by k rows between 1 preceding and current row) as bigint) as s from t_ties",
    "select k, b, count(*) as n from t_null group by rollup (k, b)",
    "select k is distinct from 1 as a, v is null as c from t_null",
]


@pytest.fixture(scope="module")
def tables(spark):
    con = duckdb.connect()
    for name, (schema, rows) in TABLES.items():
        cols = ", ".join(f"cast(c{i} as {c.split(' ')[1]}) as {c.split(' ')[0]}" for i, c in enumerate(_columns(schema)))
        names = ", ".join(f"c{i}" for i in range(len(_columns(schema))))
        spark.sql(f"select {cols} from (values {rows}) v({names})").createOrReplaceTempView(name)
        con.execute(f"create table {name} as select {cols.replace('as string)', 'as varchar)')} from (values {rows}) v({names})")
    return con


def _columns(schema):
    out, depth, cur = [], 0, ""
    for ch in schema:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(cur.strip())
            cur = ""
        else:
            cur += ch
    return [*out, cur.strip()]


@pytest.mark.parametrize("sql", SAME)
def test_same_as_oracle(sql, spark, tables):
    assert_same(spark.sql(sql), tables, sql)


@pytest.mark.parametrize("op", ["=", "<>", "<", "<=", ">", ">="])
@pytest.mark.parametrize("how", ["any", "all"])
@pytest.mark.parametrize("cond", ["true", "k is not null", "x > 1000", "x < 20"])
def test_quantified(op, how, cond, spark, tables):
    got = quantified(spark.table("t_left"), F.col("x"), op, how, spark.table("t_right").filter(cond), "x")
    assert_same(got, tables, f"select k, x from t_left where x {op} {how} (select x from t_right where {cond})")


@pytest.mark.parametrize("op", ["=", "<", ">="])
@pytest.mark.parametrize("how", ["any", "all"])
def test_quantified_correlated(op, how, spark, tables):
    got = quantified(spark.table("t_left"), F.col("x"), op, how, spark.table("t_right"), "x", on=[("k", "k")])
    assert_same(got, tables, f"select k, x from t_left l where x {op} {how} (select r.x from t_right r where r.k = l.k)")


def test_quantified_rejects_other_operators(spark, tables):
    with pytest.raises(ValueError):
        quantified(spark.table("t_left"), F.col("x"), "~", "any", spark.table("t_right"), "x")


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 6, 7, 20])
def test_with_ties(n, spark, tables):
    got = with_ties(spark.table("t_ties"), [("score", "desc")], n)
    assert_same(got, tables, f"select k, score from (select *, rank() over (order by score desc nulls last) as r from t_ties) t where r <= {n}")


def test_distinct_on_and_top(spark, tables):
    assert_same(distinct_on(spark.table("t_left"), ["k"], [F.desc("x")]), tables, "select distinct on (k) k, x from t_left order by k, x desc")
    assert top_per_group(spark.table("t_ties"), ["score"], [F.asc("k")], 2).count() == 6


def test_single_row_join(spark, tables):
    got = single_row_join(spark.table("t_case"), spark.table("t_left").agg(F.max("x").alias("top")))
    assert [r["top"] for r in got.collect()] == [30] * 4


def test_scalar_subquery_of_two_rows_raises(spark, tables):
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        spark.sql("select (select y from t_multi) as y").collect()


def test_functions(spark):
    r = spark.sql("select 'abc' as s, timestamp '2001-02-03 04:05:06' as t, cast(-0.0 as double) as z, 7 as n").select(
        prefix(F.col("s"), 2).alias("p"), day("t").cast("string").alias("d"), money("z").alias("m"), safe_divide(F.col("n"), F.lit(0)).alias("q"), safe_divide(F.col("n"), F.lit(2)).alias("h")
    )
    assert tuple(r.first())[:2] == ("ab", "2001-02-03") and str(r.first()["m"]) == "0.00" and r.first()["q"] is None and r.first()["h"] == 3.5
    assert spark.sql("select * from values (1.50), (null), (2.50) v(x)").agg(exact_avg(F.col("x")).alias("a")).first()["a"] == 2.0


def test_golden_scan_in_order(spark):
    assert [tuple(r) for r in spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string").collect()] == [(1, "x"), (2, "y")]


def test_golden_parallel_minimum(spark):
    base = spark.range(1, 200_001).select((F.col("id") % 4).cast("int").alias("grp"), ((F.col("id") % 1000) + 100).cast("decimal(15,2)").alias("v"))
    late = spark.sql("select cast(g as int) as grp, cast(v as decimal(15,2)) as v from values (0, 5.00), (1, 7.00), (2, 9.00), (3, 11.00) t(g, v)")
    rows = base.unionAll(late).groupBy("grp").agg(F.min("v").alias("v")).orderBy("grp").collect()
    assert [(r["grp"], str(r["v"])) for r in rows] == [(0, "5.00"), (1, "7.00"), (2, "9.00"), (3, "11.00")]


def test_equality_quantifiers_with_nulls(spark):
    from tidemill.operators import quantified

    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    subs = {"empty": [], "ones": [(1,), (1,)], "mixed": [(1,), (2,)], "null": [(1,), (None,)]}
    want = {
        ("=", "ALL"): {"empty": {1, 2, None}, "ones": {1}, "mixed": set(), "null": set()},
        ("<>", "ALL"): {"empty": {1, 2, None}, "ones": {2}, "mixed": set(), "null": set()},
        ("<>", "ANY"): {"empty": set(), "ones": {2}, "mixed": {1, 2}, "null": {2}},
        ("=", "ANY"): {"empty": set(), "ones": {1}, "mixed": {1, 2}, "null": {1}},
    }
    for (op, how), by in want.items():
        for name, rows in subs.items():
            got = quantified(df, F.col("x"), op, how, spark.createDataFrame(rows, "v int"), "v").collect()
            assert {r["x"] for r in got} == by[name], (op, how, name)


def test_asof_and_range_joins(spark):
    from tidemill.operators import asof_join, range_join

    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, None, 9), (5, "a", None)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 6, "z"), ("b", None, "n"), (None, 1, "m")], "k string, rt int, v string")
    assert {(r["id"], r["rt"], r["v"]) for r in asof_join(left, right, ["k"], "t", "rt").collect()} == {(1, 5, "y"), (2, None, None), (3, None, None), (4, None, None), (5, None, None)}
    points = spark.createDataFrame([(1.0,), (9.9,), (10.0,), (-3.0,), (None,)], "x double")
    spans = spark.createDataFrame([(1, 0.0, 10.0), (2, 9.5, 31.0), (3, -5.0, -3.0), (4, 4.0, 4.0), (5, None, 1.0)], "r int, low double, high double")
    got = {(r["x"], r["r"]) for r in range_join(points, spans, "x", "low", "high", 7).collect()}
    assert got == {(1.0, 1), (9.9, 1), (9.9, 2), (10.0, 2)}


def test_approximate_count_over_nulls_and_repeats(spark, tmp_path):
    from tidemill.queries import ALL

    rows = "select case when id % 5 < 4 then substring('ARN', cast(id % 3 + 1 as int), 1) end as l_returnflag, case when id % 7 > 0 then id % 900 end as l_partkey from range(9000) union all select 'X', null from range(3)"
    spark.sql(rows).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = ALL["agg_approximate"].run(spark, str(tmp_path))
    want = spark.sql(ALL["agg_approximate"].oracle)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and want.count() == 5
    whole, once = (spark.sql(f"select l_returnflag, approx_count_distinct(l_partkey) as n from {t} group by l_returnflag") for t in ("lineitem", "(select distinct l_returnflag, l_partkey from lineitem) t"))
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, once.collect()), key=str)


@pytest.mark.parametrize("name", ["sub_correlated_topn", "sub_lateral"])
def test_dearest_orders_with_nulls_ties_and_repeats(name, spark, tmp_path):
    from tidemill.queries import ALL

    spark.sql("select * from values (1L), (1L), (2L), (3L), (4L), (null) c(c_custkey)").write.parquet(str(tmp_path / "customer.parquet"))
    rows = "(10L, 1L, 5D), (11L, 1L, 5D), (null, 1L, 5D), (12L, 1L, null), (20L, 2L, null), (21L, 2L, 1D), (30L, 3L, 2D), (null, 3L, 2D), (31L, 3L, double('nan')), (40L, null, 9D), (50L, 5L, 9D)"
    spark.sql(f"select * from values {rows} o(o_orderkey, o_custkey, o_totalprice)").write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert_same(ALL[name].run(spark, str(tmp_path)), con, ALL[name].oracle)
