"""Queries over whole tables: no key is left out."""

from tidemill.queries import ALL


def test_no_key_is_left_out(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    run = lambda name: ALL[name].run(spark, sf_dir)
    assert run("project_date_interval").count() == read("orders").count()
    per = read("orders").join(read("customer").selectExpr("c_custkey as o_custkey"), "o_custkey", "left_semi").groupBy("o_custkey").count()
    assert run("sub_lateral").count() == per.selectExpr("sum(least(count, 2)) as n").first()["n"]
    assert run("cte_nested").count() == read("customer").filter("c_acctbal > 0").select("c_nationkey").distinct().count()
