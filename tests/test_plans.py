"""Plans: what is pushed down, which joins are chosen; the strict surface; sources, sink and stream."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tidemill.plans import UnsupportedQuery, check, explain_analyze, operators, profile, run, summary
from tidemill.queries import ALL
from tidemill.sources import Catalog, read_table, register, write_table
from tidemill.streaming import hourly, stream_hourly


def plan(name, spark, sf_dir):
    return summary(ALL[name].run(spark, sf_dir), 4000)


def test_pushdown_and_pruning(spark, sf_dir):
    text = plan("scan_pruned_filter", spark, sf_dir)
    assert "PushedFilters: [IsNotNull(l_quantity)" in text and "GreaterThanOrEqual(l_quantity,45.0)" in text
    assert "l_tax" not in text.split("ReadSchema")[1]


def test_prefix_is_pushed(spark, sf_dir):
    assert "StringStartsWith(p_name,red)" in plan("filter_like_prefix", spark, sf_dir)


@pytest.mark.parametrize("name,node", [("sub_exists", "LeftSemi"), ("sub_not_exists", "LeftAnti"), ("sub_not_in", "LeftAnti"), ("join_left", "LeftOuter"), ("join_full", "FullOuter"), ("sub_exists_in_or", "ExistenceJoin"), ("topn", "TakeOrderedAndProject"), ("join_nonequi", "BroadcastNestedLoopJoin"), ("win_top_per_group", "WindowGroupLimit"), ("agg_rollup", "Expand")])
def test_operator_choice(name, node, spark, sf_dir):
    assert node in plan(name, spark, sf_dir)


def test_aggregates_combine_before_the_shuffle(spark, sf_dir):
    names = operators(ALL["q01"].run(spark, sf_dir))
    assert names.count("HashAggregate") == 2 and names.count("Exchange") <= 2


def test_sketch_is_kept_once_a_group(spark, sf_dir):
    keyed = [line for line in plan("agg_approximate", spark, sf_dir).split("\n") if "Aggregate(keys=" in line and "l_partkey" in line.split("keys=")[1].split("]")[0]]
    assert len(keyed) == 2 and all("functions=[]" in line for line in keyed), keyed


def test_disjunction_reaches_the_scan(spark, sf_dir):
    text = plan("q19", spark, sf_dir)
    assert "Or(" in text.split("PushedFilters")[1]


def test_no_python_in_the_catalogue(spark, sf_dir):
    for q in ALL.values():
        assert not [n for n in operators(q.run(spark, sf_dir)) if "Python" in n or "Pandas" in n or "Arrow" in n], q.name


def test_strict_surface(spark, sf_dir):
    register(spark, sf_dir, "nation")
    assert run(spark, "select count(*) as n from nation where n_regionkey = :r", r=1).first()["n"] == 5
    check("select 'insert into nn' as s")
    for text in ("drop table nation", "insert into nation values (1)", "  delete from nation", "with a as (select 1 as x) insert into nn select * from a", "from nation insert into nn select n_name"):
        with pytest.raises(UnsupportedQuery):
            check(text)
    for text, word in (("select 1 where 1 < any (select 2)", "quantified"), ("select distinct on (n_name) n_name from nation", "distinct_on"), ("select nope from nation", "nope")):
        with pytest.raises(UnsupportedQuery, match=word):
            run(spark, text)
    with pytest.raises(UnsupportedQuery, match="switched off"):
        run(spark, "select 1", enabled=False)
    with pytest.raises(UnsupportedQuery, match="each run"):
        run(spark, "select rand() as r from nation")
    assert run(spark, "select rand() as r from nation", volatile=True).count() == 25


def test_quantified_comparisons_have_keys(spark, sf_dir):
    for name in ("sub_quantified_ne_all", "sub_quantified_eq_all", "sub_quantified_ne_any"):
        assert plan(name, spark, sf_dir).count("BroadcastNestedLoopJoin") <= 1, name  # the row of totals


@pytest.mark.parametrize("name", ["sub_correlated_topn", "sub_lateral"])
def test_correlated_limits_state_their_order(name, spark, sf_dir):
    text = plan(name, spark, sf_dir)
    assert "WindowGroupLimit [o_custkey" in text and "o_totalprice" in text.split("Window [row_number()")[1].split("\n")[0], name
    assert "rangepartitioning" not in text, name


def test_correlated_limit_without_order_is_refused(spark, sf_dir):
    register(spark, sf_dir, "customer", "orders")
    inner = "select {} from orders o where o.o_custkey = c.c_custkey order by o_totalprice desc, o_orderkey limit 1"
    for text in (f"select c_custkey, ({inner.format('o_orderkey')}) as best from customer c", f"select c_custkey, t.o_orderkey from customer c, lateral ({inner.format('o_orderkey')}) t"):
        with pytest.raises(UnsupportedQuery, match="top_per_group"):
            run(spark, text)
    kept = run(spark, f"select c_custkey, t.o_orderkey as best from customer c left join lateral ({inner.format('o_orderkey, o_totalprice')}) t")
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(map(tuple, ALL["sub_correlated_topn"].run(spark, sf_dir).collect()), key=str)


def test_profile(spark, sf_dir):
    found = profile(ALL["agg_char_key"].run(spark, sf_dir))
    scan = [m for _, name, m in found if name.startswith("Scan parquet")]
    assert scan and scan[0]["numOutputRows"] == read_table(spark, sf_dir, "lineitem").count()
    assert "HashAggregate" in explain_analyze(ALL["agg_char_key"].run(spark, sf_dir))


def test_sources_and_sink(spark, sf_dir, tmp_path):
    assert Catalog(spark, sf_dir).region.count() == 5
    with pytest.raises(AttributeError):
        Catalog(spark, sf_dir).nothing
    write_table(read_table(spark, sf_dir, "nation"), str(tmp_path / "n"), partition_by=("n_regionkey",))
    back = spark.read.parquet(str(tmp_path / "n")).filter("n_regionkey = 2")
    assert back.count() == 5 and "PartitionFilters: [isnotnull(n_regionkey" in summary(back, 4000)


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = read_table(spark, sf_dir, "events").selectExpr("event_id", "cast(ts as timestamp) as ts", "user_id", "event_type", "value", "props")
    events.write.parquet(str(tmp_path / "in"))
    query = stream_hourly(spark, str(tmp_path / "in")).writeStream.outputMode("complete").format("memory").queryName("hours").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("hours").collect())) == sorted(map(tuple, hourly(events).collect()))


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_rest_works_without_the_optional_part(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(entry, "llm_catalogue", None)
    assert set(entry.queries()) == set(ALL) == set(entry.oracle_sql())
