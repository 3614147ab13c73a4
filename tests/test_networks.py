import pytest
from pyspark.sql import functions as F

from panelweave.operators import joins as jn
from panelweave.operators import mixing as mx
from panelweave.operators import networks as nw


def test_lookup_refuses_repeated_keys(spark):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(Exception, match="more than one row"):
        jn.lookup(df, spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string"), ["k"]).collect()
    got = {r.k: r.v for r in jn.lookup(df, spark.createDataFrame([(1, "a")], "k int, v string"), ["k"]).collect()}
    assert got == {1: "a", 2: None}


def test_outer_attach_keeps_both_sides(spark):
    left = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, v string")
    right = spark.createDataFrame([(1, 10), (3, 30)], "k int, n int")
    got = sorted((r.k, r.v or "", r.n or 0) for r in jn.attach_outer(left, right, ["k"]).collect())
    assert got == [(1, "x", 10), (1, "y", 10), (2, "z", 0), (3, "", 30)]


def test_category_pairs_null_rule(spark):
    ind = spark.createDataFrame([(1, "a", None), (2, None, None)], "indicator int, c1 string, c2 string")
    items = spark.createDataFrame([("i", "a"), ("n", None)], "item string, category string")
    every = spark.createDataFrame([(i, n) for i in (1, 2, 3) for n in ("i", "n", "gone")], "indicator int, item string")
    ends = ("indicator", "item", ["c1", "c2"], "category")
    assert jn.naive_pairs(every, ind, items, *ends).count() == 1
    assert jn.naive_pairs(every, ind, items, *ends, nulls_match=True).count() == 3
    assert jn.naive_pairs(every.where("item = 'gone'"), ind, items, *ends).count() == 0
    left, right = jn.category_sides(ind, items, ["c1", "c2"], "category")
    assert [tuple(r) for r in left.collect()] == [(1, "a")] and [tuple(r) for r in right.collect()] == [("i", "a")]


def test_ordered_pairs_rename_and_skip_self(spark):
    nodes = spark.createDataFrame([(1, "a"), (2, "b")], "node int, name string")
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 1), (1, 2)], "x int, y int")
    got = sorted((r.x, r.y, r.name1, r.name2) for r in jn.ordered_pairs(nodes, pairs, "node", "x", "y").collect())
    assert got == [(1, 2, "a", "b"), (2, 1, "b", "a")]


def test_b2i_fans_out_and_falls_back(spark):
    edges = spark.createDataFrame([("roads", "speed", 0.5), ("roads", "noise", 0.4), ("bins", "speed", 0.9), ("gone", "speed", 1.0)],
                                  "budget_item string, indicator string, yes double")
    items = spark.createDataFrame([(0, "roads"), (1, "roads"), (2, "bins")], "idx int, name string")
    inds = spark.createDataFrame([(0, "speed"), (1, "speed"), (2, "noise")], "idx int, name string")
    default = spark.createDataFrame([(0, 9), (2, 7)], "indicator_idx int, item_idx int")
    out = nw.b2i_network(edges, items, inds, default, F.col("yes"))
    got = sorted((r.indicator_idx, r.item_idx) for r in out.collect())
    assert got == [(i, b) for i in (0, 1) for b in (0, 1, 2)] + [(2, 7)]


def i2i_edges(spark):
    """Twenty edges: certainties 1 (5 edges), about 0.499 (5), about 0.010 (10)."""
    kinds = [{"1": 1.0, "2": 0.0, "3": 0.0, "4": 0.0}] * 5 + [{"1": 0.5, "2": 0.5, "3": 0.001, "4": 0.0}] * 5 + [
        {"1": 0.28, "2": 0.24, "3": 0.24, "4": 0.24}] * 10
    rows = [(f"n{i}", f"n{(i + 1) % 20}", {"mean": 2.0, "scaled_mean": 0.4 + i / 100}, [d], i) for i, d in enumerate(kinds)]
    return spark.createDataFrame(rows, "indicator1 string, indicator2 string, weight map<string,double>, distribution array<map<string,double>>, row_no int")


@pytest.mark.parametrize("threshold,count", [(None, 20), (0.005, 10), (0.4, 10), (0.9, 5)])
def test_i2i_distribution_threshold(spark, threshold, count):
    nodes = spark.createDataFrame([(i, f"n{i}") for i in range(20)], "idx int, name string")
    edges = i2i_edges(spark)
    if threshold == 0.005:
        edges = edges.where("row_no < 10")
    assert nw.i2i_network(edges, nodes, "distribution", threshold).count() == count


def test_i2i_methods(spark):
    nodes = spark.createDataFrame([(i, f"n{i}") for i in range(20)] + [(50, "n0")], "idx int, name string")
    edges = i2i_edges(spark)
    assert nw.i2i_network(edges, nodes, "zero").count() == 0
    assert nw.i2i_network(edges, nodes, "digit", 0.5).count() == 10
    last = nw.i2i_network(edges, nodes, "entropy")
    assert {r.src for r in last.collect()} == set(range(1, 20)) | {50}
    plain = spark.createDataFrame([(0, 1, 0.1, 0), (0, 1, 0.7, 1), (1, 2, 0.2, 2)], "src int, dst int, weight double, row_no int")
    assert [(r.src, r.dst, r.weight) for r in nw.i2i_network(plain, nodes, "edge_list", 0.5).collect()] == [(0, 1, 0.7)]


@pytest.mark.parametrize("power", [1.0, 2.0])
def test_allocation_spends_the_whole_budget(spark, power):
    budget = spark.createDataFrame([("p", 100.0), ("q", 50.0)], "program string, amount double")
    relation = spark.createDataFrame([("p", 1), ("p", 2), ("q", 2), ("q", 3)], "program string, indicator int")
    shares = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 1.0)], "indicator int, share double")
    out = {r.indicator: r.amount for r in nw.allocate(budget, relation, shares, power).collect()}
    assert sum(out.values()) == pytest.approx(150.0)
    assert out[1] == pytest.approx(100 * 1 / (1 + 3 ** power))


def test_spillover_uses_own_flag_and_skips_self_loops(spark):
    edges = spark.createDataFrame([(1, 2, 2.0), (1, 1, 9.0), (2, 1, 4.0)], "src int, dst int, weight double")
    state = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "node int, grew int")
    assert {r.node: r.spillover for r in nw.spillover(edges, state).collect()} == {1: 2.0, 2: 0.0, 3: 0.0}


def test_relation_problems_are_reported(spark):
    relation = spark.createDataFrame([(1, [10, None]), (2, []), (3, [77])], "indicator int, programs array<int>")
    schedule = spark.createDataFrame([(10,)], "program int")
    got = sorted((r.problem, r.id) for r in nw.relation_checks(relation, schedule, "indicator", "programs").collect())
    assert got == [("empty", "2"), ("no schedule", "77"), ("null", "1")]


def test_fit(spark):
    est = spark.createDataFrame([("a", 8.0, 0.4), ("flat", 1.0, 0.5)], "k string, final double, rate double")
    target = spark.createDataFrame([("a", 0.0, 10.0, 0.5), ("flat", 2.0, 2.0, 0.5)], "k string, start double, goal double, goal_rate double")
    got = {r.k: (r.fit_value, r.fit_rate) for r in nw.goodness_of_fit(est, target, "k").collect()}
    assert got["a"] == (pytest.approx(0.8), pytest.approx(0.8))
    assert got["flat"] == (None, 1.0)
    assert nw.worst_fit(nw.goodness_of_fit(est, target, "k")).first().worst == pytest.approx(0.8)


def test_interleave_stops_when_the_first_source_is_used_up(spark):
    a = spark.range(40).withColumn("side", F.lit("a"))
    b = spark.range(1000).withColumn("side", F.lit("b"))
    out = mx.interleave([a, b], [0.5, 0.5], ["id"], 5).orderBy("step").collect()
    assert [r.step for r in out] == list(range(len(out)))
    assert sum(r.side == "a" for r in out) == 40 and out[-1].side == "a"
    assert len({(r.side, r.id) for r in out}) == len(out)


def test_concat_capped_takes_equal_shares(spark):
    out = mx.concat_capped([spark.range(100), spark.range(30), spark.range(3)], 30, ["id"], 1)
    assert {r.source_no: r["count"] for r in out.groupBy("source_no").count().collect()} == {0: 10, 1: 10, 2: 3}
