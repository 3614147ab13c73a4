"""What the physical plans must and must not contain."""

from pyspark.sql import functions as F

from panelweave.operators import ranks as rk
from panelweave.plans import catalog


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_columns_reach_the_scan(spark, small):
    text = plan(catalog.QUERIES["membership_filter"](spark, small))
    assert "PushedFilters: [In(o_orderpriority" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderpriority:string>" in text


def test_two_column_panel_reads_three_columns(spark, small):
    text = plan(catalog.QUERIES["group_bounds"](spark, small))
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double,o_orderdate:timestamp" in text


def test_small_top_n_limits_rows_below_the_shuffle(spark, small):
    text = plan(catalog.QUERIES["top_n_per_group"](spark, small))
    assert text.count("WindowGroupLimit") == 2
    assert text.index("Exchange hashpartitioning") < text.rindex("WindowGroupLimit")


def test_one_shuffle_for_a_pivot(spark, small):
    assert plan(catalog.QUERIES["pivot_years"](spark, small)).count("Exchange") == 2  # panel, then pivot


def test_first_per_key_is_aggregated_before_the_shuffle(spark):
    df = spark.range(10).select((F.col("id") % 3).alias("k"), "id", F.lit("long text").alias("text"))
    first = rk.keep_first(df, ["k"], [F.col("id")], ["id"])
    text = plan(first)
    assert "Window" not in text and "partial_min" in text and "LeftSemi" in text
    assert sorted(tuple(r) for r in first.collect()) == [(0, 0, "long text"), (1, 1, "long text"), (2, 2, "long text")]
