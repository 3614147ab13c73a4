"""The building blocks against brute force, with one key holding more than a third of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from panelweave.operators import scale as sc


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    data = [(i, "hot" if i % 5 < 2 else f"k{rng.randrange(40)}", rng.randrange(50)) for i in range(4000)]
    return data, spark.createDataFrame(data, "id bigint, k string, v bigint")


def test_running_sums_match_a_sorted_loop(skewed):
    data, df = skewed
    got = {r.id: r.before for r in sc.running_sums(
        df, ["k"], F.expr("v DIV 5"), ["v", "id"], {"before": F.col("v")}).collect()}
    want, sums = {}, {}
    for i, k, v in sorted(data, key=lambda r: (r[2], r[0])):
        want[i] = sums.get(k, 0)
        sums[k] = want[i] + v
    assert got == want


def test_hash_rank_is_a_permutation_per_key_and_repeats(skewed):
    data, df = skewed
    first = sorted((r.k, r.rank0, r.id) for r in sc.hash_rank(df, ["k"], 3, ["id"]).collect())
    again = sorted((r.k, r.rank0, r.id) for r in sc.hash_rank(df.repartition(13), ["k"], 3, ["id"]).collect())
    assert first == again
    for key in {k for k, _, _ in first}:
        ranks = [r for k, r, _ in first if k == key]
        assert ranks == list(range(len(ranks)))


def test_hash_rank_keeps_null_keys_when_asked(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id bigint, k string")
    assert sc.hash_rank(df, ["k"], 1, ["id"], nulls_match=True).count() == 3


def test_global_index_is_the_sorted_position(skewed):
    data, df = skewed
    got = [(r.idx, r.id) for r in sc.global_index(df, ["k", "v", "id"]).orderBy("idx").collect()]
    want = [(n, r[0]) for n, r in enumerate(sorted(data, key=lambda r: (r[1], r[2], r[0])))]
    assert got == want


def test_ordered_rank_restarts_per_key(skewed):
    data, df = skewed
    got = {r.id: r.rank0 for r in sc.ordered_rank(df, ["k"], ["v", "id"]).collect()}
    want, seen = {}, {}
    for i, k, v in sorted(data, key=lambda r: (r[2], r[0])):
        want[i] = seen.get(k, 0)
        seen[k] = want[i] + 1
    assert got == want


def test_global_running_sum(skewed):
    data, df = skewed
    got = {r.id: r.before for r in sc.global_running_sum(df, ["v", "id"], "v", "before").collect()}
    total, want = 0, {}
    for i, _, v in sorted(data, key=lambda r: (r[2], r[0])):
        want[i], total = total, total + v
    assert got == want


def test_exact_percentiles_match_linear_interpolation(skewed):
    import numpy as np

    data, df = skewed
    row = sc.exact_percentiles(df, "v", [0.05, 0.5, 0.95], ["id"]).first()
    want = np.percentile([r[2] for r in data], [5, 50, 95])
    assert [row.p0, row.p1, row.p2] == pytest.approx(want)


def test_attach_stats_lets_null_equal_null(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, v int")
    got = sorted((r.k or "", r.n) for r in sc.attach_stats(df, ["k"], [F.count("v").alias("n")]).collect())
    assert got == [("", 2), ("", 2), ("a", 1)]


def test_hot_join_partition_is_split(spark):
    """With a third of the rows on one key the row side of attach_stats is read in several pieces."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        # many input partitions, as a table of many files has: a hot partition splits between them
        df = spark.range(0, 400_000, 1, 16).select(
            F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"), F.md5(F.col("id").cast("string")).alias("text"))
        out = sc.attach_stats(df, ["k"], [F.count(F.lit(1)).alias("n")])
        assert out.where("k = 0").select("n").distinct().collect()[0].n == 133_334
        total = out.groupBy().agg(F.sum(F.length("text")).alias("c"), F.sum("n").alias("n"))
        assert total.collect()[0].c == 400_000 * 32
        plan = total._jdf.queryExecution().executedPlan().toString()
        assert "isFinalPlan=true" in plan and "skew" in plan
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_spread_is_the_callers_choice(spark):
    df = spark.range(100).coalesce(2)
    assert sc.spread(df, "id", None) is df
    assert sc.spread(df, "id", 5).rdd.getNumPartitions() == 5
