"""Positions of an order, against sorting."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.operators import pairs as pr
from panelweave.operators import selection as sl


def columns():
    rng = random.Random(1)
    yield "double", [rng.choice([1.0, -1.0]) * 10 ** rng.uniform(-200, 200) for _ in range(300)] + [0.0] * 40 + [5e-324, 1.7e308, -1.7e308]
    yield "double", [7.5] * 500 + [7.5000000000000009] * 30 + [math.nan, None]
    yield "bigint", [rng.randrange(-(1 << 63), 1 << 63) for _ in range(200)] + [(1 << 63) - 1, -(1 << 63), (1 << 63) - 2, None] + [5] * 100
    yield "bigint", [(1 << 60) + i for i in range(300)]
    yield "int", [rng.randrange(4) for _ in range(400)]
    yield "double", []


@pytest.mark.parametrize("few,bins", [(4096, 1 << 16), (3, 512)])
def test_order_statistics(spark, monkeypatch, few, bins):
    monkeypatch.setattr(sl, "FEW", few)
    monkeypatch.setattr(sl, "BINS", bins)
    for kind, values in columns():
        df = spark.createDataFrame([(v,) for v in values], f"x {kind}").coalesce(1).cache()
        real = sorted(v for v in values if v is not None and v == v)
        at = sorted({0, 1, len(real) // 3, len(real) // 2, len(real) - 1} & set(range(len(real)))) if few == 4096 else [len(real) // 2] * bool(real)
        want = {p: (real[p], sum(v < real[p] for v in real), sum(v <= real[p] for v in real)) for p in at}
        assert sl.order_statistics(df, F.col("x"), [*at, len(real), -1]) == want


def test_percentiles(spark):
    values = [float(x) for x in np.random.default_rng(0).exponential(size=6000)] + [3.0] * 500
    df = spark.createDataFrame([(v,) for v in [*values, None, math.nan]], "x double").coalesce(2)
    assert sl.percentiles(df, "x", [0, 0.05, 0.5, 0.95, 1]) == pytest.approx(np.percentile(values, [0, 5, 50, 95, 100]), rel=1e-14)
    assert sl.percentiles(df.limit(0), "x", [0.5]) == [None]


def test_sample_is_the_smallest_hashes_without_a_sort_or_join(spark):
    df = spark.range(20_000).select(F.col("id").alias("a"), F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("b"), F.lit("wide").alias("c")).repartition(6)
    want = {r.a for r in df.orderBy(F.md5(F.concat_ws(":", F.lit("42"), "a", "b")), "a").limit(700).collect()}
    got = pr.sample_n(df, 700, ["a", "b"])
    assert {r.a for r in got.collect()} == want and got.columns == df.columns
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Window", "Join", "Sort", "rangepartitioning"))
    assert pr.sample_n(df, 30_000, ["a", "b"]).count() == 20_000
    assert pr.sample_n(df, 0, ["a", "b"]).count() == 0 and pr.sample_n(df.limit(0), 5, ["a", "b"]).count() == 0


def test_rows_that_share_the_leading_bits(spark, monkeypatch):
    monkeypatch.setattr(sl, "hash_text", lambda seed, *ids: F.lpad(F.concat(F.lit("0" * 16), F.hex(F.col(ids[0]) % 3)), 32, "0"))
    df = spark.range(50)
    got = sorted(r.id for r in sl.smallest_by_hash(df, 20, ["id"], 1).collect())
    assert got == sorted(sorted(range(50), key=lambda i: (i % 3, i))[:20])
