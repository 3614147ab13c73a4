"""Stacking and mixing tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.operators.scale import hash_rank, hash_text, hash_unit, null_safe_join, running_sums, with_row
from panelweave.session import durable


def union_fill(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames whose columns differ, nulls where a column is missing."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def interleave(frames: Sequence[DataFrame], weights: Sequence[float], ids: Sequence[str], seed: int,
               block: int = 1 << 16) -> DataFrame:
    """Draw a source per step with the given weights until the first source runs out.

    Steps are a distributed range, the source of a step is decided by its hash, and the j-th
    step of a source takes that source's j-th row in hash order. All ranks are two-level and hold
    ``ids`` only, which make a source's rows unique; the rows themselves are joined once, at the end.
    """
    spark = frames[0].sparkSession
    sizes = [f.count() for f in frames]
    total = sum(sizes)
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                  [f.withColumn("source_no", F.lit(i)) for i, f in enumerate(frames)])
    ranked = hash_rank(rows.select("source_no", *ids), ["source_no"], seed, ids, "__j")

    unit = hash_unit(hash_text(seed, "step"))
    pick = F.lit(len(frames) - 1)
    for i in reversed(range(len(frames) - 1)):
        edge = sum(weights[: i + 1])
        pick = F.when(unit < edge, F.lit(i)).otherwise(pick)
    width = max(block, total // 65536)
    steps = spark.range(total + 1).withColumnRenamed("id", "step").withColumn("source_no", pick)
    # read twice, for the stop and for the draws: step numbers and sources only
    drawn = durable(running_sums(steps, ["source_no"], F.expr(f"step DIV {width}"), ["step"], {"__j": F.lit(1).cast("bigint")}))
    limits = F.lit(sizes[0])
    for i, size in enumerate(sizes):
        limits = F.when(F.col("source_no") == i, F.lit(size)).otherwise(limits)
    stop = drawn.agg(F.min(F.when(F.col("__j") == limits - 1, F.col("step"))).alias("__stop"))
    used = with_row(drawn, stop).where(
        F.col("__stop").isNull() | (F.col("step") <= F.col("__stop"))).drop("__stop")
    placed = used.join(ranked, ["source_no", "__j"]).drop("__j")
    return null_safe_join(placed, rows, ["source_no", *ids], "inner")


def concat_capped(frames: Sequence[DataFrame], n: int, ids: Sequence[str], seed: int) -> DataFrame:
    """An equally large hash sample of every source, stacked."""
    share = n // len(frames)
    tagged = [f.withColumn("source_no", F.lit(i)) for i, f in enumerate(frames)]
    ranked = hash_rank(union_fill(tagged), ["source_no"], seed, ids, "__r")
    return ranked.where(F.col("__r") < share).drop("__r")
