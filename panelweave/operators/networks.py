"""Edge tables between items and indicators, allocation over them, and run summaries.

Networks stay edge rows (absent edge = 0); no adjacency matrix or per-node list is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.answers import edge_weight
from panelweave.functions.uncertainty import certainty
from panelweave.operators.joins import resolve
from panelweave.operators.scale import null_safe_join
from panelweave.session import durable


def edge_threshold(df: DataFrame, yes: Column, least: float = 0.5) -> DataFrame:
    return df.where(yes >= least)


def b2i_network(edges: DataFrame, items: DataFrame, indicators: DataFrame, default: DataFrame,
                yes: Column, least: float = 0.5) -> DataFrame:
    """(indicator_idx, item_idx) rows of the edges that pass, names fanned out to all indices,
    the default rows for indicators left without any."""
    passing = edge_threshold(edges, yes, least).select("budget_item", "indicator").distinct()
    # two names a row, read by both branches below: written once instead of planned twice
    known = durable(null_safe_join(passing, items.select(F.col("name").alias("budget_item")).distinct(), ["budget_item"], "left_semi"))
    rows = resolve(known, items, indicators).select("indicator_idx", "item_idx")
    # which indicators got a program is decided on names, before the fan-out
    named = indicators.select(F.col("idx").alias("indicator_idx"), F.col("name").alias("indicator"))
    covered = null_safe_join(named, known.select("indicator").distinct(), ["indicator"], "left_semi")
    missing = null_safe_join(default, covered.select("indicator_idx"), ["indicator_idx"], "left_anti")
    return rows.unionByName(missing.select("indicator_idx", "item_idx"))


def i2i_network(edges: DataFrame, nodes: DataFrame, method: str, threshold: float | None = None,
                order: str = "row_no") -> DataFrame:
    """(src, dst, weight) rows by method.

    zero: none. edge_list: edges are (src, dst, weight) already, kept from the threshold up.
    distribution / digit / entropy: ``weight`` is a map; null and 0 weights drop; the threshold
    applies to the certainty of the stored distribution or to the digit weight. A repeated name
    means its last index, a repeated edge its last row.
    """
    if method == "zero":
        return edges.sparkSession.createDataFrame([], "src bigint, dst bigint, weight double")
    if method == "edge_list":
        kept = edges if threshold is None else edges.where(F.col("weight") >= threshold)
        ends = ["src", "dst"]
        return kept.groupBy(*ends).agg(F.max_by("weight", order).alias("weight"))
    kept = edges.where(F.col("weight").isNotNull()).withColumn("__w", edge_weight(F.col("weight"))).where("__w != 0")
    if threshold is not None and method == "distribution":
        kept = kept.where(certainty(F.col("distribution")[0]) >= threshold)
    elif threshold is not None and method == "digit":
        kept = kept.where(F.col("__w") >= threshold)
    last = nodes.groupBy("name").agg(F.max("idx").alias("idx"))
    one = last.select(F.col("name").alias("indicator1"), F.col("idx").alias("src"))
    two = last.select(F.col("name").alias("indicator2"), F.col("idx").alias("dst"))
    named = null_safe_join(null_safe_join(kept, one, ["indicator1"], "inner"), two, ["indicator2"], "inner")
    return named.groupBy("src", "dst").agg(F.max_by("__w", order).alias("weight"))


def allocate(budget: DataFrame, relation: DataFrame, shares: DataFrame, power: float = 1.0) -> DataFrame:
    """Split each program's budget over its indicators by share^power; an indicator adds up over
    its programs. ``budget`` is (program, amount), ``relation`` (program, indicator), ``shares``
    (indicator, share)."""
    weight = F.col("share") if power == 1.0 else F.pow("share", F.lit(power))
    weighted = relation.join(shares, "indicator").withColumn("__w", weight)
    totals = weighted.groupBy("program").agg(F.sum("__w").alias("__t"))
    funds = totals.join(budget, "program").select("program", (F.col("amount") / F.col("__t")).alias("__unit"))
    return null_safe_join(weighted, funds, ["program"], "inner").groupBy("indicator").agg(
        F.sum(F.col("__w") * F.col("__unit")).alias("amount"))


def spillover(edges: DataFrame, state: DataFrame) -> DataFrame:
    """Per node its own growth flag times the sum of its outgoing weights, self-loops left out."""
    out = edges.where(F.col("src") != F.col("dst")).groupBy("src").agg(F.sum("weight").alias("__w"))
    return state.join(out.withColumnRenamed("src", "node"), "node", "left").select(
        "node", (F.col("grew") * F.coalesce("__w", F.lit(0.0))).alias("spillover"))


def invert(relation: DataFrame, key: str, values: str, out: str) -> DataFrame:
    """(key, list of values) rows to (value, key) rows."""
    return relation.select(F.explode(values).alias(out), key).distinct()


def relation_checks(relation: DataFrame, schedule: DataFrame, indicator: str, programs: str) -> DataFrame:
    """Violations: empty lists, null entries, programs without a schedule."""
    empty = relation.where(F.col(programs).isNull() | (F.size(programs) == 0)).select(
        F.lit("empty").alias("problem"), F.col(indicator).cast("string").alias("id"))
    rows = relation.select(indicator, F.explode(programs).alias("program"))
    nulls = rows.where("program IS NULL").select(F.lit("null").alias("problem"), F.col(indicator).cast("string").alias("id"))
    unknown = rows.select("program").distinct().where("program IS NOT NULL").join(
        schedule.select("program").distinct(), "program", "left_anti").select(
        F.lit("no schedule").alias("problem"), F.col("program").cast("string").alias("id"))
    return empty.unionByName(nulls).unionByName(unknown)


def mc_mean(runs: DataFrame, keys: Sequence[str], t: str, val: str) -> DataFrame:
    """Mean over runs per key and period."""
    return runs.groupBy(*keys, t).agg(F.avg(val).alias("mean"))


def mc_summary(runs: DataFrame, keys: Sequence[str], t: str, val: str, rate: str) -> DataFrame:
    """Mean final value over runs and mean rate over runs and periods."""
    means = runs.groupBy(*keys, t).agg(F.avg(val).alias("__v"), F.avg(rate).alias("__r"))
    return means.groupBy(*keys).agg(F.max_by("__v", t).alias("final"), F.avg("__r").alias("rate"))


def goodness_of_fit(estimate: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Errors and fit per series. ``estimate`` is (key, final, rate); ``target`` is
    (key, start, goal, goal_rate)."""
    joined = estimate.join(target, key)
    error_value = F.col("goal") - F.col("final")
    error_rate = F.col("goal_rate") - F.col("rate")
    return joined.select(
        key, error_value.alias("error_value"), error_rate.alias("error_rate"),
        (1 - F.try_divide(F.abs(error_value), F.abs(F.col("goal") - F.col("start")))).alias("fit_value"),
        (1 - F.try_divide(F.abs(error_rate), F.col("goal_rate"))).alias("fit_rate"))


def worst_fit(fits: DataFrame) -> DataFrame:
    return fits.agg(F.least(F.min("fit_value"), F.min("fit_rate")).alias("worst"))
