"""Group aggregates, category rates and edge trimming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.operators.scale import attach_stats, null_safe_join, with_row
from panelweave.operators.selection import percentiles


def roll_up(df: DataFrame, detail: str, keys: Sequence[str], val: str, label: str) -> DataFrame:
    """Sum areas to one labelled row per key, null keys dropped, and stack it on the detail."""
    total = (df.na.drop(subset=list(keys)).groupBy(*keys).agg(F.sum(val).alias(val))
             .withColumn(detail, F.lit(label)))
    return df.select(detail, *keys, val).unionByName(total.select(detail, *keys, val))


def sum_by(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in columns])


def count_by(df: DataFrame, col: str) -> DataFrame:
    """Group sizes, largest first, with the grand total on each row."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return with_row(counts, total).orderBy(F.desc("n"), col)


def group_max(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Replace values by their group maximum."""
    out = attach_stats(df, keys, [F.max(c).alias(f"__max_{c}") for c in columns])
    for c in columns:
        out = out.withColumn(c, F.col(f"__max_{c}")).drop(f"__max_{c}")
    return out


def bounds(df: DataFrame, keys: Sequence[str], val: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(val).alias("lowest"), F.max(val).alias("highest"))


def ends(df: DataFrame, keys: Sequence[str], t: str, val: str) -> DataFrame:
    """First and last non-null value by period."""
    seen = F.col(val).isNotNull()
    return df.groupBy(*keys).agg(
        F.min_by(val, F.when(seen, F.col(t))).alias("first_value"),
        F.max_by(val, F.when(seen, F.col(t))).alias("last_value"))


def valid_years(df: DataFrame, keys: Sequence[str], val: str, at_least: int = 5) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(val).alias("valid")).where(F.col("valid") >= at_least)


def varying(df: DataFrame, keys: Sequence[str], val: str, least: float = 0.0001) -> DataFrame:
    """Series whose population variance reaches the threshold."""
    return df.groupBy(*keys).agg(F.var_pop(val).alias("variance")).where(F.col("variance") >= least)


def missing_share(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    gaps = sum((F.sum(F.col(c).isNull().cast("bigint")) for c in columns), F.lit(0))
    return df.agg((gaps / (F.count(F.lit(1)) * len(columns))).alias("missing_share"))


def select_groups(df: DataFrame, keys: Sequence[str], group: str, low: str, high: str,
                  national: str) -> DataFrame:
    """Both extreme deciles when the indicator has both, otherwise its national row."""
    has = [F.max((F.col(group) == name).cast("int")).alias(flag) for name, flag in
           ((low, "__low"), (high, "__high"))]
    both = (F.col("__low") == 1) & (F.col("__high") == 1)
    kept = attach_stats(df.where(F.col(group).isin(low, high, national)), keys, has)
    return kept.where(F.when(F.col(group) == national, ~both).otherwise(both)).drop("__low", "__high")


def _names_per_item(spend: DataFrame, item: str, name: str) -> DataFrame:
    # the answer is one text per item, so its spend names have to meet; duplicates go first
    return spend.select(item, name).distinct().groupBy(item).agg(
        F.sort_array(F.collect_list(name)).alias("names"))


def broad_names(spend: DataFrame, item: str, name: str) -> DataFrame:
    """One name per item: its only name, else its first Total name, else all joined."""
    names = _names_per_item(spend, item, name)
    totals = F.filter("names", lambda s: F.contains(s, F.lit("Total ")))
    chosen = F.when(F.size("names") == 1, F.col("names")[0]).when(F.size(totals) > 0, totals[0])
    return names.select(item, F.coalesce(F.replace(chosen, F.lit("Total "), F.lit("")),
                                         F.array_join("names", " & ")).alias("name"))


def fine_names(spend: DataFrame, item: str, name: str) -> DataFrame:
    """Names per item; a Total name becomes 'total (excluding the others)'."""
    names = _names_per_item(spend, item, name)
    totals = F.filter("names", lambda s: F.contains(s, F.lit("Total ")))
    others = F.filter("names", lambda s: ~F.contains(s, F.lit("Total ")))
    rest = F.concat(totals[0], F.lit(" (excluding "), F.array_join(others, ", "), F.lit(")"))
    return names.select(item, F.when((F.size("names") > 1) & (F.size(totals) > 0),
                                     F.concat(F.array(rest), others)).otherwise(F.col("names")).alias("names"))


def min_size(df: DataFrame, keys: Sequence[str], n: int = 2) -> DataFrame:
    """Drop groups with fewer than n rows."""
    return attach_stats(df, keys, [F.count(F.lit(1)).alias("__n")]).where(F.col("__n") >= n).drop("__n")


def success_rate(panel: DataFrame, series: str, t: str, val: str, categories: Sequence[str]) -> DataFrame:
    """Share of year-on-year rises per category. A series counts in each of its categories once; a
    missing year is no rise, neither for itself nor for the year after. The panel is unique on
    (series, t), so the one-row-back window spans a bounded group."""
    back = Window.partitionBy(series).orderBy(t)
    follows = F.lag(t).over(back) == F.col(t) - 1
    rises = panel.withColumn("__rise", (follows & (F.col(val) > F.lag(val).over(back))).cast("int"))
    per_series = rises.groupBy(series).agg(
        F.coalesce(F.sum("__rise"), F.lit(0)).alias("__rises"),
        *[F.first(c, ignorenulls=True).alias(c) for c in categories])
    years = panel.agg((F.countDistinct(t) - 1).alias("__steps"))
    long = per_series.select("__rises", F.explode(F.array_distinct(F.array(*categories))).alias("category"))
    counted = long.where(F.col("category").isNotNull()).groupBy("category").agg(
        F.sum("__rises").alias("rises"), F.count(F.lit(1)).alias("series"))
    return with_row(counted, years).select(
        "category", (F.col("rises") / (F.col("series") * F.col("__steps"))).alias("success_rate"))


def mean_rate(categories: DataFrame, key: str, columns: Sequence[str], rates: DataFrame) -> DataFrame:
    """Mean rate of each series' categories; null when none of them has a rate. The categories are
    unpivoted and meet the rates (category, success_rate) in one join, whose hot keys can split."""
    long = categories.select(key, F.explode(F.array(*columns)).alias("category"))
    rated = null_safe_join(long, rates.select("category", "success_rate"), ["category"], "left", nulls_match=False)
    return rated.groupBy(key).agg(F.avg("success_rate").alias("success_rate"))


def attach_scalar(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Attach a one-row table to all rows; more than one row raises."""
    first = scalars.agg(F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in scalars.columns])
    checked = first.select(*[
        F.when(F.col("__n") > 1, F.raise_error(F.lit("more than one scalar row")).cast(
            scalars.schema[c].dataType)).otherwise(F.col(c)).alias(c) for c in scalars.columns])
    return with_row(df, checked)


def trim_edges(edges: DataFrame, weight: str = "weight", lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """Zero the weights outside the two exact percentiles of the non-zero weights."""
    least, most = (F.lit(cut).cast("double") for cut in percentiles(edges.where(F.col(weight) != 0), weight, [lo, hi]))
    inside = (F.col(weight) <= most) & (F.col(weight) >= least)
    return edges.withColumn("trimmed", F.when(inside, F.col(weight)).otherwise(F.lit(0.0)))


def edge_rows(edges: DataFrame, weight: str = "weight") -> DataFrame:
    """Edges whose weight before trimming is non-zero, carrying the trimmed weight."""
    return edges.where(F.col(weight) != 0).select("src", "dst", F.col("trimmed").alias("weight"))


def clean_edges(edges: DataFrame, nodes: DataFrame, categories: Sequence[str],
                weight: str = "weight") -> DataFrame:
    """Zero a negative edge whose ends share a category; null equals nothing."""
    def side(end: str) -> DataFrame:
        own = F.array_compact(F.array(*categories))
        return nodes.select(F.col("node").alias(end), own.alias(f"__{end}"))

    joined = edges.join(side("src"), "src", "left").join(side("dst"), "dst", "left")
    shared = F.coalesce(F.arrays_overlap("__src", "__dst"), F.lit(False))
    return joined.withColumn(weight, F.when(shared & (F.col(weight) < 0), F.lit(0.0)).otherwise(
        F.col(weight))).drop("__src", "__dst")
