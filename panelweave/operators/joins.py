"""Lookups, candidate pairs and name resolution. No side is broadcast by hand: Spark
broadcasts what its size threshold allows and splits hot partitions of the rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.operators.scale import null_safe_join


def lookup(df: DataFrame, dim: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join with a many-to-one check: a repeated key in ``dim`` raises. A null key finds the
    row of the null key, if there is one."""
    rest = [c for c in dim.columns if c not in on]
    checked = dim.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(*rest)).alias("__row"))
    message = F.lit("lookup table has more than one row for a key")
    guarded = checked.select(*on, *[
        F.when(F.col("__n") > 1, F.raise_error(message).cast(dim.schema[c].dataType))
        .otherwise(F.col(f"__row.{c}")).alias(c) for c in rest])
    return null_safe_join(df, guarded, on)


def attach_outer(df: DataFrame, stats: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full outer join of per-key statistics. Put together from a left join, whose hot keys can be
    split (those of a full outer join cannot), and the keys the rows lack."""
    matched = null_safe_join(df, stats, on)
    missing = null_safe_join(stats, df.select(*on).distinct(), on, "left_anti")
    return matched.unionByName(missing, allowMissingColumns=True)


def minus(df: DataFrame, existing: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is not present yet."""
    return null_safe_join(df, existing.select(*on).distinct(), on, "left_anti")


def category_sides(indicators: DataFrame, items: DataFrame, categories: Sequence[str], item_category: str,
                   nulls_match: bool = False) -> tuple[DataFrame, DataFrame]:
    """The naive candidates in factored form: indicators by category and items by category, each only
    where the other side has the category. All pairs of a category are the product of its two parts;
    it is never built, as it grows with their product."""
    ids = [c for c in indicators.columns if c not in categories]
    long = indicators.unpivot(ids, list(categories), "slot", item_category).drop("slot").distinct()
    if not nulls_match:
        long = long.where(F.col(item_category).isNotNull())
        items = items.where(F.col(item_category).isNotNull())
    left = null_safe_join(long, items.select(item_category).distinct(), [item_category], "left_semi")
    right = null_safe_join(items.distinct(), long.select(item_category).distinct(), [item_category], "left_semi")
    return left, right


def naive_pairs(listed: DataFrame, indicators: DataFrame, items: DataFrame, indicator: str, item: str,
                categories: Sequence[str], item_category: str, nulls_match: bool = False) -> DataFrame:
    """Of the listed (indicator, item) pairs those that share a category, with it: the list drives two
    lookups, so the output has at most as many rows as the list has categories."""
    long = indicators.unpivot([indicator], list(categories), "slot", item_category).drop("slot").distinct()
    if not nulls_match:
        long = long.where(F.col(item_category).isNotNull())
    wanted = null_safe_join(listed.select(indicator, item).distinct(), long, [indicator], "inner", nulls_match=False)
    return null_safe_join(wanted, items.select(item, item_category).distinct(), [item, item_category], "left_semi", nulls_match)


def with_category(df: DataFrame, categories: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full outer join to the distinct categories."""
    return attach_outer(df, categories.distinct(), on)


def restrict(pairs: DataFrame, allowed: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keep approved pairs."""
    return null_safe_join(pairs, allowed.select(*on).distinct(), on, "left_semi", nulls_match=False)


def ordered_pairs(nodes: DataFrame, pairs: DataFrame, node_id: str, left: str, right: str) -> DataFrame:
    """Attributes of both ends, suffixed 1 and 2, on every listed ordered pair of different nodes.

    The pairs come as a table; the full square of the node table is never built."""
    ends = []
    for suffix, end in (("1", left), ("2", right)):
        renamed = nodes.select(*[F.col(c).alias(end if c == node_id else c + suffix) for c in nodes.columns])
        ends.append(renamed)
    listed = pairs.select(left, right).where(F.col(left) != F.col(right)).distinct()
    return listed.join(ends[0], left).join(ends[1], right)


def candidates(allowed: DataFrame, items: DataFrame, indicators: DataFrame, item: str, indicator: str,
               label: Column | None = None) -> DataFrame:
    """Attributes and a label for the approved (item, indicator) pairs only: the approved list
    drives two lookups, the full product never exists."""
    out = allowed.select(item, indicator).distinct().join(items, item).join(indicators, indicator)
    return out if label is None else out.withColumn("label", label)


def match_any(listed: DataFrame, rows: DataFrame, key: str, categories: Sequence[str], programs: DataFrame,
              program: str, category: str) -> DataFrame:
    """Of the listed (key, program) pairs those whose program category is any of the row's categories:
    linear in the list, however large a category is."""
    known = null_safe_join(listed.select(key, program).distinct(), programs.select(program, F.col(category).alias("__c")).distinct(),
                           [program], "inner", nulls_match=False)
    own = rows.select(key, F.array(*categories).alias("__own"))
    joined = null_safe_join(known, own, [key], "inner", nulls_match=False)
    return joined.where(F.array_contains("__own", F.col("__c"))).select(key, program).distinct()


def resolve(edges: DataFrame, items: DataFrame, indicators: DataFrame, item: str = "budget_item",
            indicator: str = "indicator") -> DataFrame:
    """Names to indices; a repeated name fans out to all of its indices, unknown names drop.
    ``items`` and ``indicators`` are (idx, name)."""
    left = items.select(F.col("idx").alias("item_idx"), F.col("name").alias(item))
    right = indicators.select(F.col("idx").alias("indicator_idx"), F.col("name").alias(indicator))
    return edges.join(left, item).join(right, indicator)


def with_default(rows: DataFrame, default: DataFrame, key: str) -> DataFrame:
    """Add the default table's rows for every key that has none."""
    missing = default.join(rows.select(key).distinct(), key, "left_anti")
    return rows.unionByName(missing.select(*rows.columns))


def expand_items(outcome: DataFrame, mapping: DataFrame, item: str, names: str) -> DataFrame:
    """Replace a broad item by each of its fine names; items without names drop."""
    fine = mapping.select(F.col(item), F.explode(names).alias("__fine"))
    return (null_safe_join(outcome, fine, [item], "inner").withColumnRenamed(item, f"{item}_original")
            .withColumnRenamed("__fine", item))


def rename_items(outcome: DataFrame, mapping: DataFrame, item: str, name: str) -> DataFrame:
    """Replace a broad item by its one derived name, null when it has none."""
    named = mapping.select(F.col(item), F.col(name).alias("__name"))
    return (null_safe_join(outcome, named, [item]).withColumnRenamed(item, f"{item}_original")
            .withColumnRenamed("__name", item))


def align(full: DataFrame, part: DataFrame, key: Sequence[str]) -> DataFrame:
    """Results of a subset back on the full list, null elsewhere."""
    return full.join(part, list(key), "left")
