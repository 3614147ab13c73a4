"""Duplicate resolution, numbering and neighbours along an order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.operators.scale import attach_stats, global_index, null_safe_join, ordered_rank
from panelweave.session import durable

def dup_flag(df: DataFrame, keys: Sequence[str], name: str = "is_dup") -> DataFrame:
    """1 when the key combination occurs more than once; nulls equal each other."""
    out = attach_stats(df, keys, [F.count(F.lit(1)).alias("__n")])
    return out.withColumn(name, (F.col("__n") > 1).cast("int")).drop("__n")


def _dup_levels(df: DataFrame, keys: Sequence[str], extra: str, name: str) -> DataFrame:
    """One row per (keys, extra) with the flag. Rows collapse before the window, which then spans
    the distinct values of ``extra`` of one key only."""
    fine = df.groupBy(*keys, extra).agg(F.count(F.lit(1)).alias("__nf"))
    coarse = F.sum("__nf").over(Window.partitionBy(*keys))
    return fine.withColumn("__nc", coarse).select(
        *keys, extra, ((F.col("__nc") > 1) & (F.col("__nf") == 1)).cast("int").alias(name))


def dup_due_to(df: DataFrame, keys: Sequence[str], extra: str, name: str = "is_dup_age") -> DataFrame:
    """1 when rows repeat on the keys but not once the extra column joins them."""
    return null_safe_join(df, _dup_levels(df, keys, extra, name), [*keys, extra])


def number(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "n") -> DataFrame:
    """1-based position in the group; hot groups stay spread over the range partitions."""
    return ordered_rank(df, keys, order, "__r").withColumn(name, F.col("__r") + 1).drop("__r")


def longest_series(df: DataFrame, keys: Sequence[str], parent: Sequence[str],
                   name: str = "is_longest") -> DataFrame:
    """1 on sub-series as long as the longest of their parent."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    most = sizes.groupBy(*parent).agg(F.max("__n").alias("__m"))
    flagged = null_safe_join(sizes, most, parent).select(
        *keys, (F.col("__n") == F.col("__m")).cast("int").alias(name))
    return null_safe_join(df, flagged, keys)


def latest_vintage(df: DataFrame, parent: Sequence[str], rank: Column, name: str = "is_latest") -> DataFrame:
    """1 on rows whose vintage rank is the smallest one their parent has."""
    out = attach_stats(df.withColumn("__r", rank), parent, [F.min("__r").alias("__best")])
    return out.withColumn(name, F.coalesce((F.col("__r") == F.col("__best")).cast("int"), F.lit(0))).drop(
        "__r", "__best")


def band_rank(age: Column, order: Sequence[str]) -> Column:
    """Position of the age band in an order of preference, null for other bands."""
    out = F.lit(None).cast("int")
    for i, band in reversed(list(enumerate(order))):
        out = F.when(age == band, F.lit(i)).otherwise(out)
    return out


def broadest_age(df: DataFrame, series: Sequence[str], keys: Sequence[str], age: str,
                 order: Sequence[str], overrides: Column | None = None,
                 name: str = "large_agegroup") -> DataFrame:
    """Among rows repeated only through age, 1 on the broadest band the series has. ``keys`` hold
    the series and are what repeated rows share; ``overrides`` is a rank over keys and age that
    replaces the band order where it is not null (smaller is better). Everything is decided on
    the collapsed (keys, age) level, and the rows are joined once."""
    levels = _dup_levels(df, keys, age, "is_dup_age")
    rank = band_rank(F.col(age), order)
    if overrides is not None:
        rank = F.coalesce(overrides, rank)
    ranked = levels.withColumn("__r", F.when(F.col("is_dup_age") == 1, rank))
    best = ranked.groupBy(*series).agg(F.min("__r").alias("__best"))
    chosen = null_safe_join(ranked, best, series).withColumn(
        name, F.coalesce((F.col("__r") == F.col("__best")).cast("int"), F.lit(0))).drop("__r", "__best")
    return null_safe_join(df, chosen, [*keys, age])


def dedup_series(df: DataFrame, age_order: Sequence[str], vintage_rank: Column, series: str = "series",
                 group: str = "grp", subgroup: str = "subgroup", age: str = "age", period: str = "period",
                 national: str = "national", comparator: Column | None = None,
                 strict: bool = False) -> DataFrame:
    """The exclusion cascade: narrower age bands, repeated rows outside the longest sub-series,
    repeated comparators, repeated rows of older vintages. The rules may leave a repetition on (series,
    group, period), such as a row that is its age's only one beside a national row of another age; with
    ``strict`` that raises, for data in which it must not occur.

    Each rule reads what the one before left, so the two intermediate results are written to the
    checkpoint folder; without that every rule would recompute all earlier ones.
    """
    key, parent = [series, group, period], [series, age]
    aged = broadest_age(df, [series], [series, subgroup, group, period], age, age_order)
    kept = durable(aged.where((F.col("is_dup_age") == 0) | (F.col("large_agegroup") == 1)).select(*df.columns))

    ranked = kept.withColumn("__v", vintage_rank)
    repeats = kept.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    sizes = kept.groupBy(*parent, subgroup, group).agg(F.count(F.lit(1)).alias("__len"))
    best = ranked.groupBy(*parent).agg(F.min("__v").alias("__best"))
    most = sizes.groupBy(*parent).agg(F.max("__len").alias("__most"))
    step = null_safe_join(ranked, repeats, key)
    step = null_safe_join(step, sizes, [*parent, subgroup, group])
    step = null_safe_join(null_safe_join(step, best, parent), most, parent)
    repeated = F.col("__n") > 1
    scoped = repeated & F.coalesce(F.col(subgroup) != national, F.lit(True))
    longest = F.col("__len") == F.col("__most")
    latest = F.coalesce(F.col("__v") == F.col("__best"), F.lit(False))
    drop = ~longest & scoped
    if comparator is not None:
        drop = drop | (F.coalesce(comparator, F.lit(False)) & repeated)
    step = durable(step.where(~drop).select(*df.columns, longest.alias("__longest"), latest.alias("__latest")))

    left = attach_stats(step, key, [F.count(F.lit(1)).alias("__n")])
    scoped = (F.col("__n") > 1) & F.coalesce(F.col(subgroup) != national, F.lit(True))
    out = left.where(~(~F.col("__latest") & F.col("__longest") & scoped)).select(*df.columns)
    if strict:
        checked = attach_stats(out, key, [F.count(F.lit(1)).alias("__n")])
        out = checked.withColumn(series, F.when(F.col("__n") > 1, F.raise_error(
            F.lit("series still repeats")).cast(df.schema[series].dataType)).otherwise(F.col(series))).drop("__n")
    return out


def gaps(df: DataFrame, keys: Sequence[str], t: str) -> DataFrame:
    """Distance to the previous period and the longest gap of the series. Periods are made
    distinct first, so a group holds each period once."""
    periods = df.select(*keys, t).distinct()
    w = Window.partitionBy(*keys).orderBy(t)
    stepped = periods.withColumn("step", F.col(t) - F.lag(t).over(w))
    return stepped.withColumn("max_gap", F.max("step").over(Window.partitionBy(*keys)) - 1)


def diff(panel: DataFrame, keys: Sequence[str], t: str, val: str, name: str = "change") -> DataFrame:
    """Change to the previous period, null where that period is missing. The panel is unique on
    (keys, t), so a group holds each period once."""
    w = Window.partitionBy(*keys).orderBy(t)
    follows = F.lag(t).over(w) == F.col(t) - 1
    return panel.withColumn(name, F.when(follows, F.col(val) - F.lag(val).over(w)))


def first_fall(panel: DataFrame, keys: Sequence[str], t: str, val: str, first: int) -> DataFrame:
    """0-based place of the first fall per series counted from period ``first``, null without one."""
    stepped = diff(panel, keys, t, val, "__d")
    place = F.min(F.when(F.col("__d") < 0, F.col(t))) - first
    return stepped.groupBy(*keys).agg(place.alias("first_fall"))


def reindex(relation: DataFrame, key: str, limit: int) -> DataFrame:
    """Keep ids below the limit and renumber the used ones 0, 1, … in ascending order."""
    kept = relation.where(F.col(key) < limit)
    numbered = global_index(kept.select(key).distinct(), [key], f"new_{key}")
    return kept.join(numbered, key)


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int,
          name: str = "position") -> DataFrame:
    """First n rows per key. Spark pushes a rank limit up to its own threshold below the shuffle, so
    every task forwards at most n rows per key; beyond it the rows are cut from the range order."""
    if n > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        ranked = ordered_rank(df, keys, order, name)
        return ranked.withColumn(name, F.col(name) + 1).where(F.col(name) <= n)
    w = Window.partitionBy(*keys).orderBy(*order)
    limited = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
    return limited.withColumn(name, F.col(name).cast("bigint"))


def line_range(df: DataFrame, first: int, last: int, order: Sequence[str]) -> DataFrame:
    """Rows at positions first to last of the table ordered by columns that make rows unique, both
    included. Only the ordering columns are ranked."""
    placed = global_index(df.select(*order), order, "line").where(F.col("line").between(first, last))
    return null_safe_join(df, placed, order, "inner")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column], ids: Sequence[str] | None = None) -> DataFrame:
    """One row per key, the smallest along the order, then by ``ids`` (default: the other columns),
    which with the keys make rows unique. Long keys travel as digests, rows are not sorted: the first
    ids are aggregated and the rows fetched by them."""
    rest = list(ids) if ids is not None else [c for c in df.columns if c not in keys]
    digest = F.sha2(F.to_json(F.struct(*[F.col(k) for k in keys]), {"ignoreNullFields": "false"}), 256)
    picked = df.groupBy(digest.alias("__key")).agg(F.min(F.struct(
        *[c.alias(f"__o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"__i{i}") for i, c in enumerate(rest)])).alias("__f"))
    chosen = picked.select("__key", *[F.col(f"__f.__i{i}").alias(f"__i{i}") for i in range(len(rest))])
    same = digest == F.col("__key")
    for i, c in enumerate(rest):
        same = same & F.col(c).eqNullSafe(F.col(f"__i{i}"))
    return df.join(chosen, same, "left_semi")


def latest_by(df: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Per key the row with the lexically last version; versions of one key differ."""
    newest = df.groupBy(*keys).agg(F.max(version).alias(version))
    return null_safe_join(df, newest, [*keys, version], "left_semi")


def stitch_pages(pages: DataFrame, doc: str, page: str, text: str, marker: str,
                 page_break: str = "\n\n\f") -> DataFrame:
    """Prepare consecutively numbered pages for concatenation.

    Pages from the last one that holds the marker onward are dropped. Where the next page
    starts in lower case and this one does not end a sentence, the page break becomes a space.
    The next page arrives by an equi-join on (doc, page + 1), so no document is ever gathered;
    the texts concatenated in page order are the document.
    """
    cut = pages.groupBy(doc).agg(F.max(F.when(F.contains(F.col(text), F.lit(marker)), F.col(page))).alias("__cut"))
    kept = null_safe_join(pages, cut, [doc]).where(F.col("__cut").isNull() | (F.col(page) < F.col("__cut"))).drop("__cut")
    head = kept.select(F.col(doc), (F.col(page) - 1).alias(page), F.substring(text, 1, 1).alias("__next"))
    joined = kept.join(head, [doc, page], "left")
    low = F.coalesce((F.lower("__next") == F.col("__next")) & (F.upper("__next") != F.col("__next")), F.lit(False))
    size = len(page_break)
    body = F.expr(f"substring(`{text}`, 1, greatest(length(`{text}`) - {size}, 0))")
    broken = F.col(text).endswith(page_break)
    open_end = ~F.substring(body, -1, 1).isin(".", "!", "?")
    return joined.withColumn(text, F.when(low & broken & open_end, F.concat(body, F.lit(" "))).otherwise(
        F.col(text))).drop("__next")


def stitched_text(pages: DataFrame, doc: str, page: str, text: str, marker: str, page_break: str = "\n\n\f") -> DataFrame:
    """One text per document: its stitched pages in order. A group is one document, one output row;
    documents that lose every page to the marker have none."""
    ready = stitch_pages(pages, doc, page, text, marker, page_break)
    ordered = F.sort_array(F.collect_list(F.struct(F.col(page).alias("p"), F.col(text).alias("t"))))
    return ready.groupBy(doc).agg(F.array_join(F.transform(ordered, lambda s: s["t"]), "").alias(text))
