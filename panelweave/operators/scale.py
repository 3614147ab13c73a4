"""Building blocks that keep skewed or huge groups off a single task.

* statistics of a key are pre-aggregated and joined back (no window over the key);
* ranks and running sums are taken in two levels: counts per (key, bucket) first,
  then positions inside one bucket, so a hot key is spread over its buckets;
* a total order over a whole table is cut by range, never sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.session import durable

HASH_DIGITS = 4  # 65,536 buckets: a key with 10^12 rows still has about 15 million rows per bucket
_IN_PARTITION = (1 << 33) - 1  # low bits of monotonically_increasing_id


def spread(df: DataFrame, key: str, tasks: int | None) -> DataFrame:
    """Rows hashed over the given number of tasks, for a source that is read in too few for heavy
    row-local work. The caller decides; None leaves the source as it is."""
    return df if tasks is None else df.repartition(tasks, key)


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate. The only product in the package: its right side
    is an ungrouped aggregate, which has exactly one row."""
    return df.crossJoin(F.broadcast(row))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left",
                   nulls_match: bool = True) -> DataFrame:
    """Equi-join on equally named keys, keeping the left ones; nulls may match nulls.

    The null-safe form has a second use. An aggregate on the join key would feed the join without
    an exchange of its own, and the adaptive skew join splits a hot left partition only when both
    sides come straight from an exchange. Null-safe keys differ from the grouping keys, so the
    (small) aggregate is exchanged once more and hot keys do get split.
    """
    renamed = right
    for i, key in enumerate(keys):
        renamed = renamed.withColumnRenamed(key, f"__rk{i}")
    condition = None
    for i, key in enumerate(keys):
        l, r = F.col(key), F.col(f"__rk{i}")
        one = l.eqNullSafe(r) if nulls_match else l == r
        condition = one if condition is None else condition & one
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"__rk{i}" for i in range(len(keys))])


def attach_stats(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column],
                 source: DataFrame | None = None) -> DataFrame:
    """Per-key aggregates on every row, null being a key like any other. Partial aggregation runs
    before the shuffle and the row side of the join can be split by the adaptive skew join.
    ``source`` gives the rows to aggregate when ``df`` is a costlier view of the same rows."""
    stats = (df if source is None else source).groupBy(*keys).agg(*aggs)
    if not keys:
        return with_row(df, stats)
    return null_safe_join(df, stats, keys)


def hash_text(seed: int | str, *cols: str | Column) -> Column:
    """Deterministic pseudo-random hex text per row."""
    parts = [c if isinstance(c, Column) else F.col(c) for c in cols]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hash_number(hexed: Column) -> Column:
    """First 32 bits of a hash text as a number."""
    return F.conv(F.substring(hexed, 1, 8), 16, 10).cast("bigint")


def hash_unit(hexed: Column) -> Column:
    """Hash text to a number in [0, 1)."""
    return hash_number(hexed) / float(1 << 32)


def hash_bucket(hexed: Column, digits: int = HASH_DIGITS) -> Column:
    return F.conv(F.substring(hexed, 1, digits), 16, 10).cast("int")


def running_sums(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str | Column],
                 sums: dict[str, Column], nulls_match: bool = False) -> DataFrame:
    """Exclusive running sums within a key. ``bucket`` must not decrease along ``order``, take a
    bounded number of values per key and spread its rows. Rows with a null key drop unless
    ``nulls_match`` (which costs one more exchange)."""
    names = list(sums)
    staged = df.withColumn("__b", bucket)
    for name in names:
        staged = staged.withColumn(f"__v_{name}", sums[name])
    totals = staged.groupBy(*keys, "__b").agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in names])
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "__b", *[
        F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in names])
    joined = null_safe_join(staged, offsets, [*keys, "__b"], "inner", nulls_match)
    inside = (Window.partitionBy(*keys, "__b").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    out = joined
    for n in names:
        out = out.withColumn(n, F.col(f"__o_{n}") + F.coalesce(F.sum(f"__v_{n}").over(inside), F.lit(0)))
    return out.drop("__b", *[f"__v_{n}" for n in names], *[f"__o_{n}" for n in names])


def hash_rank(df: DataFrame, keys: Sequence[str], seed: int | str, ids: Sequence[str],
              name: str = "rank0", nulls_match: bool = False) -> DataFrame:
    """0-based random-looking rank within keys; equal on every run. ``ids`` must make rows unique."""
    hexed = df.withColumn("__h", hash_text(seed, *ids))
    ranked = running_sums(hexed, keys, hash_bucket(F.col("__h")), ["__h", *ids],
                          {name: F.lit(1).cast("bigint")}, nulls_match)
    return ranked.drop("__h")


def _cut_by_range(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Rows in range partitions of the full order, frozen by a checkpoint so that partition
    numbers stay valid. Ties take part in the order, so equal leading values still spread."""
    cut = durable(df.repartitionByRange(*order).sortWithinPartitions(*order))
    return cut.withColumn("__p", F.spark_partition_id())


def _partition_starts(cut: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """Running totals before each partition: one row per partition, so bounded by their number."""
    sums = cut.groupBy("__p").agg(*[c.alias(n) for n, c in totals.items()])
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(F.col("__p").alias("__q"), *[
        F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in totals])


def global_index(df: DataFrame, order: Sequence[str | Column], name: str = "idx") -> DataFrame:
    """0-based position in a total order over the whole table: rows before the partition plus the
    place inside it. No exchange follows the range cut."""
    tagged = _cut_by_range(df, order).withColumn("__i", F.monotonically_increasing_id())
    starts = _partition_starts(tagged, {"__s": F.count(F.lit(1))})
    position = F.col("__i").bitwiseAND(F.lit(_IN_PARTITION))
    return (tagged.join(F.broadcast(starts), F.col("__p") == F.col("__q"))
            .withColumn(name, (F.col("__s") + position).cast("bigint"))
            .drop("__p", "__q", "__i", "__s"))


def global_running_sum(df: DataFrame, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Exclusive running sum along a total order over the whole table. The window spans one range
    partition, which the range cut keeps even."""
    cut = _cut_by_range(df, order)
    starts = _partition_starts(cut, {"__s": F.sum(value)})
    inside = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumn("__l", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return (local.join(F.broadcast(starts), F.col("__p") == F.col("__q"))
            .withColumn(name, F.col("__s") + F.col("__l")).drop("__p", "__q", "__s", "__l"))


def ordered_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                 name: str = "rank0") -> DataFrame:
    """0-based row number within keys along any order: the position in the table sorted by keys
    and order, minus the first position of the key."""
    placed = global_index(df, [*keys, *order], "__g")
    ranked = attach_stats(placed, keys, [F.min("__g").alias("__first")])
    return ranked.withColumn(name, F.col("__g") - F.col("__first")).drop("__g", "__first")


def exact_percentiles(df: DataFrame, value: str, points: Sequence[float],
                      tiebreak: Sequence[str] = ()) -> DataFrame:
    """One row of exact linear-interpolated percentiles ``p0, p1, …`` over a whole column."""
    ranked = global_index(df.select(value, *tiebreak).where(F.col(value).isNotNull()), [value, *tiebreak])
    placed = with_row(ranked, ranked.agg((F.count(F.lit(1)) - 1).cast("double").alias("__last")))
    aggs = []
    for i, point in enumerate(points):
        at = F.lit(float(point)) * F.col("__last")
        low = F.max(F.when(F.col("idx") == F.floor(at), F.col(value)))
        high = F.max(F.when(F.col("idx") == F.ceil(at), F.col(value)))
        share = F.max(at - F.floor(at))
        aggs.append((low + (high - low) * share).alias(f"p{i}"))
    return placed.agg(*aggs)
