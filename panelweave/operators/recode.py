"""Reshaping, recoding and filtering."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.operators.scale import attach_stats, null_safe_join

MOST_KEYS = 10_000  # columns that a pivot may find in the data


def to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], var: str, val: str) -> DataFrame:
    return df.unpivot(list(ids), list(values), var, val)


def _key_values(df: DataFrame, key: str, values: Sequence | None) -> list:
    """The given keys, else all keys of the data but null. Each becomes a column; too many raise."""
    if values is not None:
        return list(values)
    found = df.select(key).where(F.col(key).isNotNull()).distinct().limit(MOST_KEYS + 1).collect()
    if len(found) > MOST_KEYS:
        raise ValueError(f"{key} has more than {MOST_KEYS} values; list those that shall become columns")
    return sorted(r[0] for r in found)


def _guard_stray(columns: list[Column], kinds: list, names: list[str], key: str, values: list,
                 listed: bool) -> list[Column]:
    """Columns of a pivot, the first of which raises when a row's key is not among the values. A null key counts
    as such if the caller listed the values."""
    known = F.coalesce(F.col(key).isin(*values), F.lit(not listed))
    stray = F.count(F.when(~known, F.lit(1))) > 0
    message = F.lit(f"a {key} that is not among the listed ones")
    first = F.when(stray, F.raise_error(message).cast(kinds[0])).otherwise(columns[0])
    return [c.alias(n) for c, n in zip([first, *columns[1:]], names)]


def to_wide(df: DataFrame, ids: Sequence[str], key: str, val: str, values: Sequence | None = None,
            strict: bool = True) -> DataFrame:
    """Long to wide in one aggregation. Without ``values`` every key of the data but null gets a column (at most
    ``MOST_KEYS``, else it raises); a row with a null key then adds nothing but its ids. With ``strict`` a
    repeated (ids, key) and a key outside given ``values``, null included, raise."""
    listed, values = values is not None, _key_values(df, key, values)
    if not values:
        return df.select(*ids).distinct()
    columns = []
    kind = df.schema[val].dataType
    for v in values:
        hit = F.col(key) == F.lit(v)
        cell = F.max(F.when(hit, F.col(val)))
        if strict:
            cell = F.when(F.count(F.when(hit, F.lit(1))) > 1,
                          F.raise_error(F.lit(f"more than one row for {key}={v}")).cast(kind)).otherwise(cell)
        columns.append(cell)
    names = [str(v) for v in values]
    if strict:
        return df.groupBy(*ids).agg(*_guard_stray(columns, [kind], names, key, values, listed))
    return df.groupBy(*ids).agg(*[c.alias(n) for c, n in zip(columns, names)])


def to_wide_mean(df: DataFrame, ids: Sequence[str], key: str, val: str, values: Sequence | None = None,
                 strict: bool = True) -> DataFrame:
    """Long to wide, duplicates averaged, rows with a null id dropped. Keys as in :func:`to_wide`."""
    listed, values = values is not None, _key_values(df, key, values)
    if not values:
        return df.na.drop(subset=list(ids)).select(*ids).distinct()
    columns = [F.avg(F.when(F.col(key) == F.lit(v), F.col(val))) for v in values]
    names = [str(v) for v in values]
    named = (_guard_stray(columns, ["double"], names, key, values, listed) if strict
             else [c.alias(n) for c, n in zip(columns, names)])
    return df.na.drop(subset=list(ids)).groupBy(*ids).agg(*named)


def spread_numbered(df: DataFrame, key: str, val: str, prefix: str, n: int | None = None) -> DataFrame:
    """Distinct values of a key in sorted order as prefix1 … prefixN. N is the most values any key
    has, unless given; more than a given N raise."""
    distinct = df.select(key, val).where(F.col(val).isNotNull()).distinct()
    if n is None:
        counts = distinct.groupBy(key).agg(F.count(F.lit(1)).alias("c"))
        n = counts.agg(F.max("c")).first()[0] or 0
    if n == 0:
        return distinct.select(key)
    window = Window.partitionBy(key).orderBy(val)
    # the rank limit is pushed below the shuffle, so at most n+1 rows per key and task move
    numbered = distinct.withColumn("__n", F.row_number().over(window)).where(F.col("__n") <= n + 1)
    kind = df.schema[val].dataType
    cells = [F.max(F.when(F.col("__n") == i, F.col(val))).alias(f"{prefix}{i}") for i in range(1, n + 1)]
    cells[-1] = F.when(F.max("__n") > n, F.raise_error(F.lit(f"more than {n} values")).cast(kind)).otherwise(
        F.max(F.when(F.col("__n") == n, F.col(val)))).alias(f"{prefix}{n}")
    return numbered.groupBy(key).agg(*cells)


def keep_years(df: DataFrame, period: str, lo: int, hi: int, out: str = "year") -> DataFrame:
    """YYYY0000 periods to years, restricted to a closed range."""
    return df.withColumn(out, F.expr(f"CAST({period} DIV 10000 AS INT)")).where(F.col(out).between(lo, hi))


def fill_sentinel(df: DataFrame, value, columns: Sequence[str]) -> DataFrame:
    return df.na.fill(value, subset=list(columns))


def drop_negative_series(df: DataFrame, key: str, period: str, val: str, last_checked: int) -> DataFrame:
    """Drop series with a negative value in any period up to the last checked one."""
    bad = df.where((F.col(val) < 0) & (F.col(period) <= last_checked)).select(key).distinct()
    return df.join(bad, key, "left_anti")


def recode(df: DataFrame, col: str, mapping: Mapping[str, object] | DataFrame, out: str) -> DataFrame:
    """Dictionary lookup, unmatched to null. A dictionary of any size becomes a (key, value) table;
    Spark broadcasts it while it is small."""
    if not isinstance(mapping, DataFrame):
        kind = df.schema[col].dataType.simpleString()
        values = "bigint" if all(isinstance(v, int) for v in mapping.values()) else "string"
        mapping = df.sparkSession.createDataFrame(list(mapping.items()), f"k {kind}, v {values}")
        if values == "bigint":
            mapping = mapping.select("k", F.col("v").cast("int"))
    renamed = mapping.toDF("__mk", "__mv")
    return df.join(renamed, F.col(col) == F.col("__mk"), "left").withColumn(out, F.col("__mv")).drop("__mk", "__mv")


def apply_rules(df: DataFrame, target: str, rules: Sequence[tuple[Column, object]],
                default: Column | None = None) -> DataFrame:
    """Ordered conditional assignment; a later rule overrides an earlier one."""
    out = default if default is not None else F.lit(None)
    for condition, value in rules:
        out = F.when(condition, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return df.withColumn(target, out)


def flag_any(df: DataFrame, name: str, tests: Sequence[Column]) -> DataFrame:
    """1 when any test holds; a null test counts as false."""
    hit = F.lit(False)
    for test in tests:
        hit = hit | F.coalesce(test, F.lit(False))
    return df.withColumn(name, hit.cast("int"))


def drop_where(df: DataFrame, *conditions: Column) -> DataFrame:
    """Drop rows where all conditions hold; null counts as false."""
    hit = F.lit(True)
    for condition in conditions:
        hit = hit & F.coalesce(condition, F.lit(False))
    return df.where(~hit)


def drop_where_negating_first(df: DataFrame, first: Column, second: Column) -> DataFrame:
    """The literal variant of a conjunctive drop in which only the first operand is negated:
    keeps rows where (not first) and second."""
    return df.where(~F.coalesce(first, F.lit(False)) & F.coalesce(second, F.lit(False)))


def prefer_class(df: DataFrame, keys: Sequence[str], col: str, order: Sequence[str]) -> DataFrame:
    """Keys with several classes keep the first one of ``order`` they have."""
    rank = F.lit(None).cast("int")
    for i, name in enumerate(order):
        rank = F.when(F.col(col) == name, F.lit(i)).otherwise(rank)
    ranked = df.withColumn("__r", rank)
    known = attach_stats(ranked, keys, [F.min(col).alias("__lo"), F.max(col).alias("__hi"),
                                        F.min("__r").alias("__best")])
    single = F.col("__lo").isNull() | (F.col("__lo") == F.col("__hi"))
    return known.where(single | (F.col("__r") == F.col("__best"))).drop("__r", "__lo", "__hi", "__best")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once: a violation report."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def restrict_to(df: DataFrame, allowed: DataFrame, keys: Sequence[str], nulls_match: bool = False) -> DataFrame:
    return null_safe_join(df, allowed.select(*keys).distinct(), keys, "left_semi", nulls_match)
