"""Yearly panels: adjustment, trends, refinement, gap filling, schedules.

A panel is unique on (series, period), so one series holds at most as many rows as there
are periods; windows over a series are bounded whatever the table size.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.operators.scale import null_safe_join, with_row
from panelweave.operators.smoothing import fitted_posterior, posterior_mean, prefix_means

# the two Arrow functions below, with what they call, travel to the workers by value
register_pickle_by_value(sys.modules[__name__])


def deflate(df: DataFrame, prices: DataFrame, people: DataFrame, t: str, val: str, base: int,
            area: Sequence[str] = ()) -> DataFrame:
    """value × price(base) / price(year) / population. ``prices`` is (t, cpi); ``people`` is
    (area…, t, population)."""
    at_base = prices.where(F.col(t) == base).agg(F.max("cpi").alias("__base"))
    factors = with_row(prices, at_base).select(t, (F.col("__base") / F.col("cpi")).alias("__f"))
    # few years: null-safe keys give the panel an exchange that can be split
    joined = null_safe_join(df, factors, [t], "inner", nulls_match=False)
    joined = null_safe_join(joined, people, [*area, t], "inner", nulls_match=False)
    return joined.withColumn("adjusted", F.col(val) * F.col("__f") / F.col("population")).drop("__f", "population")


def line_fit(panel: DataFrame, keys: Sequence[str], x: Column, y: str, where: Column | None = None) -> DataFrame:
    """Least-squares slope and intercept per series from centred moments, so that large, nearly constant values keep
    their digits; null with fewer than two different points."""
    keep = F.col(y).isNotNull() if where is None else (where & F.col(y).isNotNull())
    xx = F.when(keep, x.cast("double"))
    yy = F.when(keep, F.col(y).cast("double"))
    return panel.groupBy(*keys).agg(F.regr_slope(yy, xx).alias("slope"), F.regr_intercept(yy, xx).alias("intercept"), F.avg(yy).alias("mean"))


def detrend(panel: DataFrame, key: str, t: str, val: str, train_end: int) -> DataFrame:
    """Remove the training line and add the training mean back. The fitted values average to the
    training mean, so later periods keep their value. With fewer than two training points there is
    no line to remove and values stay."""
    position = F.col(t) - train_end
    fit = line_fit(panel, [key], position, val, F.col(t) <= train_end)
    line = F.col("intercept") + F.col("slope") * position
    removed = F.coalesce(F.col(val) - line + F.col("mean"), F.col(val))
    return null_safe_join(panel, fit, [key]).withColumn(
        "detrended", F.when(F.col(t) <= train_end, removed).otherwise(F.col(val))
    ).drop("slope", "intercept", "mean")


def refine(panel: DataFrame, key: str, t: str, val: str, k: int, first: int, last: int) -> DataFrame:
    """Each year but the last becomes k periods of value/k; the last one full period."""
    parts = F.when(F.col(t) < last, F.sequence(F.lit(0), F.lit(k - 1))).otherwise(F.array(F.lit(0)))
    split = panel.where(F.col(t).between(first, last)).withColumn("__i", F.explode(parts))
    return split.select(key, ((F.col(t) - first) * k + F.col("__i")).cast("int").alias("period"),
                        F.when(F.col(t) < last, F.col(val) / k).otherwise(F.col(val)).alias("amount"))


def refine_repeat(panel: DataFrame, key: str, t: str, val: str, periods: int, first: int, last: int) -> DataFrame:
    """Each year repeated ⌊periods / years⌋ times, undivided."""
    k = periods // (last - first + 1)
    split = panel.where(F.col(t).between(first, last)).withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return split.select(key, ((F.col(t) - first) * k + F.col("__i")).cast("int").alias("period"),
                        F.col(val).alias("amount"))


def period_slice(schedule: DataFrame, y0: int, y1: int, k: int, base: int, t: str = "period") -> DataFrame:
    """Periods that belong to the years y0 to y1 when period 0 starts year ``base``."""
    return schedule.where(F.col(t).between((y0 - base) * k, (y1 - base + 1) * k - 1))


def normalise(panel: DataFrame, key: str, t: str, val: str, train_end: int, worst: Sequence[str] = (),
              best: Sequence[str] = (), invert: str | None = None) -> DataFrame:
    """Scale to [0, 1] by the stated bounds widened with what the training years show."""
    train = F.when(F.col(t) <= train_end, F.col(val))
    seen = panel.groupBy(key).agg(F.min(train).alias("__lo"), F.max(train).alias("__hi"))
    joined = panel.join(seen, key)
    lo = F.least(*[F.col(c) for c in worst], F.col("__lo")) if worst else F.col("__lo")
    hi = F.greatest(*[F.col(c) for c in best], F.col("__hi")) if best else F.col("__hi")
    scaled = F.try_divide(F.col(val) - lo, hi - lo)
    if invert:
        scaled = F.when(F.col(invert) == 1, 1 - scaled).otherwise(scaled)
    return joined.withColumn("scaled", scaled).drop("__lo", "__hi")


def scale_fixed(df: DataFrame, val: str, lo: float = -2.5, hi: float = 2.5) -> DataFrame:
    """Scale by fixed bounds widened with the extremes of the whole column."""
    seen = df.agg(F.least(F.min(val), F.lit(lo)).alias("__lo"), F.greatest(F.max(val), F.lit(hi)).alias("__hi"))
    return with_row(df, seen).withColumn(
        "scaled", (F.col(val) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).drop("__lo", "__hi")


def _endpoint_inputs(panel: DataFrame, key: str, t: str, val: str, target: int) -> DataFrame:
    # distance to the target keeps the sums small; the fit at the target is the intercept
    fit = line_fit(panel, [key], F.col(t) - target, val)
    seen = F.when(F.col(val).isNotNull(), F.col(t))
    edge = panel.groupBy(key).agg(F.min_by(val, seen).alias("first_value"), F.max_by(val, seen).alias("last_value"))
    return edge.join(fit, key).withColumnRenamed("intercept", "fitted")


def endpoint(panel: DataFrame, key: str, t: str, val: str, target: int) -> DataFrame:
    """Last observation, or the fitted line at the target period when it equals the first."""
    ready = _endpoint_inputs(panel, key, t, val, target)
    return ready.select(key, F.when(F.col("last_value") == F.col("first_value"),
                                    F.coalesce("fitted", "last_value")).otherwise(F.col("last_value")).alias("final"))


def endpoint_floor(panel: DataFrame, key: str, t: str, val: str, target: int) -> DataFrame:
    """Last observation when above the first; otherwise the fit, but never below the first."""
    ready = _endpoint_inputs(panel, key, t, val, target)
    return ready.select(key, F.when(F.col("last_value") > F.col("first_value"), F.col("last_value")).otherwise(
        F.greatest("fitted", "first_value")).alias("final"))


def _years_as_array(panel: DataFrame, key: str, t: str, val: str, years: Sequence[int]) -> DataFrame:
    cells = [F.max(F.when(F.col(t) == y, F.col(val))) for y in years]
    return panel.where(F.col(t).between(min(years), max(years))).groupBy(key).agg(F.array(*cells).alias("__y"))


def _as_rows(arrays: DataFrame, key: str, t: str, columns: dict[str, str], years: Sequence[int]) -> DataFrame:
    zipped = F.arrays_zip(F.array(*[F.lit(y) for y in years]).alias("y"), *[F.col(c) for c in columns.values()])
    return arrays.select(key, F.explode(zipped).alias("__z")).select(
        key, F.col("__z.y").alias(t), *[F.col(f"__z.{c}").alias(n) for n, c in columns.items()])


def gap_fill(panel: DataFrame, key: str, t: str, val: str, years: Sequence[int],
             method: str = "kernel") -> DataFrame:
    """Fill missing years per series; observed values stay. ``kernel`` takes the posterior mean of
    a Gaussian process with fixed parameters over centred values, ``fitted`` that with each series' own constant, length
    scale and noise, by marginal likelihood, and adds its spread at imputed years as ``sd``, ``linear`` interpolates and
    holds the ends."""
    years = list(years)
    if method == "linear":
        return _gap_fill_linear(panel, key, t, val, years)
    if method not in ("kernel", "fitted"):
        raise ValueError(f"no such method: {method}")

    axis, fitted = np.array(years), method == "fitted"

    @F.pandas_udf("struct<filled: array<double>, sd: array<double>>")
    def smooth(rows: pd.Series) -> pd.DataFrame:
        grid = np.array([list(r) for r in rows], dtype=float).reshape(len(rows), len(axis))
        spread = np.full(grid.shape, np.nan)
        known = ~np.isnan(grid)
        patterns, which = np.unique(known, axis=0, return_inverse=True)
        which = which.ravel()
        for i, mask in enumerate(patterns):  # series with the same known years together
            members = which == i
            if mask.any() and not mask.all():
                own = grid[members][:, mask]
                mean, sd = fitted_posterior(axis, mask, own) if fitted else (posterior_mean(axis, mask, own), np.nan)
                grid[members] = np.where(mask, grid[members], mean)
                spread[members] = np.where(mask, np.nan, sd)
        return pd.DataFrame({"filled": list(grid), "sd": list(spread)})

    arrays = _years_as_array(panel, key, t, val, years).withColumn("__s", smooth("__y")).select(
        key, "__y", F.col("__s.filled").alias("__filled"), F.col("__s.sd").alias("__sd"))
    rows = _as_rows(arrays, key, t, {"observed": "__y", "filled": "__filled", "sd": "__sd"}, years)
    return rows.select(key, t, F.coalesce("observed", F.nanvl("filled", F.lit(None))).alias(val),
                       F.col("observed").isNull().alias("imputed"), *([F.nanvl("sd", F.lit(None)).alias("sd")] if fitted else []))


def _gap_fill_linear(panel: DataFrame, key: str, t: str, val: str, years: Sequence[int]) -> DataFrame:
    rows = _as_rows(_years_as_array(panel, key, t, val, years), key, t, {"observed": "__y"}, years)
    back = Window.partitionBy(key).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy(t).rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("observed").isNotNull(), F.struct(F.col(t).alias("x"), F.col("observed").alias("y")))
    near = rows.withColumn("__l", F.last(known, ignorenulls=True).over(back)).withColumn(
        "__r", F.first(known, ignorenulls=True).over(ahead))
    share = (F.col(t) - F.col("__l.x")) / (F.col("__r.x") - F.col("__l.x"))
    between = F.col("__l.y") + (F.col("__r.y") - F.col("__l.y")) * share
    filled = F.coalesce(F.col("observed"), between, F.col("__l.y"), F.col("__r.y"))
    return near.select(key, t, filled.alias(val), F.col("observed").isNull().alias("imputed"))


def forecast(panel: DataFrame, key: str, t: str, val: str, years: Sequence[int],
             keep_rising: bool = False) -> DataFrame:
    """From the first fall onward take the smoothed continuation of the earlier years, never below
    the observed value. Series without a fall are left out unless ``keep_rising``."""
    axis = np.array(list(years))

    @F.pandas_udf("array<double>")
    def continued(rows: pd.Series) -> pd.Series:
        if len(rows) == 0:
            return rows
        grid = np.array([list(r) for r in rows], dtype=float)
        falls = np.diff(grid, axis=1) < 0
        falling = falls.any(axis=1)
        start = falls[falling].argmax(axis=1) + 1
        if falling.any():
            own, later = grid[falling], np.arange(len(axis)) >= start[:, None]
            grid[falling] = np.where(later, np.fmax(prefix_means(axis, own, start), own), own)
        return pd.Series([row if keep_rising or fell else None for row, fell in zip(grid, falling)])

    arrays = _years_as_array(panel, key, t, val, years).withColumn("__f", continued("__y")).where("__f IS NOT NULL")
    return _as_rows(arrays, key, t, {val: "__f"}, years)


def hold_last(schedule: DataFrame, key: str, t: str, val: str, periods: int) -> DataFrame:
    """Repeat the last period's amount."""
    last = schedule.groupBy(key).agg(F.max_by(val, t).alias(val))
    return last.select(key, F.explode(F.sequence(F.lit(0), F.lit(periods - 1))).alias(t), val)


def grow(schedule: DataFrame, t: str, val: str, periods: int, lo: float = 0.0, hi: float = 2.0) -> DataFrame:
    """Multiply by 1 plus an even rise from lo to hi."""
    rate = F.lit(1.0 + lo) + F.lit(hi - lo) * F.col(t) / F.lit(float(periods - 1))
    return schedule.withColumn(val, F.col(val) * rate)


def downsample(schedule: DataFrame, key: str, t: str, k: int) -> DataFrame:
    """Every k-th period counted back from the last one of the series."""
    last = schedule.groupBy(key).agg(F.max(t).alias("__last"))
    return schedule.join(last, key).where((F.col("__last") - F.col(t)) % k == 0).drop("__last")


def gap_compare(base: DataFrame, alt: DataFrame, key: str) -> DataFrame:
    """Distance to the goal in both runs for series that miss it in the baseline.
    ``base`` is (key, goal, final), ``alt`` is (key, final)."""
    other = alt.select(key, F.col("final").alias("__alt"))
    gap = F.col("goal") - F.col("final")
    return base.join(other, key).where(gap > 0).select(
        key, gap.alias("gap_base"), (F.col("goal") - F.col("__alt")).alias("gap_scenario"))
