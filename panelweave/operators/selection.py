"""Values at given positions of an order, by histograms that are refined where the positions lie.

Nothing is sorted and no row moves: each pass counts numbers into ``BINS`` equal parts of a range, with each
part's smallest and largest number, and the next pass looks only into the parts that hold a position. The driver
gets at most ``BINS`` counts a pass and at most ``FEW`` numbers of a part at the end.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.operators.scale import hash_text

BINS = 1 << 16
FEW = 4096  # numbers of one part that are fetched and ordered on the driver
FLOATING = (T.FloatType, T.DoubleType)


def order_statistics(df: DataFrame, value: Column, positions: Sequence[int]) -> dict[int, tuple]:
    """For 0-based positions in the rising order of a numeric column: (number there, how many are smaller, how many are
    not larger). Nulls and NaN do not count; positions beyond the table are left out."""
    rows = df.select(value.alias("v")).where("v IS NOT NULL")
    if isinstance(rows.schema["v"].dataType, FLOATING):
        rows = rows.where(~F.isnan("v"))
    whole = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n")).first()
    wanted = sorted({p for p in positions if 0 <= p < whole.n})
    return _within(rows, whole.lo, whole.hi, whole.n, 0, wanted) if wanted else {}


def _within(rows: DataFrame, lo, hi, count: int, below: int, positions: list[int]) -> dict[int, tuple]:
    """Positions among ``count`` numbers from lo to hi, with ``below`` smaller ones elsewhere."""
    if lo == hi:
        return dict.fromkeys(positions, (lo, below, below + count))
    inside = rows.where(F.col("v").between(F.lit(lo), F.lit(hi)))
    if count <= FEW:
        found, out = sorted(r.v for r in inside.collect()), {}
        for p in positions:
            at = found[p - below]
            out[p] = at, below + sum(v < at for v in found), below + sum(v <= at for v in found)
        return out
    # parts rise with the numbers; the first and the last number never share one, so every pass narrows the range
    if isinstance(rows.schema["v"].dataType, FLOATING):
        share, width = _float_scale(lo, hi)
    else:
        share, width = (F.col("v").cast("decimal(38,10)") - F.lit(lo).cast("decimal(38,10)")).cast("double"), F.lit(float(hi - lo))
    part = F.when(F.col("v") == F.lit(hi), F.lit(BINS - 1)).otherwise(F.least(F.floor(share / width * (BINS - 1)), F.lit(BINS - 2)))
    parts = inside.groupBy(part.alias("part")).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    out: dict[int, tuple] = {}
    for p in sorted(parts, key=lambda p: p.lo):
        own = [x for x in positions if below <= x < below + p.n]
        if own:
            out |= _within(inside, p.lo, p.hi, p.n, below, own)
        below += p.n
    return out


def _float_scale(lo: float, hi: float) -> tuple[Column, Column]:
    """Distance of a number from lo and of hi from lo: as it is if lo and hi are of one size, else on a scale of logarithms, so
    that numbers of very different size take few passes. Both never fall as numbers rise (Java's logarithm is
    semi-monotonic)."""
    number = F.col("v").cast("double")
    if lo > 0 and hi / lo < 1e4 or hi < 0 and lo / hi < 1e4:
        return number / 2 - F.lit(lo / 2), F.lit(hi / 2 - lo / 2 or 1.0)  # halves keep the difference finite

    def scaled(v: float) -> float:
        return math.copysign(math.log(abs(v)) + 710, v) if abs(v) >= 1e-308 else 0.0

    place = F.when(F.abs(number) < 1e-308, F.lit(0.0)).otherwise(F.signum(number) * (F.log(F.abs(number)) + 710))
    return F.greatest(place - F.lit(scaled(lo)), F.lit(0.0)), F.lit(scaled(hi) - scaled(lo) or 1.0)


def percentiles(df: DataFrame, value: str, points: Sequence[float]) -> list[float | None]:
    """Exact linear-interpolated percentiles of a whole column, null without numbers."""
    real = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    last = real.count() - 1
    if last < 0:
        return [None] * len(points)
    found = order_statistics(real, F.col(value), [f(point * last) for point in points for f in (math.floor, math.ceil)])
    out = []
    for point in points:
        at = point * last
        low, high = found[math.floor(at)][0], found[math.ceil(at)][0]
        out.append(low + (high - low) * (at - math.floor(at)))
    return out


def smallest_by_hash(df: DataFrame, n: int, ids: Sequence[str], seed: int | str) -> DataFrame:
    """The n rows whose ids, which make rows unique, have the smallest hashes, all when there are no more: a filter on the
    rows, found by order statistics of the first 60 bits of the hash and, where the last place is shared, by the rest
    of it and the ids."""
    if n <= 0:
        return df.limit(0)
    hexed = hash_text(seed, *ids)
    number = F.conv(F.substring(hexed, 1, 15), 16, 10).cast("bigint")
    found = order_statistics(df, number, [n - 1])
    if not found:
        return df
    bound, smaller, upto = found[n - 1]
    if upto == n:
        return df.where(number <= bound)
    ties = df.where(number == bound).select(hexed.alias("h"), *ids).orderBy("h", *ids).limit(n - smaller).collect()  # rows that share 60 bits
    chosen = F.lit(False)
    for row in ties:
        one = F.lit(True)
        for c in ids:
            one = one & F.col(c).eqNullSafe(F.lit(row[c]))
        chosen = chosen | one
    return df.where((number < bound) | (number == bound) & chosen)
