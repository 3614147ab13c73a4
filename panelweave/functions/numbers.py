"""Number helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column, digits: int) -> Column:
    """Round half up on the binary value; unlike round() it is the same in every engine."""
    factor = float(10 ** digits)
    return (F.floor(value * factor + 0.5) / factor).cast("double")


def clamp_rate(rate: Column) -> Column:
    """Rates must lie strictly between 0 and 1."""
    # fixed values: replacement rates for the two ends
    return F.when(rate <= 0, F.lit(0.05)).when(rate >= 1, F.lit(0.95)).otherwise(rate)


def mean_of_present(*values: Column) -> Column:
    """Mean over the non-null arguments, null when all are null."""
    filled = [F.when(v.isNotNull() & ~F.isnan(v.cast("double")), v.cast("double")) for v in values]
    total = sum((F.coalesce(v, F.lit(0.0)) for v in filled), F.lit(0.0))
    present = sum((v.isNotNull().cast("int") for v in filled), F.lit(0))
    return F.when(present > 0, total / present)
