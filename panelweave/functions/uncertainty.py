"""Certainty measures of label distributions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plogp(p: Column) -> Column:
    return F.when(p > 0, p * F.ln(p)).otherwise(F.lit(0.0))


def certainty_binary(yes: Column, no: Column) -> Column:
    """1 minus the base-2 entropy of (yes, no) after scaling both to sum 1."""
    total = yes + no
    return F.lit(1.0) + (_plogp(yes / total) + _plogp(no / total)) / F.ln(F.lit(2.0))


def certainty(probs: Column) -> Column:
    """1 plus the sum of p·log(p), the base being the number of categories (zeros count)."""
    total = F.aggregate(F.map_values(probs), F.lit(0.0), lambda acc, p: acc + _plogp(p))
    return F.when(F.size(probs) > 1, F.lit(1.0) + total / F.ln(F.size(probs).cast("double"))).otherwise(
        F.lit(1.0))
