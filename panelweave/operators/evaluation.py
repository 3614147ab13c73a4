"""Metrics of predictions per experiment (or any other keys)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.operators.scale import attach_stats, global_running_sum, null_safe_join, with_row


def filter_experiments(config: DataFrame, model_parts: Sequence[str], model: str = "llm_name", **fields) -> DataFrame:
    """Experiments whose model name holds any of the parts and whose fields are among the given."""
    hit = F.lit(False)
    for part in model_parts:
        hit = hit | F.contains(F.col(model), F.lit(part))
    out = config.where(hit)
    for name, allowed in fields.items():
        out = out.where(F.col(name).isin(*allowed))
    return out


def accuracy(df: DataFrame, by: Sequence[str], label: str = "related", pred: str = "pred") -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(label) == F.col(pred)).cast("int")).alias("accuracy"))


def prf(df: DataFrame, by: Sequence[str], classes: Sequence[str] = ("Yes",), label: str = "related",
        pred: str = "pred", empty: float | None = None) -> DataFrame:
    """Precision, recall and F1 per class; ``empty`` replaces a missing denominator."""
    aggs, cells = [], []
    for c in classes:
        hit, said, true = F.col(label) == c, F.col(pred) == c, F.col(label) == c
        aggs += [F.sum((hit & said).cast("int")).alias(f"__tp_{c}"), F.sum(said.cast("int")).alias(f"__p_{c}"),
                 F.sum(true.cast("int")).alias(f"__t_{c}")]
        tp, p, t = F.col(f"__tp_{c}"), F.col(f"__p_{c}"), F.col(f"__t_{c}")
        for name, value in (("precision", F.try_divide(tp, p)), ("recall", F.try_divide(tp, t)),
                            ("f1", F.try_divide(2 * tp, p + t))):
            cells.append((value if empty is None else F.coalesce(value, F.lit(empty))).alias(f"{name}_{c}".lower()))
    return df.groupBy(*by).agg(*aggs).select(*by, *cells)


def roc_auc(df: DataFrame, by: Sequence[str], truth: str, score: str) -> DataFrame:
    """Area under the curve with ties counted half. Rows collapse to one per distinct score; the
    negatives below a score are a running sum over the range-cut (experiment, score) order, so no
    experiment has to fit one task."""
    counts = df.groupBy(*by, score).agg(
        F.sum((F.col(truth) == 1).cast("bigint")).alias("__pos"),
        F.sum((F.col(truth) == 0).cast("bigint")).alias("__neg"))
    running = global_running_sum(counts, [*by, score], "__neg", "__before")
    # negatives of earlier experiments are the same constant on all rows of this one
    placed = attach_stats(running, by, [F.min("__before").alias("__base")])
    won = F.sum(F.col("__pos") * (F.col("__before") - F.col("__base") + F.col("__neg") / 2))
    return placed.groupBy(*by).agg(
        F.try_divide(won, F.sum("__pos").cast("double") * F.sum("__neg").cast("double")).alias("roc_auc"))


def calibration(df: DataFrame, by: Sequence[str], truth: str, score: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.abs(F.col(truth) - F.col(score))).alias("calibration"))


def brier(df: DataFrame, by: Sequence[str], truth: str, score: str) -> DataFrame:
    gap = F.col(truth) - F.col(score)
    return df.groupBy(*by).agg(F.avg(gap * gap).alias("brier"))


def all_metrics(df: DataFrame, by: Sequence[str], label: str = "related", pred: str = "pred",
                truth: str = "truth", score: str = "p_yes") -> DataFrame:
    """Every metric by the same keys, in two aggregations."""
    gap = F.col(truth) - F.col(score)
    tp = F.sum(((F.col(label) == "Yes") & (F.col(pred) == "Yes")).cast("int"))
    said, true = F.sum((F.col(pred) == "Yes").cast("int")), F.sum((F.col(label) == "Yes").cast("int"))
    flat = df.groupBy(*by).agg(
        F.avg((F.col(label) == F.col(pred)).cast("int")).alias("accuracy"),
        F.try_divide(tp, said).alias("precision"), F.try_divide(tp, true).alias("recall"),
        F.try_divide(2 * tp, said + true).alias("f1"),
        F.avg(F.abs(gap)).alias("calibration"), F.avg(gap * gap).alias("brier"))
    return null_safe_join(flat, roc_auc(df, by, truth, score), by)


def exp_table(metrics: DataFrame, config: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Metrics with the configuration, best accuracy first."""
    return metrics.join(config.select(key, *fields), key).orderBy(F.desc("accuracy"), key)


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """Counts in equal-width bins between the extremes; the top value falls in the last bin."""
    ends = df.agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"))
    placed = with_row(df.where(F.col(col).isNotNull()), ends)
    width = F.col("__hi") - F.col("__lo")
    spot = F.coalesce(F.floor(F.try_divide(F.col(col) - F.col("__lo"), width) * bins), F.lit(0))
    return placed.groupBy(F.least(spot, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
