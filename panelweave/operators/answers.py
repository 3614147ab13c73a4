"""Ensembles of parsed answers to one result per pair. Every aggregate is a plain sum, mean or
maximum, so partial aggregation carries a pair with very many members."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.answers import LABELS, argmax_label, expected_scale
from panelweave.functions.numbers import half_up


def normalise_answers(df: DataFrame, keys: Sequence[str], answer: str, logprob: str) -> DataFrame:
    """Token log-probabilities to answer probabilities that sum to 1 per key; several tokens of an
    answer (spelling variants) add up."""
    per_answer = df.groupBy(*keys, answer).agg(F.sum(F.exp(logprob)).alias("__p"))
    # one row per candidate answer is left, so the window over a key is small
    total = F.sum("__p").over(Window.partitionBy(*keys))
    return per_answer.select(*keys, answer, (F.col("__p") / total).alias("probability"))


def relabel(df: DataFrame, option: str, labels: Mapping[str, str], reverse: str) -> DataFrame:
    """Option number to label, the two labels swapped on reversed prompts."""
    names = list(labels)
    swapped = {names[0]: labels[names[1]], names[1]: labels[names[0]]}
    out = F.lit(None).cast("string")
    for number in names:
        out = F.when(F.col(option) == number, F.when(F.col(reverse), F.lit(swapped.get(number, labels[number])))
                     .otherwise(F.lit(labels[number]))).otherwise(out)
    return df.withColumn("label", out)


def agg_mode(df: DataFrame, keys: Sequence[str], member: str, probs: Column,
             labels: Sequence[str] = LABELS) -> DataFrame:
    """Most frequent top label of the members; a tie goes to the label seen first."""
    top = df.withColumn("__l", argmax_label(probs, labels))
    counted = top.groupBy(*keys).agg(*[x for i, name in enumerate(labels) for x in (
        F.sum((F.col("__l") == name).cast("int")).alias(f"__n{i}"),
        F.min(F.when(F.col("__l") == name, F.col(member))).alias(f"__m{i}"))])
    ranked = F.array_compact(F.array(*[
        F.when(F.col(f"__m{i}").isNotNull(), F.struct((-F.col(f"__n{i}")).alias("n"), F.col(f"__m{i}").alias("m"),
                                                      F.lit(name).alias("label")))
        for i, name in enumerate(labels)]))
    return counted.select(*keys, F.array_min(ranked)["label"].alias("mode"))


def agg_distribution(df: DataFrame, keys: Sequence[str], probs: Column,
                     labels: Sequence[str] = LABELS) -> DataFrame:
    """Members scaled to sum 1, then averaged per label, three decimals."""
    scaled = df.withColumn("__t", F.aggregate(F.map_values(probs), F.lit(0.0), lambda a, p: a + p))
    return scaled.groupBy(*keys).agg(*[
        half_up(F.avg(F.coalesce(probs[name], F.lit(0.0)) / F.col("__t")), 3).alias(name) for name in labels])


def agg_expected(df: DataFrame, keys: Sequence[str], probs: Column, top: int) -> DataFrame:
    """Mean over members of the expected scale value, and its share of the scale."""
    mean = F.avg(expected_scale(probs))
    return df.groupBy(*keys).agg(half_up(mean, 3).alias("mean"), half_up(mean / top, 3).alias("scaled_mean"))


def agg_scale(df: DataFrame, keys: Sequence[str], digit: str, top: int) -> DataFrame:
    """Mean of the digits found, 0 when none was found, and its share of the scale."""
    mean = F.coalesce(F.avg(digit), F.lit(0.0))
    return df.groupBy(*keys).agg(half_up(mean, 3).alias("mean"), half_up(mean / top, 3).alias("scaled_mean"))


def average_certainty(df: DataFrame, keys: Sequence[str], certainty: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(certainty).alias("certainty"))
