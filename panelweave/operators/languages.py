"""Language of a text by character n-gram profiles, learned from labelled texts.

A text counts as its distinct words, and a word as its runs of three characters with two blanks on either
side. Runs are hashed to a fixed number of buckets, so a profile has one bounded size for any alphabet and any
corpus. Counting sends at most languages * buckets rows per task; scoring is row-local and takes the weights with
the tasks, without a join. A filter scores whole Arrow batches.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.functions.text import let
from panelweave.operators.scale import hash_text, hash_unit

register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

BUCKETS = 16_381  # a prime, so that the places of a run all count
FACTORS = (1_723, 59)
WORD = r"\p{L}{1,30}"  # longer runs of letters are cut
UNIT = 1000  # weights are whole numbers of thousandths of a nat, so that sums do not depend on their order
MOST_LANGUAGES = 64
ROWS = 500  # texts scored at once


class Profiles(NamedTuple):
    """Weights per language and bucket: how much likelier the run is than one never seen."""

    languages: tuple[str, ...]
    weights: tuple[tuple[int, ...], ...]


def padded_words(text: Column) -> Column:
    """The distinct words of a text in lower case, with two blanks on either side of each."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))
    return F.concat(F.lit("  "), F.array_join(words, "  "), F.lit("  "))


def gram_buckets(text: Column) -> Column:
    """Buckets of all runs of three characters of the distinct words of a text."""
    points = F.transform(F.split(padded_words(text), ""), lambda c: F.ascii(c))
    first, second = FACTORS

    def runs(p: Column) -> Column:
        return F.when(F.size(p) > 4, F.transform(F.sequence(F.lit(0), F.size(p) - 3), lambda i: F.pmod(
            F.get(p, i) * first + F.get(p, i + 1) * second + F.get(p, i + 2), F.lit(BUCKETS)))).otherwise(F.array().cast("array<int>"))

    return let(points, runs)


def learn_profiles(df: DataFrame, text: str, language: str, ids: Sequence[str] = (), share: float = 1.0, seed: int = 0,
                   smoothing: float = 0.5) -> Profiles:
    """Profiles of the languages named in a column; rows without one do not count. ``share`` takes that part of
    the rows by a hash of their ids, see :func:`in_share`. Relative frequencies are smoothed by the same amount in every language,
    ``smoothing`` shares of a bucket, so a run that no language has speaks for none."""
    rows = df.where(F.col(language).isNotNull())
    rows = rows if share >= 1 else rows.where(in_share(share, seed, *ids))
    counts = (rows.select(F.col(language).alias("language"), F.explode(gram_buckets(F.col(text))).alias("bucket"))
              .groupBy("language", "bucket").agg(F.count(F.lit(1)).alias("n")).limit((MOST_LANGUAGES + 1) * BUCKETS).toPandas())
    names = tuple(sorted(counts["language"].unique()))
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    least, weights = smoothing / BUCKETS, []
    for name in names:
        own = counts[counts["language"] == name]
        total, line = int(own["n"].sum()), [0] * BUCKETS
        for bucket, n in zip(own["bucket"], own["n"]):
            line[bucket] = _weight(int(n) / total, least)
        weights.append(tuple(line))
    return Profiles(names, tuple(weights))


def _weight(frequency: float, least: float) -> int:
    return math.floor(UNIT * math.log((frequency + least) / least) + 0.5)


def in_share(share: float, seed: int, *ids: str) -> Column:
    """Rows that profiles are learned from, by a hash of their ids."""
    return hash_unit(hash_text(seed, *ids)) < share


def detect_language(text: Column, profiles: Profiles, margin: float = 3.0) -> Column:
    """The likeliest language; null if the next one is less than ``margin`` nats behind, or for a text without letters."""
    if not profiles.languages:
        return F.lit(None).cast("string")
    names = F.array(*[F.lit(name) for name in profiles.languages])
    # parsed once, when the plan is optimised
    tables = [F.split(F.lit(",".join(map(str, line))), ",").cast("array<int>") for line in profiles.weights]

    def score(buckets: Column, table: Column) -> Column:
        return F.aggregate(buckets, F.lit(0).cast("bigint"), lambda total, b: total + F.get(table, b))

    def scores(buckets: Column) -> Column:
        return F.array(*[score(buckets, table) for table in tables])

    def winner(found: Column) -> Column:
        ranked = F.sort_array(found, asc=False)
        lead = ranked[0] - F.coalesce(F.get(ranked, F.lit(1)), F.lit(0))
        return F.when(lead >= round(margin * UNIT), F.element_at(names, F.array_position(found, ranked[0]).cast("int")))

    return let(let(gram_buckets(text), scores), winner)


def _winners(padded: pa.Array, weights: np.ndarray, margin: int) -> np.ndarray:
    """Place of the likeliest language of each text by its padded words, -1 where :func:`detect_language` has null.
    ``weights`` has a line per language."""
    sizes = pc.fill_null(pc.utf8_length(padded), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(t for t in padded.to_pylist() if t).encode("utf-32-le"), np.uint32)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    ends = np.where(sizes > 4, ends - 2, starts)  # of the runs that begin in a text and lie in it
    first, second = FACTORS
    buckets = (points[:-2] * np.uint32(first) + points[1:-1] * np.uint32(second) + points[2:]) % np.uint32(BUCKETS)
    scores = np.empty((len(sizes), len(weights)), np.int64)
    for i, line in enumerate(weights):
        sums = np.concatenate([[0], np.cumsum(line[buckets], dtype=np.int64)])
        scores[:, i] = sums[ends] - sums[starts]
    ranked = np.sort(scores, axis=1)
    lead = ranked[:, -1] - (ranked[:, -2] if len(weights) > 1 else 0)
    return np.where((lead >= margin) & padded.is_valid().to_numpy(zero_copy_only=False), scores.argmax(axis=1), -1)


def language_filter(df: DataFrame, text: str, languages: Sequence[str], profiles: Profiles, margin: float = 3.0) -> DataFrame:
    """Keep texts whose detected language is allowed; undetectable ones drop. The same choice as :func:`detect_language`,
    made for whole Arrow batches: words are cut by Spark, their runs are counted in numpy. Row-local."""
    if not profiles.languages:
        return df.withColumn("language", detect_language(F.col(text), profiles, margin)).where(F.lit(False))
    columns, least = [c for c in df.columns if c != "language"], round(margin * UNIT)
    weights, names = np.array(profiles.weights, np.int32), pa.array(profiles.languages, pa.string())
    allowed = np.array([*[name in languages for name in profiles.languages], False])  # the last one is null's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                found = _winners(batch.column(len(columns)), weights, least)
                kept = np.flatnonzero(allowed[found])
                picked = batch.take(pa.array(kept))
                yield pa.RecordBatch.from_arrays([*picked.columns[:-1], names.take(pa.array(found[kept]))], names=[*columns, "language"])

    rows = df.select(*[F.col(f"`{c}`") for c in columns], padded_words(F.col(text)))
    plain = rows.toDF(*[f"c{i}" for i in range(len(columns) + 1)])  # names with dots do not pass
    return plain.mapInArrow(run, T.StructType([*[df.schema[c] for c in columns], T.StructField("language", T.StringType())]))
