"""Quality scores: random Fourier features over document statistics, ridge by normal equations, isotonic calibration.

1. One pass over the whole texts gives every document a short vector of statistics; the vectors alone go
   to the checkpoint folder.
2. Cosines of random projections approximate a Gaussian kernel on the standardised vectors. Every task sums
   its labelled rows' normal equations, one block per fold; the driver receives the sums (their size is
   set by FEATURES alone) and solves.
3. Each fold is scored by the model of the other folds; these scores and labels are counted on a grid of
   20,001 steps and fitted by pool-adjacent-violators, which turns raw scores into probabilities.

Labels, language, source and id are never inputs. Rows whose crc32 of the id modulo 5 is 0 are never learned from.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import add_arrays, array_chunks, byte_values, named, pick
from panelweave.operators.scale import hash_text
from panelweave.session import durable

FEATURES = 256
RIDGE = 1.0
FOLDS = 5  # fold 0 is held out
THRESHOLD = 0.3
STEPS = 10_000  # grid steps per unit of raw score, from -0.5 to 1.5
STATISTICS = 17
_UPPER, _DIGIT, _MARKS = bytes(range(65, 91)), bytes(range(48, 58)), b"#$%&*@^~<>{}[]_=+\\/"
_HIGH = bytes(range(128, 256))


def statistics(text: bytes) -> list[float]:
    """Statistics of one whole text; an empty text has zeros."""
    words = text.split()
    if not words:
        return [0.0] * STATISTICS
    n, size = len(words), len(text)

    def share(signs: bytes) -> float:
        return size - len(text.translate(None, signs))

    lines = text.split(b"\n")
    letters = max(1, size - text.count(b" ") - len(lines) + 1)
    same = sum(map(operator.eq, words, words[1:]))
    closed = sum(line.rstrip().endswith((b".", b"!", b"?")) for line in lines)
    return [
        np.log1p(n), np.log(letters / n), np.log(max(map(len, words))),
        np.sqrt(share(_UPPER) / letters), np.sqrt(share(_DIGIT) / letters), np.sqrt(share(_MARKS) / letters),
        np.sqrt(share(_HIGH) / letters), np.sqrt(text.count(b"!") / n), np.sqrt(text.count(b"|") / n),
        np.sqrt(text.count(b".") / n), np.sqrt(text.count(b",") / n), np.sqrt(same / n),
        len(set(words)) / n, np.log1p(n / len(lines)), closed / len(lines),
        np.sqrt(share(b"\"'();:-") / letters), 1.0,
    ]


def projection(size: int, inputs: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and phases for a Gaussian kernel of width sqrt(inputs)."""
    rng = np.random.default_rng(seed)
    return rng.normal(size=(inputs, size)) / np.sqrt(inputs), rng.uniform(0, 2 * np.pi, size)


def fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, size: int) -> np.ndarray:
    """Bounded random features of rows of statistics, with a constant in front."""
    frequencies, phases = projection(size, x.shape[1])
    z = np.cos(np.clip((x - mean) / scale, -6, 6) @ frequencies + phases) * np.sqrt(2 / size)
    return np.hstack([np.ones((len(x), 1)), z * np.sqrt(size) / 4])


def isotonic(x: np.ndarray, weight: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centres and means of the non-decreasing blocks of sorted points."""
    blocks: list[list[float]] = []  # weight, sum of y, sum of x
    for xi, wi, yi in zip(x, weight, y):
        blocks.append([wi, wi * yi, wi * xi])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    table = np.array(blocks).reshape(-1, 3)
    return table[:, 2] / table[:, 0], table[:, 1] / table[:, 0]


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    values = batch.column("x").values.to_numpy(zero_copy_only=False) if batch.num_rows else np.empty(0)
    return values.reshape(-1, STATISTICS)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        table = np.array([statistics(text) for text in byte_values(batch, "text")], np.float64).reshape(-1, STATISTICS)
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1) * STATISTICS, pa.int32()), pa.array(table.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), vectors], names=["doc_id", "x"])


def vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    source = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.col("text").cast("string").alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(_vectors, f"doc_id {id_type}, x array<double>")


def fold(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0)) % FOLDS


class Model:
    """Ridge weights with their calibration curve."""

    def __init__(self, mean, scale, weights, knots, levels, size):
        self.mean, self.scale, self.weights = mean, scale, weights
        self.knots, self.levels, self.size = knots, levels, size

    def raw(self, x: np.ndarray) -> np.ndarray:
        return fourier(x, self.mean, self.scale, self.size) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        level = np.interp(raw, self.knots, self.levels) if len(self.knots) else np.full(len(raw), 0.5)
        return 0.998 * level + 0.002 / (1 + np.exp(-4 * (raw - 0.5)))  # the small term orders ties of one block


def train(x: DataFrame, labels: DataFrame, label_col: str = "quality", size: int = FEATURES, ridge: float = RIDGE,
          most_rows: int | None = None) -> Model:
    """Fit on labelled documents whose fold is not 0. ``x`` has doc_id and x (see :func:`vectors`).

    All such rows are used; ``most_rows`` bounds them, chosen by a hash of the id, if given. Null labels are
    left out; several labels of one id count as their mean. Without any label every score is 0.5.
    """
    moments = x.agg(*[f(F.col("x")[i]).alias(f"{n}{i}") for i in range(STATISTICS) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([moments[f"m{i}"] or 0.0 for i in range(STATISTICS)])
    scale = np.array([moments[f"s{i}"] or 1.0 for i in range(STATISTICS)])
    truth = (pick(labels, doc_id="doc_id", label=label_col).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (fold() != 0))
             .groupBy("doc_id").agg(F.avg("label").alias("label")))
    if most_rows is not None:
        truth = truth.orderBy(hash_text("quality", "doc_id")).limit(most_rows)
    rows = durable(x.join(truth, "doc_id").select("x", "label", fold().cast("int").alias("fold")))
    side = size + 2  # constant, features, label

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, side, side))
        for batch in batches:
            z = np.hstack([fourier(_rows(batch), mean, scale, size), batch.column("label").to_numpy(zero_copy_only=False)[:, None]])
            folds = batch.column("fold").to_numpy(zero_copy_only=False)
            for k in range(1, FOLDS):
                part = z[folds == k]
                total[k] += part.T @ part
        keys, data = array_chunks(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(data, pa.binary())], names=["chunk", "data"])

    total = add_arrays(rows.mapInArrow(sums, "chunk int, data binary"), FOLDS * side * side, "float64").reshape(FOLDS, side, side)
    penalty = np.diag([1e-6, *[ridge] * size])

    def solve(system: np.ndarray) -> np.ndarray:
        return np.linalg.solve(system[:-1, :-1] + penalty, system[:-1, -1])

    everything = total.sum(axis=0)
    if not everything[0, 0]:
        return Model(mean, scale, np.zeros(size + 1), np.empty(0), np.empty(0), size)
    weights = solve(everything)
    others = {k: solve(everything - total[k]) if (everything - total[k])[0, 0] else weights for k in range(1, FOLDS)}

    def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = fourier(_rows(batch), mean, scale, size)
            folds = batch.column("fold").to_numpy(zero_copy_only=False)
            raw = np.zeros(len(z))
            for k, w in others.items():
                raw[folds == k] = z[folds == k] @ w
            step = np.clip(np.rint(raw * STEPS), -STEPS // 2, STEPS * 3 // 2).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(step), batch.column("label")], names=["step", "label"])

    curve = (rows.mapInArrow(unseen, "step int, label double").groupBy("step")
             .agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("y")).orderBy("step").toPandas())
    knots, levels = isotonic(curve["step"].to_numpy() / STEPS, curve["n"].to_numpy(), curve["y"].to_numpy())
    return Model(mean, scale, weights, knots, np.clip(levels, 0, 1), size)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          threshold: float = THRESHOLD, most_rows: int | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted.

    Null and empty texts are scored by their (zero) statistics; texts of any length are read whole. A null
    id counts as held out. Rows that repeat an id are scored one by one; extra columns are ignored; an empty
    table gives an empty result.
    """
    x = durable(vectors(docs, id_col, text_col))
    model = train(x, labels, label_col, most_rows=most_rows)  # a few kilobytes, sent with the tasks
    id_type = x.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score(_rows(batch)) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return x.mapInArrow(run, f"doc_id {id_type}, score double").select(
        "doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents the classifier accepts, with all their columns; the model is applied in one more pass
    over the texts, without a shuffle."""
    model = train(durable(vectors(docs, id_col, text_col)), labels)

    def run(text: pd.Series) -> pd.Series:
        table = np.array([statistics(value.encode()) for value in text], np.float64).reshape(-1, STATISTICS)
        return pd.Series(model.score(table) >= threshold)

    keep = F.pandas_udf(run, "boolean")
    return docs.where(keep(F.coalesce(named(text_col).cast("string"), F.lit(""))))
