"""Passages of at least 50 words that occur more than once, by sparse suffixes at minimiser positions.

1. Of the 35 runs of 16 words inside every 50 words, the one with the smallest hash (the leftmost of equal
   ones) is kept. Only suffixes that begin there are retained, about one in 18 words; equal passages retain
   equal suffixes, so none is missed.
2. The retained suffixes' first 16 words are sorted by their owners, and neighbours compared. A fixed-size
   filter of those that occur twice goes back to all tasks.
3. Around each such suffix the match is extended left and right: all 50-word windows whose minimiser it is
   are sent as fingerprints, sorted and compared the same way. A window that occurs twice is repeated; the
   union of a document's repeated windows are its spans.

Keys are sent once per part of at most some megabytes of text, so a passage that a third of all documents
share costs its owner one code per part. Windows are compared by 64-bit fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm import exchange
from panelweave.llm.common import byte_values, gram_hashes, hashed_pieces, in_filter, mix, pick, presence_filter, shuffle_partitions
from panelweave.session import durable

LENGTH = 50  # words of a passage
GRAM = 16  # words of a suffix that are compared first
PIECE_BYTES = 4 << 20


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest (leftmost of equal ones) of every ``width`` consecutive values."""
    n = len(values)
    if n < width:
        return np.empty(0, np.int64)
    order = np.argsort(values, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    padded = np.concatenate([rank, np.full(-n % width, n)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(padded, axis=1).ravel()
    return order[np.minimum(ahead[:n - width + 1], behind[width - 1:n])]


def windows(words: np.ndarray, sizes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents laid end to end: starts of the windows inside one document, and each one's minimiser (its
    position and key)."""
    grams = gram_hashes(words, gram)
    anchors = sliding_argmin(grams, length - gram + 1)
    inside = np.ones(len(words), bool)
    ends = np.cumsum(sizes)
    for back in range(1, length):  # starts too near their document's end
        at = ends - back
        inside[at[(at >= ends - sizes)]] = False
    starts = np.flatnonzero(inside[:len(anchors)])
    anchors = anchors[starts]
    return starts, anchors, mix(grams[anchors])  # the smallest hashes crowd at zero; mixed again they spread


def window_keys(words: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    total = np.zeros(len(starts), np.uint64)
    for i, factor in enumerate(mix(np.arange(1, length + 1, dtype=np.uint64) + np.uint64(1 << 32)) | np.uint64(1)):
        total += words[starts + i] * factor
    return mix(total)


def _pieces(batches: Iterator[pa.RecordBatch]):
    """Documents of some megabytes together, or one longer document, with their first row in the batch."""
    for batch in batches:
        for first, words, sizes in hashed_pieces(byte_values(batch, "text"), PIECE_BYTES):
            yield batch, first, words, sizes


def _suffixes(owners: int, length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (_, _, words, sizes) in enumerate(_pieces(batches)):
            _, anchors, keys = windows(words, sizes, length, gram)
            _, once = np.unique(anchors, return_index=True)
            yield exchange.messages(part, keys[once], owners)
    return run


def _extensions(flags, length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for number, (batch, first, words, sizes) in enumerate(_pieces(batches)):
            starts, _, keys = windows(words, sizes, length, gram)
            starts = starts[in_filter(flags.value, keys)]
            keys = window_keys(words, starts, length)
            opens = np.cumsum(sizes) - sizes
            doc = np.searchsorted(opens, starts, side="right") - 1
            rows, cuts = np.unique(doc, return_index=True)
            cuts = [*cuts.tolist(), len(doc)]
            relative = (starts - opens[doc]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(first + rows)), pa.array(np.full(len(rows), base + number)),
                pa.array(first + rows), pa.array(sizes[rows]),
                pa.array([relative[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary()),
                pa.array([keys[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary()),
            ], names=["doc_id", "part", "row", "n_words", "starts", "keys"])
    return run


def _send(owners: int):
    """Messages of each part; a part's rows lie together in one partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for at, data in zip(batch.column("part").to_pylist(), batch.column("keys").to_pylist()):
                if at != part and held:
                    yield exchange.messages(part, np.frombuffer(b"".join(held), np.uint64), owners)
                    held = []
                part = at
                held.append(data)
        if held:
            yield exchange.messages(part, np.frombuffer(b"".join(held), np.uint64), owners)
    return run


def _runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Union of [start, start + length) of sorted starts, touching ones merged."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.concatenate([[0], breaks + 1])].tolist(), (starts[np.concatenate([breaks, [len(starts) - 1]])] + length).tolist()))


def _spans(owners: int, length: int):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("row").to_numpy(), kind="stable")
        rows = rows.take(pa.array(order))
        data = rows.column("keys").to_pylist()
        keys = np.frombuffer(b"".join(data), np.uint64)
        repeated, first = exchange.marks(keys, answers, owners)
        cuts = np.cumsum([0, *[len(d) // 8 for d in data]])
        out = []
        for i, starts in enumerate(rows.column("starts").to_pylist()):
            starts, span = np.frombuffer(starts, np.int32), slice(cuts[i], cuts[i + 1])
            again, later = starts[repeated[span]], starts[repeated[span] & ~first[span]]
            if len(again):
                out.append((i, _runs(again, length), _runs(later, length)))
        kept = rows.take(pa.array([o[0] for o in out], pa.int64()))
        pairs = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

        def spans(k: int) -> pa.Array:
            return pa.array([[{"begin": a, "end": b} for a, b in o[k]] for o in out], pairs)

        return pa.table([kept.column("doc_id"), kept.column("n_words"), spans(1), spans(2)], names=["doc_id", "n_words", "repeated", "dropped"])
    return run


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, filter_bits: int | None = None) -> DataFrame:
    """One row per document with repeated passages: doc_id, n_words, repeated, dropped.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. ``repeated`` lists the maximal
    word spans [begin, end) made of ``length``-word windows that occur at least twice in the table, in other
    documents or in the same one; ``dropped`` those without each window's first occurrence (first in the
    order of scan). Null, empty and short texts have none and are not listed, nor are documents without
    repeats. Rows that repeat an id count as documents of their own. Texts are read whole. Extra columns are
    ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    source = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.col("text").cast("string").alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    owners = shuffle_partitions(docs)
    shared = durable(exchange.to_owners(source.mapInArrow(_suffixes(owners, length, gram), exchange.MESSAGE), owners)
                     .mapInArrow(exchange.repeated_keys, "key long"))
    flags = spark.sparkContext.broadcast(presence_filter(shared, "key", filter_bits))
    rows = durable(source.mapInArrow(_extensions(flags, length, gram),
                                     f"doc_id {id_type}, part long, row long, n_words long, starts binary, keys binary"))
    answers = (exchange.to_owners(rows.select("part", "keys").mapInArrow(_send(owners), exchange.MESSAGE), owners)
               .mapInArrow(exchange.answer, exchange.ANSWER))
    span = "array<struct<begin:long,end:long>>"
    return rows.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(
        _spans(owners, length), f"doc_id {id_type}, n_words long, repeated {span}, dropped {span}")
