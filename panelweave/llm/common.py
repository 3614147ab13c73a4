"""Helpers shared by the corpus operators: column picking, words, bounded worker caches, bit filters."""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CACHE_ENTRIES = 300_000  # per worker and cache; a full cache starts again
WORD = r"[^\x20\x09-\x0D]+"


def named(name: str) -> Column:
    """A column by its literal name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def small_batches(spark: SparkSession) -> None:
    """Hand texts and sets to Python in batches of some megabytes: Spark's own 10,000 rows a batch would
    hold tens of megabytes of text several times over. Settings that the application made stay."""
    for key, value in {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}.items():
        if not spark.sparkContext.getConf().contains(key):
            spark.conf.set(key, value)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names: other columns cannot clash."""
    small_batches(df.sparkSession)
    return df.select(*[named(source).alias(target) for target, source in columns.items()])


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def byte_values(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 bytes of a text column; null counts as empty."""
    return [value or b"" for value in batch.column(name).cast(pa.binary()).to_pylist()]


def worker_store(name: str, make: Callable):
    """One object per Python worker, made on first use and kept for its later tasks."""
    store = sys.modules.setdefault("_panelweave_worker", types.ModuleType("_panelweave_worker"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)


def mix(values: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers (the splitmix64 finaliser)."""
    values = values.astype(np.uint64, copy=True)
    values ^= values >> np.uint64(30)
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


_RATE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class WordHasher:
    """64-bit hashes of all words of many texts at once. A word's hash is a polynomial of random values
    of its bytes, read off running sums over the whole buffer and scrambled with the length."""

    def __init__(self):
        self.values = mix(np.arange(1, 257, dtype=np.uint64))
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words (runs of bytes other than ASCII white space, A-Z lower-cased) of texts laid
        end to end, and the number of words of each text."""
        data = np.frombuffer(b" " + b" ".join(texts).lower() + b" ", np.uint8)
        if len(data) > len(self.up):
            size = max(len(data), 1 << 21)
            self.up, self.down = _powers(_RATE, size), _powers(pow(_RATE, -1, 1 << 64), size)
        gap = _SPACE[data]
        edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        starts, ends = edges[::2], edges[1::2]
        sums = self.values[data]
        sums *= self.up[:len(data)]
        np.cumsum(sums, out=sums)
        hashes = (sums[ends - 1] - sums[starts - 1]) * self.down[starts]
        bounds = np.cumsum([1, *[len(text) + 1 for text in texts]])
        return mix(hashes + (ends - starts).astype(np.uint64)), np.diff(np.searchsorted(starts, bounds))


def hashed_pieces(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, words per text) of pieces of at most ``most`` bytes, or one longer text."""
    hasher = worker_store("word_hasher", WordHasher)
    first, size = 0, 0
    for row, text in enumerate(texts):
        if row > first and size + len(text) > most:
            yield first, *hasher(texts[first:row])
            first, size = row, 0
        if len(text) > 4 * most:  # alone, and cut at white space
            words = np.concatenate([hasher([part])[0] for part in _parts(text, most)])
            yield row, words, np.array([len(words)])
            first, size = row + 1, 0
        else:
            size += len(text)
    if first < len(texts):
        yield first, *hasher(texts[first:])


def _parts(text: bytes, most: int) -> Iterator[bytes]:
    """Pieces of a long text of about ``most`` bytes that cut no word."""
    gap = re.compile(rb"[\x20\x09-\x0d]")
    at = 0
    while at < len(text):
        cut = gap.search(text, at + most)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive word hashes."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for i, factor in enumerate(mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)):
        total += words[i:i + count] * factor
    return mix(total)


CHUNK = 1 << 14


def add_arrays(df: DataFrame, size: int, dtype: str, chunk: int = CHUNK, combine: str = "add") -> np.ndarray:
    """Combine fixed-length arrays that tasks emit as (chunk int, data binary) rows.

    Every task sends at most ``size`` entries, whatever it read. Equal chunks meet in two steps, first those of
    some tasks, then those of all, so that no task gets one chunk from every other. The driver receives one
    array of ``size`` entries, a bound set by the caller and not by the data.
    """
    kind = np.dtype(dtype)
    merge = {"add": np.add, "or": np.bitwise_or}[combine]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(data, kind)
                held[key] = merge(held[key], part) if key in held else part
        for key, part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([part.tobytes()], pa.binary())],
                                             names=["chunk", "data"])

    chunks = -(-size // chunk)
    tasks, form = shuffle_partitions(df), "chunk int, data binary"
    some = F.pmod(F.spark_partition_id(), F.lit(max(1, tasks // chunks, int(tasks ** 0.5)))).alias("some")
    partial = df.select("chunk", "data", some).repartition(tasks, "chunk", "some").mapInArrow(fold, form)
    folded = partial.repartition(min(chunks, tasks), "chunk").mapInArrow(fold, form)
    total = np.zeros(chunks * chunk, kind)
    for row in folded.collect():  # one row per chunk
        total[row.chunk * chunk:(row.chunk + 1) * chunk] = np.frombuffer(row.data, kind)
    return total[:size]


def array_chunks(values: np.ndarray, chunk: int = CHUNK) -> tuple[list[int], list[bytes]]:
    """The non-zero chunks of an array, as rows for :func:`add_arrays`."""
    keys, data = [], []
    for start in range(0, len(values), chunk):
        part = values[start:start + chunk]
        if part.any():
            if len(part) < chunk:
                part = np.concatenate([part, np.zeros(chunk - len(part), part.dtype)])
            keys.append(start // chunk)
            data.append(part.tobytes())
    return keys, data


FLAGS_PER_KEY, LEAST_BITS, MOST_BITS = 16, 24, 28  # 2 to 32 MB


def presence_filter(df: DataFrame, column: str, bits: int | None = None) -> np.ndarray:
    """A map of 2**bits flags over the leading bits of a long column of scrambled keys. It may hold
    keys that are not there, never the reverse. Without ``bits`` its size follows the number of rows up to 32 MB;
    beyond that it only holds more keys that are not there."""
    rows = df.select(column).where(F.col(column).isNotNull())
    if bits is None:
        bits = min(MOST_BITS, max(LEAST_BITS, (FLAGS_PER_KEY * rows.count()).bit_length()))

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            at = np.unique(keys >> np.uint64(64 - bits))
            np.bitwise_or.at(seen, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        keys, data = array_chunks(seen)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(data, pa.binary())], names=["chunk", "data"])

    return add_arrays(rows.mapInArrow(flag, "chunk int, data binary"), 1 << (bits - 3), "uint8", combine="or")


def in_filter(flags: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter may hold. Its size tells how many leading bits it was made with."""
    bits = len(flags).bit_length() + 2
    at = keys.view(np.uint64) >> np.uint64(64 - bits)
    return (flags[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0
