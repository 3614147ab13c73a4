"""Sub-word tokens of texts by a given byte-level merge table, with their places in the text.

The table comes from a public vocabulary file and is never trained here. It has a fixed size, so every worker
holds it; texts are encoded where they lie, without a shuffle, and each distinct piece of text is merged once per
worker as long as its bounded cache lasts.
"""

from __future__ import annotations

import base64
import heapq
import sys
import types
from array import array
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.functions.text import IGNORE, let

register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

# fixed value: how the vocabulary's texts are cut before merging
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MOST_TOKENS = 1_000_000  # of a vocabulary that workers hold
CACHE_PIECES = 200_000
SHORT_PIECE = 96  # bytes up to which a plain scan for the next pair is quicker
LONG_TEXT = 1 << 20
SPAN = "array<struct<begin: int, end: int>>"


class Merges(NamedTuple):
    """A vocabulary on the workers. Ids from ``size`` on are free, ``begin``, ``end`` and ``pad`` are the first three."""

    table: Broadcast
    size: int

    @property
    def begin(self) -> int:
        return self.size

    @property
    def end(self) -> int:
        return self.size + 1

    @property
    def pad(self) -> int:
        return self.size + 2


def read_merges(spark: SparkSession, path: str) -> Merges:
    """A vocabulary file with a base64 token and its rank per line, as on the driver's disk."""
    ranks: dict[bytes, int] = {}
    with open(path, "rb") as lines:
        for line in lines:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
            if len(ranks) > MOST_TOKENS:
                raise ValueError(f"a vocabulary of more than {MOST_TOKENS} tokens")
    lacking = [b for b in range(256) if bytes([b]) not in ranks]
    if lacking:
        raise ValueError("not a byte-level vocabulary: some bytes are no token")
    return Merges(spark.sparkContext.broadcast(ranks), max(ranks.values()) + 1)


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The piece's bytes with adjacent tokens joined, always the pair of lowest rank, the leftmost of equal ones. A
    piece that is a token itself is one."""
    if piece in ranks:
        return [piece]
    return _merged_short(piece, ranks) if len(piece) <= SHORT_PIECE else _merged_long(piece, ranks)


def _merged_short(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    get, never = ranks.get, MOST_TOKENS << 8
    tokens = [piece[i:i + 1] for i in range(len(piece))]
    pairs = [get(piece[i:i + 2], never) for i in range(len(piece) - 1)]
    while pairs and (low := min(pairs)) < never:
        i = pairs.index(low)
        tokens[i:i + 2] = [tokens[i] + tokens[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(tokens[i] + tokens[i + 1], never)
        if i:
            pairs[i - 1] = get(tokens[i - 1] + tokens[i], never)
    return tokens


def _merged_long(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The same with linked tokens and a heap of pairs, so that a long piece costs n log n."""
    tokens: list[bytes | None] = [piece[i:i + 1] for i in range(len(piece))]
    after, before = list(range(1, len(piece) + 1)), list(range(-1, len(piece) - 1))

    def pair(i: int) -> tuple[int, int, bytes] | None:
        if i < 0 or after[i] >= len(tokens):
            return None
        both = tokens[i] + tokens[after[i]]
        return (ranks[both], i, both) if both in ranks else None

    heap = [p for p in map(pair, range(len(tokens))) if p]
    heapq.heapify(heap)
    while heap:
        _, i, both = heapq.heappop(heap)
        if tokens[i] is None or after[i] >= len(tokens) or tokens[i] + tokens[after[i]] != both:
            continue  # one of the two has been joined with another one
        gone = after[i]
        tokens[i], tokens[gone], after[i] = both, None, after[gone]
        if after[i] < len(tokens):
            before[after[i]] = i
        for start in (before[i], i):
            if (p := pair(start)):
                heapq.heappush(heap, p)
    return [t for t in tokens if t is not None]


def _places(tokens: list[bytes]) -> list[tuple[int, int]]:
    """Characters that each token touches, counted from the piece's start."""
    out, seen = [], 0
    for token in tokens:
        leads = sum(b & 0xC0 != 0x80 for b in token)
        out.append((seen - (token[0] & 0xC0 == 0x80), seen + leads))
        seen += leads
    return out


class Encoder:
    """Merged pieces of one worker."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.cut, self.cache = ranks, regex.compile(PIECES), {}

    def pieces(self, text: str) -> Iterator[str]:
        return self.cut.findall(text) if len(text) < LONG_TEXT else (m[0] for m in self.cut.finditer(text))

    def piece(self, piece: str) -> tuple[tuple[int, ...], tuple[int, ...], tuple[int, ...]]:
        """Ids and first and last places of a piece, kept for the next time."""
        tokens = merged(piece.encode("utf-8"), self.ranks)
        ends = tuple(accumulate(map(len, tokens)))
        if piece.isascii():
            begins = (0, *ends[:-1])
        else:
            begins, ends = zip(*_places(tokens))
        found = tuple(map(self.ranks.__getitem__, tokens)), begins, ends
        if len(self.cache) >= CACHE_PIECES:
            self.cache.clear()
        if len(piece) <= 64:
            self.cache[piece] = found
        return found

    def encode(self, text: str, most: int | None, ids: array, begins: array | None, ends: array | None) -> int:
        """Append a text's tokens, the first ``most`` of them if given; the number appended."""
        start, at, cache = len(ids), 0, self.cache
        for piece in self.pieces(text):
            found = cache.get(piece) or self.piece(piece)
            ids.extend(found[0])
            if begins is not None:
                begins.extend([at + b for b in found[1]])
                ends.extend([at + e for e in found[2]])
                at += len(piece)
            if most is not None and len(ids) - start >= most:
                for column in (ids, begins, ends):
                    if column is not None:
                        del column[start + most:]
                break
        return len(ids) - start


def _encoder(table: Broadcast, name: str) -> Encoder:
    """One encoder per Python worker, as long as its tasks use the same vocabulary."""
    store = sys.modules.setdefault("_panelweave_subwords", types.ModuleType("_panelweave_subwords"))
    if getattr(store, "name", None) != name:
        store.name, store.encoder = name, Encoder(table.value)
    return store.encoder


def with_tokens(df: DataFrame, text: str, merges: Merges, length: int | None = None, ids: str = "ids", spans: str | None = None) -> DataFrame:
    """Add the token ids of a text, the first ``length`` of them if given, and, as ``spans``, the characters that each
    token touches (begin inclusive, end exclusive). A null or empty text has no tokens. No token is unknown: joining the
    tokens' bytes gives the text back. Row-local."""
    table, name, columns = merges.table, f"{df.sparkSession.sparkContext.applicationId}-{merges.table._jbroadcast.id()}", df.columns
    added = [T.StructField(ids, T.ArrayType(T.LongType()))]
    if spans:
        added.append(T.StructField(spans, T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(table, name)
        for batch in batches:
            found, bounds = array("q"), [0]
            begins, ends = (array("i"), array("i")) if spans else (None, None)
            for value in batch.column(columns.index(text)).to_pylist():
                bounds.append(bounds[-1] + encoder.encode(value or "", length, found, begins, ends))
            offsets = pa.array(bounds, pa.int32())
            more = [pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(found, np.int64)))]
            if spans:
                pairs = pa.StructArray.from_arrays([pa.array(np.frombuffer(c, np.int32)) for c in (begins, ends)], names=["begin", "end"])
                more.append(pa.ListArray.from_arrays(offsets, pairs))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*columns, ids, *([spans] if spans else [])])

    plain = df.toDF(*[f"c{i}" for i in range(len(columns))])  # names with dots do not pass
    return plain.mapInArrow(run, T.StructType([*df.schema.fields, *added]))


def decode(ids: list[int], merges: Merges) -> str:
    """The text of some ids; ids beyond the vocabulary are skipped. For looking at rows, on the driver."""
    tokens = {rank: token for token, rank in merges.table.value.items()}
    return b"".join(tokens[i] for i in ids if i in tokens).decode("utf-8", "replace")


def labels_answer_span(ids: Column, spans: Column, text: Column, answer: Column) -> Column:
    """Ids of the tokens that touch the answer's characters plus one more, the ignore label elsewhere. Tokens may begin
    inside a word; an answer that begins beyond the last token, or is not in the text, has no labels, one that ends
    beyond it is labelled to the end."""
    start = F.instr(text, answer) - 1  # -1 when absent
    stop = start + F.length(answer)

    def first_of(hit: Column) -> Column:
        return F.array_position(hit, True)  # 1-based, 0 when none

    def chosen(bounds: Column) -> Column:
        first, last = bounds[0], F.when(bounds[1] > 0, bounds[1] + 1).otherwise(F.size(ids).cast("bigint"))
        return F.transform(ids, lambda x, i: F.when((first > 0) & (i + 1 >= first) & (i + 1 <= last), x).otherwise(F.lit(IGNORE).cast("bigint")))

    found = F.array(first_of(F.transform(spans, lambda s: (s["begin"] <= start) & (start < s["end"]) & (start >= 0))),
                    first_of(F.transform(spans, lambda s: (s["begin"] < stop) & (stop <= s["end"]) & (start >= 0))))
    return let(found, chosen)
