"""Which 64-bit keys occur more than once in a distributed table, by exchanging sorted compressed keys.

A part (a piece of a partition) sends its sorted distinct keys to owners, cut by key range and Golomb-Rice
coded, each with a flag for keys it holds twice itself. An owner sorts what it got, compares neighbours and
answers every part with bitmaps. A key costs an owner one code per part at most, however often it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MESSAGE = "owner int, part long, codes binary, twice binary"
ANSWER = "owner int, part long, repeated binary, first binary"


def rice_encode(values: np.ndarray) -> bytes:
    """Sorted distinct 64-bit numbers as Golomb-Rice coded gaps: quotients in unary, then remainders."""
    if not len(values):
        return b""
    gaps = np.diff(values, prepend=values[:1])
    shift = max(0, (int(values[-1] - values[0]) // len(values)).bit_length() - 1)
    quotients = (gaps >> np.uint64(shift)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.ones(int(ends[-1]) + 1, bool)
    unary[ends] = False
    low = gaps & np.uint64((1 << shift) - 1)
    bits = np.unpackbits(low.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - shift:]
    head = np.array([len(values), shift, len(unary), values[0]], np.uint64).tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(bits.ravel()).tobytes()


def rice_count(code: bytes) -> int:
    """How many numbers a code holds."""
    return int(np.frombuffer(code, np.uint64, 1)[0]) if code else 0


def rice_decode(code: bytes) -> np.ndarray:
    if not code:
        return np.empty(0, np.uint64)
    head = np.frombuffer(code, np.uint64, 4)
    count, shift, length = (int(x) for x in head[:3])
    body = np.frombuffer(code, np.uint8, offset=32)
    cut = -(-length // 8)
    ends = np.flatnonzero(np.unpackbits(body[:cut], count=length) == 0)
    quotients = np.diff(ends, prepend=-1) - 1
    bits = np.zeros((count, 64), np.uint8)
    bits[:, 64 - shift:] = np.unpackbits(body[cut:], count=count * shift).reshape(count, shift)
    low = np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)
    return head[3] + np.cumsum((quotients.astype(np.uint64) << np.uint64(shift)) + low, dtype=np.uint64)


def bitmap(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def flags_of(data: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=int(count)).astype(bool)


def cuts_of(keys: np.ndarray, owners: int) -> np.ndarray:
    """Bounds of each owner's range in sorted keys."""
    owner = ((keys >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)
    return np.searchsorted(owner, np.arange(owners + 1))


def messages(part: int, keys: np.ndarray, owners: int) -> pa.RecordBatch:
    """One part's keys for all owners."""
    own, counts = np.unique(keys, return_counts=True)
    cuts = cuts_of(own, owners)
    filled = [i for i in range(owners) if cuts[i] < cuts[i + 1]]
    return pa.RecordBatch.from_arrays([
        pa.array(filled, pa.int32()), pa.array([part] * len(filled), pa.int64()),
        pa.array([rice_encode(own[cuts[i]:cuts[i + 1]]) for i in filled], pa.binary()),
        pa.array([bitmap(counts[cuts[i]:cuts[i + 1]] > 1) for i in filled], pa.binary()),
    ], names=["owner", "part", "codes", "twice"])


def to_owners(sent: DataFrame, owners: int) -> DataFrame:
    """Messages, each owner's in a partition of its own: a hash of so few numbers would put several owners in one."""
    return sent.repartitionById(owners, "owner")


def _received(batches: Iterator[pa.RecordBatch]):
    """Messages in the order of their parts, where each one's keys end among all keys laid end to end, the order that
    sorts these, the sorted keys, and for each of them: does it occur more than once, and is it the first of its equals.

    All arrays are as long as the keys: what is held does not grow with the number of messages times that of keys.
    """
    rows = sorted(row for batch in batches for row in zip(*[batch.column(n).to_pylist() for n in ("part", "owner", "codes", "twice")]))
    ends = np.cumsum([0, *[rice_count(codes) for _, _, codes, _ in rows]])
    keys, again = np.empty(ends[-1], np.uint64), np.empty(ends[-1], bool)
    for a, b, (_, _, codes, flags) in zip(ends, ends[1:], rows):
        keys[a:b], again[a:b] = rice_decode(codes), flags_of(flags, b - a)
    order = np.argsort(keys, kind="stable")
    keys, again = keys[order], again[order]
    same = keys[1:] == keys[:-1]  # neighbours in the sorted order
    again[1:] |= same
    again[:-1] |= same
    first = np.ones(len(keys), bool)
    first[1:] = ~same
    return rows, ends, order, keys, again, first


def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per message: which of its keys are repeated, and for which of them it is the first part of all."""
    rows, ends, order, _, again, begins = _received(batches)
    if not rows:
        return
    repeated, first = np.empty_like(again), np.empty_like(begins)
    repeated[order], first[order] = again, begins
    yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int32()), pa.array([r[0] for r in rows], pa.int64()),
                                      *[pa.array([bitmap(flags[a:b]) for a, b in zip(ends, ends[1:])], pa.binary()) for flags in (repeated, first)]],
                                     names=["owner", "part", "repeated", "first"])


def repeated_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys that are repeated, as long."""
    _, _, _, keys, again, first = _received(batches)
    yield pa.RecordBatch.from_arrays([pa.array(keys[again & first].view(np.int64))], names=["key"])


def marks(keys: np.ndarray, answers: pa.Table, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """For each key of a part: is it repeated, and is this its first occurrence in the whole table."""
    own, begin, place = np.unique(keys, return_index=True, return_inverse=True)
    cuts = cuts_of(own, owners)
    repeated, first = np.zeros(len(own), bool), np.zeros(len(own), bool)
    for at, a, b in zip(*[answers.column(n).to_pylist() for n in ("owner", "repeated", "first")]):
        span = slice(cuts[at], cuts[at + 1])
        repeated[span], first[span] = flags_of(a, cuts[at + 1] - cuts[at]), flags_of(b, cuts[at + 1] - cuts[at])
    opens = np.zeros(len(keys), bool)
    opens[begin] = first
    return repeated[place], opens
