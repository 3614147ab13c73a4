"""Line dedup: sharded minimal perfect hash tables that documents probe, instead of a join of lines.

1. Every task counts, for each distinct line key (128-bit hash) of a piece of its documents, the documents
   that hold it, and sends (key, count) to the shard of the key's range.
2. A shard sums the counts. Over the keys found in enough documents it builds a minimal perfect hash, which
   indexes two compact arrays: 48 bits of fingerprint and the count. A shard is one row of bytes.
3. Arrays are cut by range to at most GROUP_BYTES and packed into groups of that size. Per group, documents pass a task once, hash their
   lines and probe the arrays; flags of lines to drop travel with the document from group to group. One
   group is the usual case; what is broadcast never exceeds GROUP_BYTES, however many lines are frequent.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import byte_values, mix, pick, shuffle_partitions
from panelweave.session import durable

LEAST_DOCUMENTS = 10
LEAST_CHARACTERS = 1
GROUP_BYTES = 64 << 20
PIECE_LINES = 1 << 18
_LOAD = 1.5  # slots per key on each level


class PerfectHash:
    """Minimal perfect hash by levels of bits: a key is placed on the first level where no other key shares
    its slot; its number is the count of bits before it. ``find`` gives unknown keys any number or -1."""

    def __init__(self, keys: np.ndarray):
        self.sizes: list[int] = []
        self.bits: list[np.ndarray] = []
        self.starts: list[np.ndarray] = []
        total, level = 0, 0
        while len(keys):
            size = max(64, int(len(keys) * _LOAD))
            slot = self._slots(keys, level, size)
            alone = np.bincount(slot, minlength=size) == 1
            self.sizes.append(size)
            self.bits.append(np.packbits(alone, bitorder="little"))
            per_word = np.add.reduceat(alone.astype(np.int64), np.arange(0, size, 512))
            self.starts.append(total + np.cumsum(per_word) - per_word)
            total += int(alone.sum())
            keys = keys[~alone[slot]]
            level += 1
        self.count = total

    @staticmethod
    def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        spread = mix(keys + np.uint64((level * 0x9E3779B97F4A7C15) % (1 << 64)))
        return ((spread >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        for level, (size, bits, starts) in enumerate(zip(self.sizes, self.bits, self.starts)):
            slot = self._slots(keys[rest], level, size)
            hit = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
            at = slot[hit]
            block = at >> 9
            padded = np.concatenate([bits, np.zeros(64, np.uint8)])
            window = padded[(block << 6)[:, None] + np.arange(64)]
            place = at & 511
            full = np.arange(64) < (place >> 3)[:, None]
            before = np.bitwise_count(window * full).sum(axis=1, dtype=np.int64)
            partial = padded[at >> 3] & ((1 << (at & 7)) - 1).astype(np.uint8)
            out[rest[hit]] = starts[block] + before + np.bitwise_count(partial)
            rest = rest[~hit]
        return out


class Shard:
    """Frequent line keys of one hash range."""

    def __init__(self, first: np.ndarray, second: np.ndarray, counts: np.ndarray):
        self.hash = PerfectHash(first)
        place = self.hash.find(first)
        self.low, self.high = np.zeros(len(first), np.uint32), np.zeros(len(first), np.uint16)
        self.counts = np.zeros(len(first), np.uint32)
        self.low[place], self.high[place] = second & np.uint64(0xFFFFFFFF), (second >> np.uint64(32)) & np.uint64(0xFFFF)
        self.counts[place] = np.minimum(counts, 0xFFFFFFFF)

    def documents(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Documents that hold each key, 0 for keys below the threshold."""
        place = self.hash.find(first)
        same = (place >= 0) & (self.low[place] == (second & np.uint64(0xFFFFFFFF))) & (self.high[place] == ((second >> np.uint64(32)) & np.uint64(0xFFFF)))
        return np.where(same, self.counts[place], 0)

    def state(self) -> tuple:
        return self.hash.sizes, self.hash.bits, self.hash.starts, self.hash.count, self.low, self.high, self.counts

    @classmethod
    def of(cls, state: tuple) -> Shard:
        shard, table = cls.__new__(cls), PerfectHash.__new__(PerfectHash)
        table.sizes, table.bits, table.starts, table.count, shard.low, shard.high, shard.counts = state
        shard.hash = table
        return shard


def line_keys(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    import xxhash

    digest = xxhash.xxh3_128_digest
    pairs = np.frombuffer(b"".join([digest(line) for line in lines]), ">u8").reshape(-1, 2).astype(np.uint64)
    return pairs[:, 0], pairs[:, 1]


def shard_of(first: np.ndarray, shards: int) -> np.ndarray:
    return (((first >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def _summed(first: np.ndarray, second: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with their counts added."""
    if not len(first):
        return first, second, counts
    order = np.lexsort((second, first))
    first, second, counts = first[order], second[order], counts[order]
    new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
    at = np.flatnonzero(new)
    return first[at], second[at], np.add.reduceat(counts, at)


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (least <= 1 or len(key.decode()) >= least)


def _count(shards: int, least: int):
    def message(keys: list[bytes]) -> pa.RecordBatch:
        first, second = line_keys(keys)
        first, second, counts = _summed(first, second, np.ones(len(first), np.int64))
        cuts = np.searchsorted(shard_of(first, shards), np.arange(shards + 1))
        filled = [i for i in range(shards) if cuts[i] < cuts[i + 1]]
        return pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), *[
            pa.array([values[cuts[i]:cuts[i + 1]].tobytes() for i in filled], pa.binary()) for values in (first, second, counts.astype(np.uint32))]],
            names=["shard", "first", "second", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        for batch in batches:
            for text in byte_values(batch, "text"):
                held += {key for line in text.split(b"\n") if _long_enough(key := line.strip().lower(), least)}
                if len(held) > PIECE_LINES:
                    yield message(held)
                    held = []
        if held:
            yield message(held)
    return run


def _blobs(first: np.ndarray, second: np.ndarray, counts: np.ndarray, most: int) -> Iterator[bytes]:
    """Arrays over sorted distinct keys with the range they cover, halved until each has at most ``most`` bytes or one key."""
    blob = pickle.dumps((first[0], first[-1], Shard(first, second, counts).state()))
    if len(blob) <= most or len(first) == 1:
        yield blob
        return
    half = len(first) // 2
    yield from _blobs(first[:half], second[:half], counts[:half], most)
    yield from _blobs(first[half:], second[half:], counts[half:], most)


def _build(least: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[bytes]]] = {}
        for batch in batches:
            for shard, *data in zip(*[batch.column(n).to_pylist() for n in ("shard", "first", "second", "counts")]):
                for kept, piece in zip(held.setdefault(shard, [[], [], []]), data):
                    kept.append(piece)
        for shard, data in held.items():
            first, second, counts = (np.frombuffer(b"".join(pieces), kind) for pieces, kind in zip(data, (np.uint64, np.uint64, np.uint32)))
            first, second, counts = _summed(first, second, counts.astype(np.int64))
            frequent = counts >= least
            # two keys that share their first half cannot share a perfect hash: the later ones get a table of their own
            first, second, counts = first[frequent], second[frequent], counts[frequent]
            number = 0
            while len(first):
                begin = np.concatenate([[True], first[1:] != first[:-1]])
                for blob in _blobs(first[begin], second[begin], counts[begin], most):
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([(shard << 32) + number], pa.int64()),
                                                      pa.array([len(blob)], pa.int64()), pa.array([blob], pa.binary())],
                                                     names=["shard", "number", "size", "blob"])
                    number += 1
                first, second, counts = first[~begin], second[~begin], counts[~begin]
    return run


def _probe(tables, shards: int, least: int, last: bool):
    """Add flags of lines to drop; with the last group also cut the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_shard: dict[int, list[tuple]] = {}
        for shard, blob in (tables.value if tables else []):
            low, high, state = pickle.loads(blob)
            by_shard.setdefault(shard, []).append((low, high, Shard.of(state)))
        for batch in batches:
            texts = byte_values(batch, "text")
            split = [text.split(b"\n") for text in texts]
            sizes = np.array([len(lines) for lines in split], np.int64)
            flags = [data for data in batch.column("flags").to_pylist()]
            drop = np.concatenate([np.zeros(n, bool) if f is None else np.unpackbits(np.frombuffer(f, np.uint8), count=n).astype(bool)
                                   for n, f in zip(sizes, flags)] or [np.zeros(0, bool)])
            if by_shard and len(drop):
                keys = [line.strip().lower() for lines in split for line in lines]
                first, second = line_keys(keys)
                shard = shard_of(first, shards)
                order = np.argsort(shard, kind="stable")
                bounds = np.searchsorted(shard[order], np.arange(shards + 1))
                for i, own in by_shard.items():
                    at = order[bounds[i]:bounds[i + 1]]
                    for low, high, table in own:
                        inside = at[(first[at] >= low) & (first[at] <= high)]
                        drop[inside] |= table.documents(first[inside], second[inside]) > 0
                drop &= np.array([_long_enough(key, least) for key in keys])
            cuts = np.cumsum([0, *sizes])
            if not last:
                packed = [np.packbits(drop[i:j]).tobytes() for i, j in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(packed, pa.binary())], names=["doc_id", "text", "flags"])
                continue
            kept, dropped = [], []
            for text, lines, i, j in zip(texts, split, cuts, cuts[1:]):
                own = drop[i:j]
                n = int(own.sum())
                dropped.append(n)
                kept.append(text if not n else b"\n".join([line for line, gone in zip(lines, own.tolist()) if not gone]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                                             names=["doc_id", "n_lines", "n_dropped", "kept_text"])
    return run


def drop_frequent(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_documents: int = LEAST_DOCUMENTS,
                  least_characters: int = LEAST_CHARACTERS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_text.

    Lines are split at \\n; a line's key has ASCII white space stripped at both ends and A-Z lower-cased. Keys
    of at least ``least_characters`` code points found in at least ``least_documents`` documents lose all
    their lines. Null and empty texts are one empty line, which stays while keys need a character. A key
    counts once per document however often it occurs; rows that repeat an id are documents of their own.
    Very long texts are read whole; extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    source = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.col("text").cast("string").alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    shards = shuffle_partitions(docs)
    tables = durable(source.mapInArrow(_count(shards, least_characters), "shard int, first binary, second binary, counts binary")
                     .repartition(shards, "shard").mapInArrow(_build(least_documents, group_bytes), "shard int, number long, size long, blob binary"))
    groups: list[list[int]] = [[]]
    filled = 0
    for row in tables.select("number", "size").orderBy("number").collect():  # one row per shard and blob of group_bytes
        if groups[-1] and filled + row["size"] > group_bytes:
            groups.append([])
            filled = 0
        groups[-1].append(row["number"])
        filled += row["size"]
    frame = source.withColumn("flags", F.lit(None).cast("binary"))
    for i, group in enumerate(groups):
        own = [(r["shard"], bytes(r["blob"])) for r in tables.where(F.col("number").isin(group)).collect()] if group else []
        last = i == len(groups) - 1
        probe = _probe(spark.sparkContext.broadcast(own) if own else None, shards, least_characters, last)
        if last:
            return frame.mapInArrow(probe, f"doc_id {id_type}, n_lines long, n_dropped long, kept_text string")
        frame = durable(frame.mapInArrow(probe, f"doc_id {id_type}, text string, flags binary"))
    return frame
