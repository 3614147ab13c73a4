"""N-gram Jaccard join: exact classes of documents linked by 5-word shingle similarity of 0.75 or more.

Jaccard distance is a metric, and linked documents lie within 0.25 of each other.

1. One pass gives every document its set's 80-bit key and size, and adds up a sketch of document frequencies
   over all shingles: 2**26 buckets, one byte each on a scale of logarithms, whatever the table holds. It
   only orders shingles; results do not depend on it. Documents with equal sets are one class from here on.
2. A linked pair shares a shingle among the first quarter (plus one) of both sets, in any common order of
   shingles; rare ones come first here, so common passages hardly ever count. Documents that meet in a
   shingle, in sizes and at places that allow a link, form a group; its pivot is its smallest key. All documents that met a
   pivot form its Voronoi region: every linked pair lies together in at least one region.
3. A region within a task's bound is joined there: members linked to the pivot are one class at once; for
   the others the triangle inequality leaves those whose distances to the pivots differ by at most 0.25.
4. A larger region is cut into blocks. Every block meets the pivot; members not linked to it then meet
   the blocks of the window around them, again in tasks of bounded size.
5. Links between classes are joined to components by label propagation with pointer jumping.

No pair is listed but links to pivots and between classes; sets are shipped for regions alone.
The result is components, not the join's links: links inside a class are neither verified nor counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import (byte_values, gram_hashes, hashed_pieces, in_filter, mix, named, pick, presence_filter,
                                   shuffle_partitions)
from panelweave.llm.exchange import rice_decode, rice_encode
from panelweave.operators.scale import null_safe_join
from panelweave.session import durable

WORDS = 5
PERCENT = 75
SKETCH_BITS = 26
CHUNK_BITS = 20
SKETCH_PIECE = 1 << 22  # shingles counted before they are sent
BLOCK_SHINGLES = 1 << 21  # of a region joined in one task
HEAVY = 1 << 20  # a shingle that more documents may hold is grouped by Spark rows, not in an owner's memory
PIECE = 1 << 19  # shingles or entries gathered before they are sent
KEY = np.dtype([("a", ">u8"), ("b", ">u2")])  # ten bytes, in the order of their bytes


def shingles(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of n words; a shorter text is one run, told apart by its length."""
    if not len(words):
        return np.empty(0, np.uint64)
    if len(words) < n:
        return mix(gram_hashes(words, len(words)) + np.uint64(len(words)))
    return _distinct(gram_hashes(words, n))


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    keep = np.empty(len(values), bool)
    keep[0] = True
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def set_key(shingle_set: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(shingle_set.tobytes())[:10]


def linked(both: np.ndarray, one: int, other: np.ndarray, percent: int) -> np.ndarray:
    return 100 * both >= percent * (one + other - both)


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[np.ndarray]:
    """The shingle set of every row."""
    for batch in batches:
        for _, words, sizes in hashed_pieces(byte_values(batch, "text")):
            grams = gram_hashes(words, n)
            end = 0
            for size in sizes.tolist():
                start, end = end, end + size
                yield _distinct(grams[start:end - n + 1]) if size >= n else shingles(words[start:end], n)


def _keys_and_sketch(n: int, bits: int):
    """Key and size of every document's set, and for the frequency sketch the documents per bucket of the
    shingles, as Rice-coded buckets with counts."""
    names = ["doc_id", "tag", "n", "key", "chunk", "codes", "counts"]
    width = min(bits, CHUNK_BITS)

    def messages(held: list[np.ndarray], kind: pa.DataType) -> pa.RecordBatch:
        buckets, counts = np.unique(np.concatenate(held), return_counts=True)
        cuts = np.searchsorted(buckets, np.arange((1 << (bits - width)) + 1, dtype=np.int64) << width)
        filled = [i for i in range(len(cuts) - 1) if cuts[i] < cuts[i + 1]]
        m = len(filled)
        low = (buckets & ((1 << width) - 1)).astype(np.uint64)
        return pa.RecordBatch.from_arrays([
            pa.nulls(m, kind), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(filled, pa.int32()),
            pa.array([rice_encode(low[cuts[i]:cuts[i + 1]]) for i in filled], pa.binary()),
            pa.array([np.minimum(counts[cuts[i]:cuts[i + 1]], 65535).astype(np.uint16).tobytes() for i in filled], pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, gathered = [], 0
        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            sizes, keys = [], []
            for own in _sets(iter([batch]), n):
                sizes.append(len(own))
                keys.append(set_key(own))
                held.append((own >> np.uint64(64 - bits)).astype(np.uint32))
                gathered += len(own)
                if gathered > SKETCH_PIECE:
                    yield messages(held, kind)
                    held, gathered = [], 0
            m = len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                                              pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary())], names=names)
        if held:
            yield messages(held, kind)
    return run


def _weights(width: int):
    """Per chunk of buckets the documents on a scale of logarithms, a byte each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, codes, counts in zip(*[batch.column(c).to_pylist() for c in ("chunk", "codes", "counts")]):
                total = totals.setdefault(chunk, np.zeros(1 << width, np.uint32))
                total[rice_decode(codes).astype(np.int64)] += np.frombuffer(counts, np.uint16)
        for chunk, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([_scale(total).tobytes()], pa.binary())], names=["chunk", "data"])
    return run


def _scale(counts):
    return np.minimum(255, 8 * np.log2(counts + 1.0)).astype(np.uint8)


def _sketch(messages: DataFrame, bits: int) -> np.ndarray:
    """2**bits bytes, whatever the table holds."""
    width = min(bits, CHUNK_BITS)
    chunks = 1 << (bits - width)
    out = np.zeros(1 << bits, np.uint8)
    rows = messages.select("chunk", "codes", "counts").repartition(min(chunks, shuffle_partitions(messages)), "chunk").mapInArrow(
        _weights(width), "chunk int, data binary")
    for row in rows.toLocalIterator():  # one row per chunk
        out[row.chunk << width:(row.chunk + 1) << width] = np.frombuffer(row.data, np.uint8)
    return out


def _prefixes(order, heavy, n: int, percent: int, bits: int, owners: int):
    """Entries (shingle, key, size) of the sets' prefixes, for the owners of shingle ranges. Owner -1: heavy shingles."""
    def message(held) -> pa.RecordBatch:
        hashes = np.concatenate([h for h, _, _ in held])
        counts = [len(h) for h, _, _ in held]
        keys = np.repeat(np.frombuffer(b"".join(k for _, k, _ in held), KEY), counts)
        sizes = np.repeat(np.array([s for _, _, s in held], np.uint32), counts)
        rests = sizes - np.concatenate([np.arange(c, dtype=np.uint32) for c in counts])
        owner = (((hashes >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)).astype(np.int64)
        owner[order.value[(hashes >> np.uint64(64 - bits)).astype(np.int64)] > heavy] = -1
        at = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[at], np.arange(-1, owners + 1))
        filled = [i for i in range(owners + 1) if cuts[i] < cuts[i + 1]]
        return pa.RecordBatch.from_arrays([pa.array([i - 1 for i in filled], pa.int32()), *[
            pa.array([values[at[cuts[i]:cuts[i + 1]]].tobytes() for i in filled], pa.binary()) for values in (hashes, keys, sizes, rests)]],
            names=["owner", "hashes", "keys", "sizes", "rests"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = order.value
        held, gathered, seen = [], 0, set()
        for own in _sets(batches, n):
            if not len(own):
                continue
            key = set_key(own)
            if key in seen:
                continue
            seen.add(key)
            size = len(own)
            least = -(-percent * size // 100)  # shared shingles of a linked pair
            weight = weights[(own >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64)
            rank = np.argsort((weight << np.uint64(56)) | (own >> np.uint64(8)), kind="stable")  # by weight, then hash
            held.append((own[rank[:size - least + 1]], key, size))
            gathered += size - least + 1
            if gathered > PIECE:
                yield message(held)
                held, gathered, seen = [], 0, set()
        if held:
            yield message(held)
    return run


def _viable(group: np.ndarray, sizes: np.ndarray, rests: np.ndarray, percent: int) -> np.ndarray:
    """Entries that can be the first shared shingle of a linked pair. No earlier shingle is shared then, so
    the overlap is at most the smaller rest from that place on; a link needs percent / (100 + percent) of
    both sizes together. Entries are sorted by group.

    Of a group, sorted by falling rest, an entry asks for the smallest set before it and for the best bound behind
    it; both are running extremes, so a group of any size costs a sort.
    """
    order = np.lexsort((-rests, group))
    group, size, bound = group[order], sizes[order] * percent, (100 + percent) * rests[order] - percent * sizes[order]
    lift = (group.max(initial=0) - group).astype(np.int64) << 40  # keeps groups apart in the running extremes
    same = group[1:] == group[:-1]
    before, behind = np.minimum.accumulate(size + lift) - lift, np.maximum.accumulate((bound + lift)[::-1])[::-1] - lift
    viable = np.zeros(len(group), bool)
    viable[1:] |= same & (before[:-1] <= bound[1:])
    viable[:-1] |= same & (behind[1:] >= size[:-1])
    out = np.empty(len(group), bool)
    out[order] = viable
    return out


def _groups(percent: int):
    """Members and pivots of the groups that meet in a shingle, from all messages of an owner."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in zip(*[batch.column(c).to_pylist() for c in ("hashes", "keys", "sizes", "rests")])]
        hashes, keys, sizes, rests = (np.frombuffer(b"".join(r[i] for r in rows), kind) for i, kind in enumerate((np.uint64, KEY, np.uint32, np.uint32)))
        if not len(hashes):
            return
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        same = hashes[1:] == hashes[:-1]
        shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        order, hashes = order[shared], hashes[shared]
        keys, sizes, rests = keys[order], sizes[order].astype(np.int64), rests[order].astype(np.int64)
        high, low = keys["a"].astype(np.uint64), keys["b"].astype(np.uint64)
        # a document's copies in several messages are one entry
        order = np.lexsort((low, high, sizes, hashes))
        hashes, sizes, rests, high, low, keys = hashes[order], sizes[order], rests[order], high[order], low[order], keys[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        hashes, sizes, rests, high, low, keys = (x[fresh] for x in (hashes, sizes, rests, high, low, keys))
        if not len(hashes):
            return
        stays = _viable(np.cumsum(np.concatenate([[0], hashes[1:] != hashes[:-1]])), sizes, rests, percent)
        hashes, sizes, high, low, keys = (x[stays] for x in (hashes, sizes, high, low, keys))
        if not len(hashes):
            return
        # a gap in the sizes that no linked pair can span opens a new group
        opens = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (100 * sizes[:-1] < percent * sizes[1:])])
        group = np.cumsum(opens) - 1
        first = np.lexsort((low, high, group))
        first = first[np.concatenate([[True], np.diff(group[first]) > 0])]
        pivots = keys[first][group]
        member = keys != pivots
        if not member.any():
            return
        pairs = np.unique(np.rec.fromarrays([pivots[member], keys[member], sizes[member].astype(">u4")], names="p,k,n").view("S24"))
        raw = [bytes(x).ljust(24, b"\0") for x in pairs]
        yield pa.RecordBatch.from_arrays([pa.array([x[:10] for x in raw], pa.binary()), pa.array([x[10:20] for x in raw], pa.binary()),
                                          pa.array([int.from_bytes(x[20:], "big") for x in raw], pa.int64())], names=["pivot", "key", "n"])
    return run


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages as one row per entry."""
    for batch in batches:
        for hashes, keys, sizes in zip(*[batch.column(c).to_pylist() for c in ("hashes", "keys", "sizes")]):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(hashes, np.int64)), pa.array([keys[i:i + 10] for i in range(0, len(keys), 10)], pa.binary()),
                                              pa.array(np.frombuffer(sizes, np.uint32).astype(np.int64))], names=["hash", "key", "n"])


def _ship(flags, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, gathered, seen = [], 0, set()

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.binary()), pa.array([s for _, s in held], pa.binary())], names=["key", "shingles"])

        for own in _sets(batches, n):
            if not len(own):
                continue
            key = set_key(own)
            if key in seen or not in_filter(flags.value, np.frombuffer(key[:8], ">u8").astype(np.uint64))[0]:
                continue
            seen.add(key)
            held.append((key, own.tobytes()))
            gathered += len(own)
            if gathered > PIECE:
                yield table()
                held, gathered, seen = [], 0, set()
        if held:
            yield table()
    return run


class Region:
    """Sets laid end to end, with exact overlaps of one set against many."""

    def __init__(self, sets: list[bytes]):
        self.sets = [np.frombuffer(s, np.uint64) for s in sets]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.flat = np.concatenate(self.sets) if self.sets else np.empty(0, np.uint64)
        self.ends = np.cumsum(self.sizes)

    def overlaps(self, one: np.ndarray, members: np.ndarray | None = None) -> np.ndarray:
        if members is None:
            flat, sizes = self.flat, self.sizes
        else:
            flat, sizes = np.concatenate([self.sets[i] for i in members] or [self.flat[:0]]), self.sizes[members]
        if not len(one) or not len(flat):
            return np.zeros(len(sizes), np.int64)
        at = np.searchsorted(one, flat)
        at[at == len(one)] = 0
        hits = np.concatenate([[0], np.cumsum(one[at] == flat)])
        ends = np.cumsum(sizes)
        return hits[ends] - hits[ends - sizes]

    def distances(self, one: np.ndarray, both: np.ndarray) -> np.ndarray:
        return 1 - both / (len(one) + self.sizes - both)


def join_region(region: Region, percent: int) -> list[tuple[int, int]]:
    """Links that join exactly the members that any links join; member 0 is the pivot."""
    links: list[tuple[int, int]] = []
    count = len(region.sets)
    label = np.arange(count)
    classes = [[i] for i in range(count)]
    reach = 1 - percent / 100 + 1e-9
    seen: list[np.ndarray] = []  # distances to the first few pivots

    def link(a: int, others: np.ndarray) -> None:
        for b in others.tolist():
            if label[a] != label[b]:
                links.append((a, b))
                less, more = sorted((label[a], label[b]), key=lambda c: len(classes[c]))  # the smaller class gets the name of the larger
                label[classes[less]] = more
                classes[more] += classes[less]
                classes[less] = []

    done = np.zeros(count, bool)
    order = [0]
    at = 0
    while at < len(order):
        y = order[at]
        at += 1
        done[y] = True
        if y == 0:
            both = region.overlaps(region.sets[0])
            fits = linked(both, len(region.sets[0]), region.sizes, percent)
            fits[0] = False
            seen.append(region.distances(region.sets[0], both))
            link(0, np.flatnonzero(fits))
            order += np.flatnonzero(~fits)[1:].tolist()
            continue
        may = (label != label[y]) & ~done
        may &= (100 * region.sizes >= percent * region.sizes[y]) & (percent * region.sizes <= 100 * region.sizes[y])
        for distance in seen:  # the window that the triangle inequality leaves
            may &= np.abs(distance - distance[y]) <= reach
        members = np.flatnonzero(may)
        if len(members):
            both = region.overlaps(region.sets[y], members)
            link(y, members[linked(both, len(region.sets[y]), region.sizes[members], percent)])
    return links


def _by_group(batches: Iterator[pa.RecordBatch], columns: list[str]):
    """Consecutive rows with equal leading columns."""
    group, held = None, []
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in batch.schema.names]):
            mark = row[:len(columns)]
            if mark != group and held:
                yield group, held
                held = []
            group = mark
            held.append(row[len(columns):])
    if held:
        yield group, held


_SOLVED = "a binary, b binary, n long, distance double, linked boolean"


def _solved(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(
        (pa.binary(), pa.binary(), pa.int64(), pa.float64(), pa.bool_()))], names=["a", "b", "n", "distance", "linked"])


def _solve(percent: int):
    """Regions in one block: all their links. Larger ones: every member's distance to the pivot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (pivot, _, blocks), rows in _by_group(batches, ["pivot", "block", "blocks"]):
            members = dict(rows)  # key -> shingles
            keys = [pivot, *[k for k in members if k != pivot]]
            region = Region([members[k] for k in keys])
            if blocks == 1:
                yield _solved([(keys[i], keys[j], None, None, True) for i, j in join_region(region, percent)])
                continue
            both = region.overlaps(region.sets[0])
            fits = linked(both, len(region.sets[0]), region.sizes, percent)
            away = region.distances(region.sets[0], both)
            yield _solved([(pivot, keys[i], int(region.sizes[i]), float(away[i]), bool(fits[i])) for i in range(1, len(keys))])
    return run


def _meet(percent: int):
    """Members apart from a pivot (side 0) against a block of the window around it (side 1)."""
    reach = 1 - percent / 100 + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_group(batches, ["pivot", "part", "block"]):
            ours = [r for r in rows if r[0] == 0]
            theirs = [r for r in rows if r[0] == 1]
            region, away = Region([r[3] for r in theirs]), np.array([r[2] for r in theirs])
            out = []
            for _, key, distance, data in ours:
                own = np.frombuffer(data, np.uint64)
                may = (np.abs(away - distance) <= reach) & (100 * region.sizes >= percent * len(own)) & (percent * region.sizes <= 100 * len(own))
                members = np.flatnonzero(may)
                fits = members[linked(region.overlaps(own, members), len(own), region.sizes[members], percent)]
                out += [(key, theirs[i][1], None, None, True) for i in fits.tolist() if theirs[i][1] != key]
            yield _solved(out)
    return run


def components(links: DataFrame) -> DataFrame:
    """node, root of the connected components of links (a, b): smallest labels travel along links and along
    labels (pointer jumping) until none changes. Every round is frozen in the checkpoint folder."""
    edges = durable(links.select("a", "b").union(links.select("b", "a")).toDF("node", "other").distinct())
    state = durable(edges.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")))
    while True:
        heard = (null_safe_join(edges.withColumnRenamed("other", "to"), state, ["node"], "inner").groupBy("to").agg(F.min("root").alias("heard"))
                 .withColumnRenamed("to", "node"))
        told = state.join(heard, "node").select("node", F.col("root").alias("old"), F.least("root", "heard").alias("root"))
        up = told.select(F.col("node").alias("root"), F.col("root").alias("above"))
        fresh = durable(null_safe_join(told, up, ["root"], "inner").select("node", "old", F.least("root", "above").alias("root")))
        state = fresh.select("node", "root")
        if fresh.where("root <> old").isEmpty():
            return state


def _leading(key: str) -> Column:
    return F.conv(F.hex(F.substring(key, 1, 8)), 16, -10).cast("long")


def _block(key: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key), blocks)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT,
                    sketch_bits: int = SKETCH_BITS, block_shingles: int = BLOCK_SHINGLES, heavy: int = HEAVY, filter_bits: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, stays, tag.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; a document's set holds its
    distinct runs of ``words`` words, or its whole sequence if shorter. Documents without words have an empty
    set and are linked with nothing. Two documents are linked when 100 * intersection >= percent * union;
    component_id is the smallest doc_id reachable by links. Rows that repeat an id count as documents of
    their own; a null id is never smallest (and stays null if alone). One document of a component ``stays``,
    that with the smallest id; ``tag``, a hash of the raw text, tells rows of one id apart, and rows that
    repeat id and text stay or go together. Texts of any length are read whole; extra columns are ignored; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    source = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.col("text").cast("string").alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    owners = shuffle_partitions(docs)
    first = durable(source.withColumn("tag", F.xxhash64("text")).mapInArrow(
        _keys_and_sketch(words, sketch_bits), f"doc_id {id_type}, tag long, n long, key binary, chunk int, codes binary, counts binary"))
    rows = first.where("n IS NOT NULL").select("doc_id", "tag", "n", "key")
    weights = _sketch(first.where("chunk IS NOT NULL"), sketch_bits)
    crowded = int(_scale(heavy))
    order = spark.sparkContext.broadcast(weights)

    sent = (source.mapInArrow(_prefixes(order, crowded, words, percent, sketch_bits, owners), "owner int, hashes binary, keys binary, sizes binary, rests binary")
            .repartition(owners, F.when(F.col("owner") >= 0, F.col("owner")).otherwise(F.hash("hashes"))))
    member = "pivot binary, key binary, n long"
    if (weights > crowded).any():
        sent = durable(sent)
        entries = sent.where("owner < 0").mapInArrow(_entries, "hash long, key binary, n long").distinct()
        pivots = entries.groupBy("hash").agg(F.min("key").alias("pivot"))
        more = null_safe_join(entries, pivots, ["hash"], "inner").where("key <> pivot").select("pivot", "key", "n")
        members = sent.where("owner >= 0").repartition(owners, "owner").mapInArrow(_groups(percent), member).unionByName(more)
    else:
        members = sent.mapInArrow(_groups(percent), member)
    members = durable(members.distinct())
    pivot_rows = members.select("pivot").distinct().select("pivot", F.col("pivot").alias("key"), F.lit(0).cast("long").alias("n"))
    members = members.unionByName(pivot_rows)
    sizes = members.groupBy("pivot").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / block_shingles)).cast("long").alias("blocks"))
    placed = null_safe_join(members, sizes, ["pivot"], "inner")
    each = F.when(F.col("key") == F.col("pivot"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(_block("key", F.col("blocks"))))
    placed = placed.select("pivot", F.explode(each).alias("block"), "blocks", "key")

    flags = spark.sparkContext.broadcast(presence_filter(members.select(_leading("key").alias("k")), "k", filter_bits))
    sets = source.mapInArrow(_ship(flags, words), "key binary, shingles binary").groupBy("key").agg(F.first("shingles").alias("shingles"))

    def together(df: DataFrame, *keys: str) -> DataFrame:
        return df.repartition(owners, *keys).sortWithinPartitions(*keys)

    solved = durable(together(placed.join(sets, "key").select("pivot", "block", "blocks", "key", "shingles"), "pivot", "block")
                     .mapInArrow(_solve(percent), _SOLVED))
    links = solved.where("linked").select("a", "b")
    apart = solved.where("NOT linked")
    if not apart.isEmpty():
        edge = apart.groupBy("a").agg(F.min("distance").alias("near"), F.ceil(F.sum("n") / block_shingles).cast("long").alias("parts"))
        window = null_safe_join(solved.where("distance IS NOT NULL"), edge, ["a"], "inner").where(
            ~F.col("linked") | (F.col("distance") >= F.col("near") - (1 - percent / 100) - 1e-9))
        counts_of = window.groupBy("a").agg(F.ceil(F.sum("n") / block_shingles).cast("long").alias("blocks"))
        window = null_safe_join(window, counts_of, ["a"], "inner")
        every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
        ours = window.where("NOT linked").select("a", _block("b", F.col("parts")).alias("part"), F.explode(every).alias("block"), F.lit(0).alias("side"), "b", "distance")
        theirs = window.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), _block("b", F.col("blocks")).alias("block"),
                               F.lit(1).alias("side"), "b", "distance")
        both = ours.unionByName(theirs).join(sets.withColumnRenamed("key", "b"), "b").select("a", "part", "block", "side", "b", "distance", "shingles")
        links = links.unionByName(together(both, "a", "part", "block").mapInArrow(_meet(percent), _SOLVED).select("a", "b"))

    roots = components(links)
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("least")
    rooted = durable(null_safe_join(rows.where("n > 0").groupBy("key").agg(smallest), roots.withColumnRenamed("node", "key"), ["key"])
                     .withColumn("root", F.coalesce("root", "key")))
    least = rooted.groupBy("root").agg(F.min("least").alias("least"))
    full = null_safe_join(rows, null_safe_join(rooted.select("key", "root"), least, ["root"], "inner").select("key", "least"), ["key"])
    stays = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("tag") == F.col("least.tag"))
    return full.select("doc_id", F.col("n").alias("n_shingles"),
                       F.when(F.col("n") > 0, F.col("least.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
                       ((F.col("n") == 0) | stays).alias("stays"), "tag")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that stay, with all their columns."""
    gone = near_duplicates(docs, id_col, text_col, **options).where("NOT stays").select(
        F.col("doc_id").alias("__llm_id"), F.col("tag").alias("__llm_tag")).distinct()
    same = named(id_col).eqNullSafe(F.col("__llm_id")) & (F.xxhash64(named(text_col).cast("string")) == F.col("__llm_tag"))
    return docs.join(gone, same, "left_anti")
