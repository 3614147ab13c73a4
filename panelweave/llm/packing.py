"""Sequence packing by order-preserving dynamic programming over possible cuts.

Documents are tokenised and laid end to end in the order of their partition. A sequence is a window of at
most 2048 tokens of that stream. Cuts may fall at document ends (free), sentence ends (a small penalty)
and, where neither is near, inside a sentence (a larger penalty), so that every token finds its place. The
cost of a window is its padding to 2048, none if its length is a power of two, plus the penalty of its cut;

    best(j) = penalty(j) + min over i of best(i) + padding(j - i)

Padding is 2048 - j + i, so the minimum of best(i) + i over the sliding window of starts comes from a
monotone queue in amortised constant time; the powers of two are eleven further look-ups.

Each partition packs its own stream: one pass, no shuffle, nothing to the driver. Memory is bounded by the
segments the stream is solved in; the last windows of a segment are solved again with the next one.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import CACHE_ENTRIES, pick, worker_store

WINDOW = 2048
SENTENCE_CUT, TOKEN_CUT = 4.0, 24.0
SEGMENT = 1 << 18  # tokens solved at once
END = 1
GRID = 128  # widest gap between possible cuts
_RUN = re.compile(r"(?<=\S) (?=\S)")
_PLAIN = re.compile(r"[\n !-;=-~\u00a1-\u00ac\u00ae-\u024f]*").fullmatch  # without <, which may begin a special token
_BATCH = 512


class ByteBpe:
    """Ids of a byte-level BPE file of the tokenizers library, each distinct chunk between single spaces once.

    A space between two non-spaces always starts a new pre-token, so the ids of a text are the ids of
    its chunks, the space standing in front of the later ones. Where a rank file of the same vocabulary is
    given, chunks of Latin letters, digits and ASCII signs are merged by it, which is faster and gives the
    same ids: both files hold the same merges and both libraries class these characters alike.
    """

    def __init__(self, file: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(file)
        self.fast = self._fast(ranks) if ranks else None
        self.known: dict[str, bytes] = {}  # chunk after a space, without that space -> ids with it
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # sentence ends; a newline is written Ċ
        self.bytes = np.zeros(len(self.ends), np.int64)  # byte-level strings have one character a byte
        for piece, i in vocabulary.items():
            self.ends[i] = "Ċ" in piece or piece.rstrip("\"')]}").endswith((".", "!", "?"))
            self.bytes[i] = len(piece)
        self.ends[END] = False

    @staticmethod
    def _fast(ranks: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as lines:
            pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs, special_tokens={})

    def _one(self, text: str) -> bytes:
        if self.fast and _PLAIN(text):
            return array("I", self.fast.encode_ordinary(text)).tobytes()
        return array("I", self.model.encode(text, add_special_tokens=False).ids).tobytes()

    def _chunks(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks that follow a space: plain ones are merged in one call and cut apart by byte counts."""
        found = {}
        plain = [c for c in chunks if _PLAIN(c)] if self.fast else []
        if plain:
            ids = np.array(self.fast.encode_ordinary(" " + " ".join(plain)), "<u4")
            ends = np.cumsum([len(c.encode()) + 1 for c in plain])
            cuts = (np.searchsorted(np.cumsum(self.bytes[ids]), ends) * 4 + 4).tolist()
            code = ids.tobytes()
            found = {c: code[i:j] for c, i, j in zip(plain, [0, *cuts], cuts)}
        rest = [c for c in chunks if c not in found]
        if rest:
            encoded = self.model.encode_batch_fast([" " + c for c in rest], add_special_tokens=False)
            found.update((c, array("I", e.ids).tobytes()) for c, e in zip(rest, encoded))
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        known, split = self.known, []
        if len(known) > 2 * CACHE_ENTRIES:
            known.clear()
        for text in texts:
            parts = text.split(" ")
            if "" in parts or "\n " in text or " \n" in text or not text.replace("\n", "").isprintable():
                parts = _RUN.split(text)
            split.append(parts)
        missing = set().union(*[parts[1:] for parts in split]).difference(known)
        if missing:
            known.update(self._chunks(list(missing)))
        out = [b"".join([self._one(parts[0]), *map(known.__getitem__, parts[1:])]) for parts in split]
        for chunk in missing:
            if len(chunk) > 64:
                del known[chunk]
        return out


def choose_cuts(length: int, cuts: np.ndarray, penalties: np.ndarray, window: int = WINDOW, all_powers: bool = False) -> list[int]:
    """End positions of the windows over a stream of ``length`` tokens.

    ``cuts`` are the sorted positions (1..length) where a window may end, with their penalties. Gaps of
    more than GRID tokens between them get cuts inside at TOKEN_CUT, so a window always fits.
    Inside the stream windows of the three largest powers of two are free, with ``all_powers`` those of every
    power; at its end every power is.
    """
    grid = min(GRID, window)
    gaps = np.diff(cuts, prepend=0)
    wide = np.flatnonzero(gaps > grid)
    if len(wide):
        inside = np.concatenate([np.arange(cuts[i] - gaps[i] + grid, cuts[i], grid) for i in wide])
        cuts, penalties = np.concatenate([cuts, inside]), np.concatenate([penalties, np.full(len(inside), TOKEN_CUT)])
        order = np.argsort(cuts, kind="stable")
        cuts, penalties = cuts[order], penalties[order]
    powers = [1 << i for i in range(window.bit_length()) if 1 << i < window]
    inner = powers if all_powers else powers[-3:]
    best = [float("inf")] * (length + 1 + window)  # the tail stays infinite and answers look-ups before position 0
    back = [0] * (length + 1)
    best[0] = 0.0
    starts, values = deque([0]), deque([0.0])  # starts with growing best + position
    for at, penalty in zip(cuts.tolist(), penalties.tolist()):
        while starts[0] < at - window:
            starts.popleft()
            values.popleft()
        prev, cost = starts[0], values[0] + window - at
        for power in inner if at < length else powers:
            if best[at - power] < cost:
                cost, prev = best[at - power], at - power
        cost += penalty
        best[at], back[at] = cost, prev
        cost += at
        while values and values[-1] >= cost:
            values.pop()
            starts.pop()
        values.append(cost)
        starts.append(at)
    ends, at = [], length
    while at:
        ends.append(at)
        at = back[at]
    return ends[::-1]


class _Stream:
    """The tokens of a partition that wait for their windows."""

    def __init__(self, sequence: int):
        self.sequence = sequence
        self.docs: list[list] = []  # [id, ids, ids already packed]
        self.length = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append([doc_id, ids, 0])
        self.length += len(ids)

    def solve(self, ends_of: np.ndarray, last: bool, window: int):
        """Windows of the waiting tokens as rows of pieces; unless ``last``, a rest of a few windows stays."""
        if not self.length:
            return
        tokens = np.concatenate([ids[done:] for _, ids, done in self.docs])
        sizes = np.array([len(ids) - done for _, ids, done in self.docs])
        stops = np.cumsum(sizes)
        penalties = np.full(len(tokens) + 1, -1.0)
        penalties[1:][ends_of[tokens]] = SENTENCE_CUT
        penalties[stops] = 0.0
        penalties[len(tokens)] = 0.0
        cuts = np.flatnonzero(penalties >= 0)
        ends = choose_cuts(len(tokens), cuts, penalties[cuts], window, all_powers=True)
        if not last:
            ends = ends[:max(1, len(ends) - 4)]
        at, doc = 0, 0
        for end in ends:
            offset = 0
            while at < end:
                doc_id, ids, done = self.docs[doc]
                take = min(len(ids) - done, end - at)
                piece = ids[done:done + take]
                yield doc_id, done, take, zlib.crc32(piece.tobytes()), len(ids), self.sequence, offset
                self.docs[doc][2] += take
                at, offset = at + take, offset + take
                if self.docs[doc][2] == len(ids):
                    doc += 1
            self.sequence += 1
        self.docs = self.docs[doc:]
        self.length -= at


def pack(docs: DataFrame, tokenizer_file: str, rank_file: str | None = None, id_col: str = "doc_id", text_col: str = "text",
         window: int = WINDOW, segment: int = SEGMENT) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The tokens of a document are the ids of its whole text and the end id 1; null and empty texts have
    the end id alone. Every id lies in exactly one piece; pieces of a sequence lie gapless from offset 0
    in document order. A sequence number holds the partition in its upper bits, so numbers of different
    partitions differ. Rows that repeat an id are packed as rows of their own; extra columns are ignored;
    an empty table gives an empty result. A document longer than a segment is solved alone.
    """
    source = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    field = source.schema["doc_id"]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        bpe = worker_store(f"bpe:{tokenizer_file}", lambda: ByteBpe(tokenizer_file, rank_file))
        stream = _Stream(TaskContext.get().partitionId() << 36)
        id_type = None

        def table(rows) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=names)

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for i in range(0, len(ids), _BATCH):
                for doc_id, code in zip(ids[i:i + _BATCH], bpe.encode(texts[i:i + _BATCH])):
                    stream.add(doc_id, np.append(np.frombuffer(code, "<u4"), np.uint32(END)).astype("<u4"))
                    if stream.length >= segment:
                        yield table(stream.solve(bpe.ends, False, window))
        if stream.length:
            yield table(stream.solve(bpe.ends, True, window))

    return source.mapInArrow(run, f"doc_id {field.dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names[1:]))
