"""Benchmark passages in documents, by one Aho-Corasick automaton over the words of normalised test texts.

1. Test questions and answers are normalised to words and cut into windows of ten words; a shorter text is
   one window. Equal windows are met once, with the list of items that hold them.
2. All windows form one automaton over word codes. It is built in every worker from a broadcast table of
   at most ``group_bytes``; a larger benchmark is cut into several automata, and the documents are scanned
   once for each.
3. A document's words are read once through the automaton. Word positions are mapped back to the original
   text, so that spans can be cut out of it.

Nothing is shuffled with one automaton. With several, only rows with hits are, by id and digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import byte_values, pick, worker_store
from panelweave.operators.scale import null_safe_join
from panelweave.session import durable

WINDOW = 10
GROUP_BYTES = 8 << 20  # of windows and item names in one automaton, which takes some 20 times that in a worker
ITEMS_PER_LIST = 1000
PIECE_BYTES = 1 << 20

# letters and digits of ASCII and all bytes beyond it stay, A-Z lower-cased; the rest separates words
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_SPAN = "array<struct<first_word: bigint, last_word: bigint, begin: bigint, end: bigint>>"
_SPAN_ARROW = pa.list_(pa.struct([(n, pa.int64()) for n in ("first_word", "last_word", "begin", "end")]))


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def _item_windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), byte_values(batch, "text")):
                words = normal_words(text)
                count = max(len(words) - width + 1, 1) if words else 0
                for at in range(0, count, 4096):
                    found = [b" ".join(words[i:i + width]).decode() for i in range(at, min(at + 4096, count))]
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array([item] * len(found), pa.string())], names=["window", "item"])
    return run


def window_table(items: DataFrame, width: int = WINDOW, group_bytes: int = GROUP_BYTES) -> tuple[DataFrame, int]:
    """Distinct windows with lists of about ``ITEMS_PER_LIST`` items at most, dealt over groups of at most
    ``group_bytes``, and the number of groups. A window that very many items share has several lists."""
    found = items.mapInArrow(_item_windows(width), "window string, item string").distinct()
    lists = max(1, -(-items.count() // ITEMS_PER_LIST))
    listed = durable(found.groupBy("window", F.pmod(F.xxhash64("item"), F.lit(lists)).alias("part"))
                     .agg(F.collect_list("item").alias("items")))
    size = F.octet_length("window") + F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x) + 8) + 16
    groups = max(1, -(-(listed.agg(F.sum(size)).first()[0] or 0) // group_bytes))
    while True:
        dealt = listed.withColumn("group", F.pmod(F.xxhash64("window", "part"), F.lit(groups)))
        largest = dealt.groupBy("group").agg(F.sum(size).alias("size")).agg(F.max("size")).first()[0] or 0
        if largest <= group_bytes or groups >= listed.count():
            return dealt.select("window", "items", "group"), groups
        groups = groups * 5 // 4 + 1


class _Codes(dict):
    """Words as short strings of equal length; words that no window holds have the blank code."""

    def __missing__(self, word: bytes) -> str:
        return self.blank


class Scanner:
    """The automaton of one group of windows.

    The library keeps a node's edges in a list, so an alphabet of all words would make the root slow. A word
    is spelled with a few digits of base 32 instead; each place has its own digits, so that no match begins
    inside a word.
    """

    def __init__(self, windows: list[tuple[str, list[str]]]):
        words = dict.fromkeys(word for window, _ in windows for word in window.encode().split(b" "))
        self.digits = max(1, -(-max(len(words) - 1, 1).bit_length() // 5))
        self.codes, self.items, self.lengths = _Codes(), [], []
        self.codes.blank = "\0" * self.digits
        for n, word in enumerate(words):
            self.codes[word] = "".join(chr(1 + 32 * p + (n >> 5 * p) % 32) for p in range(self.digits))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for window, items in windows:
            code = self._spelled(window.encode())
            at = self.automaton.get(code, -1)
            if at < 0:
                self.automaton.add_word(code, len(self.items))
                self.items.append(list(items))
                self.lengths.append(len(code) // self.digits)
            else:
                self.items[at] += items
        if self.items:
            self.automaton.make_automaton()
        self.overlap = (max(self.lengths, default=1) - 1) * self.digits

    def _spelled(self, plain: bytes) -> str:
        return "".join(map(self.codes.__getitem__, plain.split()))

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int, int, int]], list[str]]:
        """Number of words, maximal runs of hit words, and the items with windows in the text. The text goes
        through in pieces; a piece starts with the last words of the one before."""
        plain, hits, seen = text.translate(_NORMAL), [], set()
        words, tail, pieces, at = 0, "", [], 0
        while at < len(plain):
            cut = plain.find(b" ", at + PIECE_BYTES)
            end = len(plain) if cut < 0 else cut
            own = self._spelled(plain[at:end])
            pieces.append((at, end, words))
            if self.items:
                base, codes = words - len(tail) // self.digits, tail + own
                for last, k in self.automaton.iter(codes):
                    stop = base + (last + 1) // self.digits
                    hits.append((stop - self.lengths[k], stop))
                    seen.add(k)
                tail = codes[len(codes) - self.overlap:] if len(codes) > self.overlap else codes
            words, at = words + len(own) // self.digits, end
        if not hits:
            return words, [], []
        return words, self._located(text, plain, pieces, _united(hits)), sorted({item for k in seen for item in self.items[k]})

    @staticmethod
    def _located(text: bytes, plain: bytes, pieces: list, runs: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        """Runs of words with their places in the original text, in code points."""
        firsts, lasts = np.array([r[0] for r in runs]), np.array([r[1] - 1 for r in runs])
        begin, end, chars = np.zeros(len(runs), np.int64), np.zeros(len(runs), np.int64), 0
        for k, (a, b, word) in enumerate(pieces):
            stop = pieces[k + 1][2] if k + 1 < len(pieces) else lasts[-1] + 1
            opens, closes = (firsts >= word) & (firsts < stop), (lasts >= word) & (lasts < stop)
            lead = (np.frombuffer(text, np.uint8, b - a, a) & 0xC0) != 0x80
            if opens.any() or closes.any():
                filled = np.concatenate([[False], np.frombuffer(plain, np.uint8, b - a, a) != 32, [False]])
                edges = np.flatnonzero(filled[1:] != filled[:-1])
                before = np.concatenate([[0], np.cumsum(lead)]) + chars
                begin[opens] = before[edges[::2][firsts[opens] - word]]
                end[closes] = before[edges[1::2][lasts[closes] - word]]
            chars += int(np.count_nonzero(lead))
        return [tuple(map(int, span)) for span in zip(firsts, lasts, begin, end)]


def _united(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union of half-open intervals."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(set(runs)):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def _scanner(windows) -> Scanner:
    """The scanner of this broadcast; a worker keeps one."""
    held = worker_store("scanner", dict)
    if windows.id not in held:
        held.clear()
        held[windows.id] = Scanner(windows.value)
    return held[windows.id]


class _Windows:
    """A broadcast group of windows with a name of its own."""

    def __init__(self, spark, rows: list, name: str):
        self.shared, self.id = spark.sparkContext.broadcast(rows), name

    @property
    def value(self):
        return self.shared.value


def _scan(windows, only_hits: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(windows)
        for batch in batches:
            texts = byte_values(batch, "text")
            found = [scanner.scan(text) for text in texts]
            keep = [i for i, f in enumerate(found) if f[1] or not only_hits]
            columns = [batch.column("doc_id").take(pa.array(keep, pa.int64()))]
            columns += [pa.array([hashlib.sha256(texts[i]).digest() for i in keep], pa.binary())] if windows.several else []
            yield pa.RecordBatch.from_arrays([
                *columns, pa.array([found[i][0] for i in keep], pa.int64()),
                pa.array([[dict(zip(("first_word", "last_word", "begin", "end"), s)) for s in found[i][1]] for i in keep], _SPAN_ARROW),
                pa.array([found[i][2] for i in keep], pa.list_(pa.string()))],
                names=["doc_id", *["sha"] * windows.several, "n_words", "spans", "items"])
    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans and items of one document from several automata as one list each."""
    for batch in batches:
        spans, items = [], []
        for groups in batch.column("found").to_pylist():
            places = [s for g in groups or [] for s in g["spans"]]
            begins, ends = {s["first_word"]: s["begin"] for s in places}, {s["last_word"]: s["end"] for s in places}
            runs = _united([(s["first_word"], s["last_word"] + 1) for s in places])
            spans.append([{"first_word": a, "last_word": b - 1, "begin": begins[a], "end": ends[b - 1]} for a, b in runs])
            items.append(sorted({item for g in groups or [] for item in g["items"]}))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(spans, _SPAN_ARROW),
                                          pa.array(items, pa.list_(pa.string()))], names=["doc_id", "n_words", "spans", "items"])


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", width: int = WINDOW, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items, spans.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. A word is hit inside any
    occurrence of ``width`` consecutive words of a test text, or of a whole shorter text. ``items`` are the ids
    of the texts with occurring windows, as sorted strings; rows of one id are one item, and a text without id
    marks words but is not listed. ``spans`` are the maximal runs of hit words with their code points
    (``begin`` to ``end``) in the original text. Null and empty texts have no words and hit nothing; repeated
    rows give repeated rows; long texts are read in pieces; extra columns do not matter. Without test texts
    nothing is hit, without documents the result is empty.
    """
    spark = docs.sparkSession
    source = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    texts = pick(benchmark, item=item_col, text=item_text_col).select(*[F.col(c).cast("string").alias(c) for c in ("item", "text")])
    table, groups = window_table(texts, width, group_bytes)

    def scan(group: int, only_hits: bool) -> DataFrame:
        rows = [(r.window, r["items"]) for r in table.where(F.col("group") == group).collect()]  # group_bytes at most
        windows = _Windows(spark, rows, f"{id(table)}-{spark.sparkContext.applicationId}-{group}")
        windows.several = int(groups > 1)
        form = f"doc_id {id_type}, {'sha binary, ' * windows.several}n_words long, spans {_SPAN}, items array<string>"
        return source.mapInArrow(_scan(windows, only_hits), form)

    if groups == 1:
        out = scan(0, False)
    else:
        base = durable(scan(0, False))
        found = base.where(F.size("spans") > 0).withColumn("group", F.lit(0))
        for group in range(1, groups):
            found = found.unionByName(scan(group, True).withColumn("group", F.lit(group)))
        once = found.dropDuplicates(["doc_id", "sha", "group"])  # repeated rows hit alike
        merged = once.groupBy("doc_id", "sha").agg(F.collect_list(F.struct("spans", "items")).alias("found"))
        out = null_safe_join(base.select("doc_id", "sha", "n_words"), merged, ["doc_id", "sha"]).select(
            "doc_id", "n_words", "found").mapInArrow(_merge, f"doc_id {id_type}, n_words long, spans {_SPAN}, items array<string>")
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["last_word"] - s["first_word"] + 1)
    return out.select("doc_id", "n_words", hit.alias("n_hit"), "items", "spans")


def remove_spans(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with the spans of :func:`find` cut out of their texts; ids must be unique."""
    cuts = found.where(F.size("spans") > 0).select(F.col("doc_id").alias(id_col), "spans")
    text = F.col(text_col)
    bounds = F.concat(F.array(F.lit(0).cast("bigint")), F.flatten(F.transform("spans", lambda s: F.array(s["begin"], s["end"]))),
                      F.array(F.length(text).cast("bigint")))
    kept = F.array_join(F.transform(F.sequence(F.lit(0), F.size("spans")), lambda i: F.substring(
        text, (bounds[2 * i] + 1).cast("int"), (bounds[2 * i + 1] - bounds[2 * i]).cast("int"))), "")
    joined = null_safe_join(docs, cuts, [id_col])
    return joined.withColumn(text_col, F.when(F.col("spans").isNotNull(), kept).otherwise(text)).drop("spans")
