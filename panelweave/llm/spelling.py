"""Spelling variants: near words found by search schemes over bidirectional FM-indexes.

1. Runs of letters are counted in tasks, in tables of bounded size, and summed. The vocabulary keeps words of
   enough letters and occurrences.
2. One error lies in one half of a word, so the other half matches exactly. Words that begin (or end) alike
   are dealt to the same block by that half, under each length of half that a near word can have. A half that
   very many words share is cut into several blocks, and its queries go to each of them.
3. A block's words, delimited and sorted, form a bidirectional FM-index. All queries of a block move together:
   each matches its exact half from the delimiter on, then extends across the other half with one inserted,
   deleted or replaced letter, as an interval of suffix ranks, and closes with the other delimiter.
4. The near words of a query from all its blocks are summed up. Forms are followed to their roots by pointer
   doubling; as counts at least double at each step, a path has at most some sixty words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import byte_values, pick
from panelweave.operators.scale import null_safe_join
from panelweave.session import durable

LEAST_LETTERS, LEAST_COUNT = 5, 3
BLOCK_WORDS = 1 << 16  # words of an index, on average
TABLE_WORDS = 200_000  # distinct words that a task counts before it hands them on
STEP = 1 << 13  # queries that move together
_RUN = re.compile("[A-Za-zÀ-ÿ]+")


# ---- words ------------------------------------------------------------------

def spelled(runs: Counter, doc: str, typo_rate: int) -> Iterator[tuple[str, int]]:
    """A document's lower-cased runs as words with counts: where ``typo_rate`` divides the checksum of document
    and run, one letter is left out."""
    start = zlib.crc32(f"{doc}:".encode())
    for run, count in runs.items():
        checksum = zlib.crc32(run.encode(), start)
        if checksum % typo_rate == 0:
            at = checksum % len(run)
            run = run[:at] + run[at + 1:]
        yield run, count


def _count(least: int, typo_rate: int):
    def out(table: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(table), pa.string()), pa.array(list(table.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[str, int] = {}
        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), byte_values(batch, "text")):
                runs = Counter(m[0] for m in _RUN.finditer(text.lower().decode()))
                for word, count in spelled(runs, doc, typo_rate):
                    if len(word) >= least:
                        table[word] = table.get(word, 0) + count
                if len(table) > TABLE_WORDS:
                    yield out(table)
                    table = {}
        yield out(table)
    return run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS,
               least_count: int = LEAST_COUNT, typo_rate: int = 97) -> DataFrame:
    """Words with their counts ``n``. Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased; of
    runs whose crc32 of ``<doc_id>:<run>`` is divisible by ``typo_rate`` the letter at crc32 modulo length is
    deleted. Null texts have no words; a null id reads ``null``."""
    source = pick(docs, doc=id_col, text=text_col).select(
        F.coalesce(F.col("doc").cast("string"), F.lit("null")).alias("doc"), F.col("text").cast("string").alias("text"))
    counted = source.where("text IS NOT NULL").mapInArrow(_count(least_letters, typo_rate), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# ---- the index --------------------------------------------------------------

def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes of a text of non-negative numbers, by prefix doubling. The text ends with a number
    that occurs once, as do all delimiters, so no comparison runs past the end."""
    order = np.argsort(text, kind="stable")
    rank, step = np.empty(len(text), np.int64), 1

    def ranked(keys: np.ndarray) -> int:
        grows = np.concatenate([[0], keys[1:] != keys[:-1]]).cumsum()
        rank[order] = grows
        return int(grows[-1]) + 1

    classes = ranked(text[order].astype(np.int64))
    while classes < len(text):
        ahead = np.zeros(len(text), np.int64)
        ahead[:len(text) - step] = rank[step:] + 1
        keys = rank * (len(text) + 1) + ahead
        order = np.argsort(keys, kind="stable")
        classes = ranked(keys[order])
        step *= 2
    return order


class FMIndex:
    """Backward steps over the delimited words: rank structure of the Burrows-Wheeler transform as a wavelet matrix.

    Letters are 1 to ``letters``, the delimiter is 0. The delimiters of different words are told apart when
    suffixes are sorted, by the order of the words, so a word and its delimiter form a cycle: the k-th row is
    the delimiter of the k-th word.
    """

    def __init__(self, words: list[np.ndarray], letters: int):
        lengths = np.array([len(w) for w in words])
        ends = np.cumsum(lengths + 1) - 1
        text = np.zeros(int(ends[-1]) + 1, np.int64)
        inside = np.ones(len(text), bool)
        inside[ends] = False
        text[inside] = np.concatenate(words)
        distinct = text + len(words) - 1
        distinct[ends] = np.arange(len(words))
        order = suffix_array(distinct)
        starts = ends - lengths
        back = np.arange(len(text)) - 1
        back[starts] = ends  # the letter before a word's first one is its own delimiter
        column = text[back[order]]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=letters + 1))])
        self.bits = max(1, int(letters).bit_length())
        self.ones, self.zeros = [], []
        for bit in range(self.bits - 1, -1, -1):
            flags = (column >> bit) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(flags)]).astype(np.int32))
            self.zeros.append(int(len(flags) - flags.sum()))
            column = np.concatenate([column[flags == 0], column[flags == 1]])

    def step(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals after one letter, and how many letters of each old interval are smaller."""
        smaller = np.zeros(len(low), np.int64)
        for level in range(self.bits):
            one = (symbol >> (self.bits - 1 - level)) & 1 == 1
            a, b = self.ones[level][low], self.ones[level][high]
            smaller += np.where(one, (high - low) - (b - a), 0)
            low, high = np.where(one, self.zeros[level] + a, low - a), np.where(one, self.zeros[level] + b, high - b)
        # the matrix ends with equal letters side by side; the first of them is the start of this letter's run
        origin = self.origin(symbol)
        return self.first[symbol] + low - origin, self.first[symbol] + high - origin, smaller

    def origin(self, symbol: np.ndarray) -> np.ndarray:
        """Place at the lowest level of the first occurrence of a letter."""
        if not hasattr(self, "_origins"):
            letters = np.arange(len(self.first) - 1)
            at = np.zeros(len(letters), np.int64)
            for level in range(self.bits):
                one = (letters >> (self.bits - 1 - level)) & 1 == 1
                a = self.ones[level][at]
                at = np.where(one, self.zeros[level] + a, at - a)
            self._origins = at
        return self._origins[symbol]

    def branches(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        """All letters that occur in each interval: (interval, letter, new low, new high, smaller letters). Empty
        branches are left at every level, so the work follows the letters that occur."""
        source, symbol, smaller = np.arange(len(low)), np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
        for level in range(self.bits):
            a, b = self.ones[level][low].astype(np.int64), self.ones[level][high].astype(np.int64)
            left, right = (high - b) > (low - a), b > a
            zeros = (high - low) - (b - a)
            source = np.concatenate([source[left], source[right]])
            symbol = np.concatenate([symbol[left] << 1, (symbol[right] << 1) | 1])
            smaller = np.concatenate([smaller[left], smaller[right] + zeros[right]])
            low, high = (np.concatenate([(low - a)[left], self.zeros[level] + a[right]]),
                         np.concatenate([(high - b)[left], self.zeros[level] + b[right]]))
        origin = self.origin(symbol)
        return source, symbol, self.first[symbol] + low - origin, self.first[symbol] + high - origin, smaller


class BidirectionalIndex:
    """Intervals of one pattern in the index of the words and in that of their reversals, kept in step."""

    def __init__(self, words: list[str]):
        """``words`` are distinct and sorted by code points."""
        joined = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.alphabet = np.unique(joined)
        codes = np.searchsorted(self.alphabet, joined).astype(np.int64) + 1
        cut = np.split(codes, np.cumsum([len(w) for w in words])[:-1])
        turned = sorted(range(len(words)), key=lambda i: words[i][::-1])
        self.size = len(words)
        # a letter is put in front by the words' index, and behind by that of the reversed words
        self.sides = (FMIndex(cut, len(self.alphabet)), FMIndex([cut[i][::-1] for i in turned], len(self.alphabet)))

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letters of all queries, one row each, and lengths; letters that no word has are -1, the rest is -2."""
        lengths = np.array([len(w) for w in words])
        joined = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, joined), len(self.alphabet) - 1)
        found = np.where(self.alphabet[at] == joined, at + 1, -1)
        table = np.full((len(words), int(lengths.max()) + 1), -2, np.int64)
        table[np.arange(table.shape[1]) < lengths[:, None]] = found
        return table, lengths

    def delimiters(self, count: int) -> np.ndarray:
        """The state of the pattern that is one delimiter: starts in both indexes and size, a column each."""
        return np.array([[0], [0], [self.size]]).repeat(count, axis=1)

    def extend(self, state: np.ndarray, symbol: np.ndarray, side: int) -> np.ndarray:
        """Put one letter in front (side 0) or behind (side 1); letters below 0 match nothing."""
        low, size = state[side], state[2]
        known = np.maximum(symbol, 0)
        a, b, smaller = self.sides[side].step(low, low + size, known)
        out = np.empty_like(state)
        out[side], out[1 - side], out[2] = a, state[1 - side] + smaller, np.where(symbol < 0, 0, b - a)
        return out

    def extensions(self, state: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All states that one letter, no delimiter, leads to: (state, letter, new state)."""
        low, size = state[side], state[2]
        source, symbol, a, b, smaller = self.sides[side].branches(low, low + size)
        out = np.empty((3, len(source)), np.int64)
        out[side], out[1 - side], out[2] = a, state[1 - side][source] + smaller, b - a
        kept = symbol > 0
        return source[kept], symbol[kept], out[:, kept]

    def near(self, words: list[str], side: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, word) with exactly one letter inserted, deleted or replaced in the one half while the
        other half matches exactly. Side 1: the first half is exact and the search runs on to the right; side 0:
        the second half is exact and the search runs on to the left. Each pair comes once, and in one of the two sides only:
        of equal neighbours the last is the one that is deleted or followed by the inserted letter."""
        table, lengths = self.codes(words)
        half = lengths // 2
        exact = half if side else lengths - half
        queries, state, used = np.arange(len(words)), self.delimiters(len(words)), np.zeros(len(words), np.int64)

        def letter(query: np.ndarray, done: np.ndarray, ahead: int = 0) -> np.ndarray:
            """The letter that comes next in the search's direction; -2 beyond the end."""
            at = done + ahead if side else lengths[query] - 1 - done - ahead
            return np.where((at >= 0) & (at < lengths[query]), table[query, np.clip(at, 0, table.shape[1] - 1)], -2)

        for done in range(int(exact.max())):
            moving = exact > done
            moving &= state[2] > 0
            state[2, (exact > done) & ~moving] = 0
            at = np.flatnonzero(moving)
            state[:, at] = self.extend(state[:, at], letter(at, np.full(len(at), done)), side)
        used = exact.copy()
        alive = state[2] > 0
        queries, used, state = queries[alive], used[alive], state[:, alive]
        clean = (queries, used, state)  # no error yet
        faulty = (queries[:0], used[:0], state[:, :0])  # one error
        found = [(queries[:0], queries[:0])]
        while len(clean[0]) or len(faulty[0]):
            query, done, state = faulty  # one error: match the rest
            ended = done == lengths[query]
            closed = self.extend(state[:, ended], np.zeros(int(ended.sum()), np.int64), side)
            hit = closed[2] > 0
            found.append((query[ended][hit], closed[0][hit]))
            query, done, state = query[~ended], done[~ended], state[:, ~ended]
            state = self.extend(state, letter(query, done), side)
            alive = state[2] > 0
            faulty = [(query[alive], done[alive] + 1, state[:, alive])]

            query, done, state = clean
            rest = done < lengths[query]
            source, symbol, after = self.extensions(state, side)
            origin, place = query[source], done[source]
            here = letter(origin, place)
            # insertion: behind the last of equal letters, at the border of the halves by side 1 only
            if side:
                inserted = symbol != here
            else:
                inserted = (symbol != letter(origin, place, -1)) & (place > exact[origin])
            replaced = (symbol != here) & rest[source]
            faulty.append((origin[inserted], place[inserted], after[:, inserted]))
            faulty.append((origin[replaced], place[replaced] + 1, after[:, replaced]))
            # deletion: the last of equal letters
            deleted = rest & (letter(query, done) != letter(query, done, 1 if side else -1))
            faulty.append((query[deleted], done[deleted] + 1, state[:, deleted]))
            matched = (symbol == here) & rest[source]
            clean = (origin[matched], place[matched] + 1, after[:, matched])
            faulty = tuple(np.concatenate(parts, axis=-1) for parts in zip(*faulty))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


# ---- blocks -----------------------------------------------------------------

NEAR = "word string, n bigint, n_near bigint, best struct<minus_n: bigint, word: string>"
_NEAR_ARROW = pa.schema([("word", pa.string()), ("n", pa.int64()), ("n_near", pa.int64()),
                         ("best", pa.struct([("minus_n", pa.int64()), ("word", pa.string())]))])


def search_block(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Near words of a block's queries. Rows: side, word, n, part and parts of the query, null for index words."""
    for side in (0, 1):
        own = rows.filter(pc.equal(rows.column("side"), side))
        asked = own.filter(pc.is_valid(own.column("part")))
        held = own.filter(pc.is_null(own.column("part")))
        counts = dict(zip(held.column("word").to_pylist(), held.column("n").to_pylist()))
        if not counts or not asked.num_rows:
            continue
        words = sorted(counts)
        index, marks = BidirectionalIndex(words), np.array([zlib.crc32(w.encode()) for w in words], np.int64)
        n = np.array([counts[w] for w in words])
        for at in range(0, asked.num_rows, STEP):
            part = asked.slice(at, STEP)
            queries = part.column("word").to_pylist()
            query, word = index.near(queries, side)
            # a half that is cut into several blocks: of these, only the one that this copy of the query asks
            parts, mine = part.column("parts").to_numpy(), part.column("part").to_numpy()
            kept = marks[word] % parts[query] == mine[query]
            query, word = query[kept], word[kept]
            order = np.lexsort((word, -n[word], query))  # words are sorted, so the smaller number is the smaller word
            query, word = query[order], word[order]
            firsts = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.empty(0, np.int64)
            near = np.diff(np.append(firsts, len(query)))
            out = [queries[q] for q in query[firsts]]
            own_n = part.column("n").to_numpy()[query[firsts]]
            best = [{"minus_n": -int(n[w]), "word": words[w]} for w in word[firsts]]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(own_n, pa.int64()), pa.array(near, pa.int64()),
                                              pa.array(best, _NEAR_ARROW.field("best").type)], schema=_NEAR_ARROW)


def _half(word: Column, length: Column, side: int) -> Column:
    """The exact half that a query of ``length`` letters has in common with ``word``."""
    first = F.floor(length / 2).cast("int")
    return F.substring(word, F.lit(1), first) if side else F.right(word, (length - first).cast("int"))


def deal(words: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Index words and queries by block: block, side, word, n, part, parts."""
    length = F.length("word")
    held = asked = None
    for side in (0, 1):
        halves = F.array_distinct(F.array(*[_half(F.col("word"), length + d, side) for d in (-1, 0, 1)]))
        one = words.select(F.lit(side).alias("side"), F.explode(halves).alias("half"), "word", "n")
        two = words.select(F.lit(side).alias("side"), _half(F.col("word"), length, side).alias("half"), "word", "n")
        held, asked = (one, two) if held is None else (held.unionByName(one), asked.unionByName(two))
    sizes = held.groupBy("side", "half").agg(F.count(F.lit(1)).alias("size"))
    cuts = durable(sizes.where(F.col("size") > block_words).select("side", "half", F.ceil(F.col("size") / block_words).cast("int").alias("parts")))
    blocks = max(1, -(-(sizes.agg(F.sum("size")).first()[0] or 0) // block_words))

    def cut(rows: DataFrame) -> DataFrame:
        return null_safe_join(rows, cuts, ["side", "half"]).withColumn("parts", F.coalesce("parts", F.lit(1)))

    def block(part: Column) -> Column:
        return F.pmod(F.xxhash64("side", "half", part), F.lit(blocks)).alias("block")

    of_word = F.pmod(F.crc32(F.encode("word", "UTF-8")), F.col("parts"))
    index = cut(held).select(block(of_word.cast("int")), "side", "word", "n", F.lit(None).cast("long").alias("part"), F.lit(None).cast("long").alias("parts")).distinct()
    copies = cut(asked).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    queries = copies.select(block(F.col("part")), "side", "word", "n", F.col("part").cast("long").alias("part"), F.col("parts").cast("long").alias("parts"))
    return index.unionByName(queries)


def near_words(words: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """word, n, n_near and the near word of largest count, the smallest of equal ones, as ``best``, for words
    that have any. ``words`` has distinct words and counts."""
    def run(rows: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(search_block(rows)), _NEAR_ARROW)

    found = deal(words, block_words).groupBy("block").applyInArrow(run, NEAR)
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words that have a form, by pointer doubling. A form has at least twice the word's
    count, so there are no cycles, and some sixty steps, six rounds, reach every root."""
    links = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = durable(null_safe_join(links, ahead, ["root"]))
        if moved.where("further IS NOT NULL").isEmpty():
            return links
        links = moved.select("word", F.coalesce("further", "root").alias("root"))


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS,
          least_count: int = LEAST_COUNT, typo_rate: int = 97, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per word of :func:`vocabulary`: word, form, root, n, n_near, form_n.

    Two words are near if they differ by exactly one inserted, deleted or replaced letter; ``n_near`` counts them.
    The form is the near word of largest n, the smallest in code-point order of equal ones, if its n is at least
    twice the word's n, else null. The root is the last word on the way from form to form, the word itself if it has
    none. Null and empty texts have no words, repeated rows count again, long texts and words are taken whole,
    extra columns do not matter, and an empty table gives an empty result.
    """
    if least_letters < 3:
        raise ValueError("words of fewer than three letters have no halves to match")
    words = durable(vocabulary(docs, id_col, text_col, least_letters, least_count, typo_rate))
    near = null_safe_join(words, near_words(words, block_words), ["word"])
    best_n = -F.col("best.minus_n")
    takes = best_n >= 2 * F.col("n")
    formed = durable(near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                 F.when(takes, F.col("best.word")).alias("form"), F.when(takes, best_n).alias("form_n")))
    roots = _roots(formed.where("form IS NOT NULL"))
    return null_safe_join(formed, roots, ["word"]).select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
