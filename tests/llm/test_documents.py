"""Operators over documents against brute force, on rows with every oddity, and on an empty table."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from odd_documents import odd_rows
from tokenizers import Tokenizer

from panelweave.llm import exact_dedup, exchange, jaccard, lines, mixing, packing, repeats, tokens
from panelweave.llm.common import hashed_pieces

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SPACES = b" \t\n\x0b\x0c\r"


def lowered(text):
    return (text or "").encode().translate(LOWER)


def some(items):
    return Counter(map(tuple, items))


def test_word_hashes_tell_words_apart():
    texts = [b"a bb A\tab  ba", b"", b" ", b"x" * 50 + b" \x0b" + b"y z" * 40, "é É \u00a0".encode()]
    for most in (1, 20, 1 << 20):
        got = {}
        for first, hashes, sizes in hashed_pieces(texts, most):
            ends = np.cumsum(sizes)
            got |= {first + i: hashes[e - n:e].tolist() for i, (n, e) in enumerate(zip(sizes, ends))}
        names = [w for t in texts for w in t.lower().split()]
        values = [h for i in range(len(texts)) for h in got[i]]
        assert [len(got[i]) for i in range(len(texts))] == [len(t.split()) for t in texts]
        assert len(set(zip(names, values))) == len(set(names)) == len(set(values))


# exchange and exact copies

@pytest.mark.parametrize("count", [0, 1, 2, 7, 1000])
def test_rice_codes_round_trip(count):
    keys = np.unique(np.random.default_rng(count).integers(0, 1 << 64, count, dtype=np.uint64))
    assert np.array_equal(exchange.rice_decode(exchange.rice_encode(keys)), keys)
    near = np.arange(count, dtype=np.uint64)
    assert np.array_equal(exchange.rice_decode(exchange.rice_encode(near)), near)


def sent_to_one_owner(parts, most, rng):
    """Keys of each part and the messages of all, as the one owner gets them, not in order."""
    keys = [rng.choice(most, most // 4).astype(np.uint64) << np.uint64(20) for _ in range(parts)]
    batches = [exchange.messages(part, own, 1) for part, own in enumerate(keys)]
    return keys, [batches[i] for i in rng.permutation(parts)]


def test_owners_answers_by_counting():
    keys, batches = sent_to_one_owner(20, 400, np.random.default_rng(3))
    counts, seen = Counter(k for own in keys for k in own.tolist()), set()
    assert 1 in counts.values()
    [again] = exchange.repeated_keys(iter(batches))
    assert again.column("key").to_pylist() == sorted(k for k, n in counts.items() if n > 1)
    [answers] = exchange.answer(iter(batches))
    answers = {part: (a, b) for part, a, b in zip(*[answers.column(n).to_pylist() for n in ("part", "repeated", "first")])}
    for part, own in enumerate(keys):
        own = np.unique(own).tolist()
        repeated, first = (exchange.flags_of(bits, len(own)).tolist() for bits in answers[part])
        assert repeated == [counts[k] > 1 for k in own]
        assert first == [k not in seen for k in own]
        seen |= set(own)
    assert list(exchange.answer(iter([]))) == []
    assert [batch.num_rows for batch in exchange.repeated_keys(iter([]))] == [0]


def test_an_owner_holds_its_keys_not_all_of_them_for_each_message():
    import tracemalloc

    rng = np.random.default_rng(1)
    half = [np.unique(rng.integers(0, 1 << 64, 600, dtype=np.uint64)) for _ in range(400)]
    batches = [exchange.messages(part, own, 1) for part, own in enumerate(half + half)]  # each key in two parts
    total = 2 * sum(map(len, half))
    for run in (exchange.answer, exchange.repeated_keys):
        tracemalloc.start()
        list(run(iter(batches)))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 80 * total, run.__name__


def test_each_owner_has_a_partition(spark):
    owners = 40
    sent = spark.range(owners * 3).selectExpr("CAST(id % 40 AS INT) AS owner", "id AS part")
    held = exchange.to_owners(sent, owners).rdd.glom().map(lambda rows: {r.owner for r in rows}).collect()
    assert held == [{i} for i in range(owners)]


def test_exact_dedup(odd):
    out = exact_dedup.classify(odd).collect()
    groups = defaultdict(list)
    for doc_id, text, _ in odd_rows():
        groups[lowered(text)].append(doc_id)
    want = Counter((i, max((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(body).hexdigest())
                   for body, ids in groups.items() for i in ids)
    assert some((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out) == want
    kept = Counter(r.text_sha256 for r in out if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in out if r.kept)


def test_exact_dedup_keeps_one_row_of_each_text(odd, none):
    out = exact_dedup.keep_one(odd)
    assert out.columns == odd.columns
    assert sorted(lowered(r.text) for r in out.collect()) == sorted({lowered(t) for _, t, _ in odd_rows()})
    assert exact_dedup.classify(none).count() == 0


def test_rows_that_repeat_but_for_case_stay_once(spark):
    rows = [(9, "ABC", 1), (9, "abc", 2), (9, "Abc", 3), (8, "abC", 4), (None, None, 5), (None, "", 6), (3, "É", 7), (3, "é", 8)]
    out = exact_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, n int"))
    assert out.columns == ["doc_id", "text", "n"]
    assert Counter((r.doc_id, lowered(r.text)) for r in out.collect()) == Counter(
        [(9, lowered("abc")), (None, lowered("")), (3, lowered("É")), (3, lowered("é"))])


# near copies

def shingle_sets():
    sets = []
    for doc_id, text, _ in odd_rows():
        w = [x for x in re.split(rb"[ \t\n\x0b\x0c\r]+", lowered(text)) if x]
        sets.append((doc_id, frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    return sets


def by_brute_force(sets):
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[max(top(i), top(j))] = min(top(i), top(j))
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(sets):
        ids[top(i)].append(doc_id)
    return [(doc_id, len(s), min((x for x in ids[top(i)] if x is not None), default=None)) for i, (doc_id, s) in enumerate(sets)]


@pytest.mark.parametrize("options", [{}, {"block_shingles": 300, "heavy": 2, "sketch_bits": 12}])
def test_near_copies(odd, options):
    out = jaccard.near_duplicates(odd, **options).collect()
    assert some((r.doc_id, r.n_shingles, r.component_id) for r in out) == some(by_brute_force(shingle_sets()))


def test_near_copies_keep_one_of_each_group(odd, none):
    out = jaccard.keep_one(odd)
    assert out.columns == odd.columns
    groups = {(g, n > 0) if n else (i, d) for i, (d, n, g) in enumerate(by_brute_force(shingle_sets()))}
    distinct = {(r.doc_id, r.text) for r in out.collect()}
    assert len(distinct) == len({x for x in groups if x[1] is True}) + len({(d, t) for (d, t, _), (_, n, _) in zip(odd_rows(), by_brute_force(shingle_sets())) if not n})
    assert jaccard.near_duplicates(none).count() == 0


def test_regions_need_no_more_than_the_windows():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 60, 200, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 200 - k, replace=False), rng.integers(0, 1 << 60, k, dtype=np.uint64)])) for k in rng.integers(0, 60, 40)]
    region = jaccard.Region([s.tobytes() for s in sets])
    links = jaccard.join_region(region, 75)
    root = list(range(len(sets)))
    for a, b in links:
        ra, rb = root[a], root[b]
        root = [ra if x == rb else x for x in root]
    full = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            if 100 * both >= 75 * (len(a) + len(b) - both):
                x, y = full[i], full[j]
                full = [x if z == y else z for z in full]
    assert len(links) == len(sets) - len(set(full))
    assert len({(x, y) for x, y in zip(root, full)}) == len(set(root)) == len(set(full))


# packing

def test_packing(odd, none):
    file = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(file)
    out = packing.pack(odd, file, public_tokenizers.path("byte_bpe_50k.tiktoken"), segment=5000).collect()
    want = Counter()
    for doc_id, text, _ in odd_rows():
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want[doc_id, ids.tobytes()] += 1
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append(r)
    total = 0
    for rows in sequences.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == np.cumsum([0, *[r.length for r in rows]])[:-1].tolist()
        size = sum(r.length for r in rows)
        assert size <= 2048
        total += 0 if size & (size - 1) == 0 else 2048 - size
    assert total < 0.05 * sum(r.length for r in out)
    assert sum(r.length for r in out) == sum(len(ids) // 4 * n for (_, ids), n in want.items())
    texts = defaultdict(list)
    for (doc_id, ids), n in want.items():
        texts[doc_id, len(ids) // 4] += [np.frombuffer(ids, "<u4")] * n
    assert set(texts) == set(pieces)
    for key, rows in pieces.items():
        assert Counter(r.start for r in rows)[0] == len(texts[key])
        for r in rows:
            assert any(zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32 for ids in texts[key])
    assert packing.pack(none, file).count() == 0


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(1)
    for _ in range(30):
        cuts = np.unique(rng.integers(1, 60, 12))
        penalties = rng.integers(0, 5, len(cuts)).astype(float)
        penalties[-1] = 0
        ends = packing.choose_cuts(int(cuts[-1]), cuts, penalties, 16)
        fixed = dict(zip(cuts.tolist(), penalties.tolist()))
        gaps = np.diff(cuts, prepend=0)
        for cut, gap in zip(cuts.tolist(), gaps.tolist()):
            if gap > 16:
                fixed |= {p: packing.TOKEN_CUT for p in range(cut - gap + 16, cut, 16)}
        places, last = sorted(fixed), int(cuts[-1])

        def step(a, b):
            free = b - a == 16 or b - a in ((2, 4, 8) if b < last else (1, 2, 4, 8))
            return (0 if free else 16 - (b - a)) + fixed[b]

        best = {0: 0.0}
        for b in places:
            best[b] = min(best[a] + step(a, b) for a in best if b - a <= 16)
        assert sum(step(a, b) for a, b in zip([0, *ends], ends)) == best[last]


@pytest.mark.parametrize("window", [16, 32, 64])
def test_cuts_are_the_cheapest_of_all_powers(window):
    rng = np.random.default_rng(window)
    powers = [1 << i for i in range(10) if 1 << i <= window]
    for _ in range(60):
        cuts = np.unique(np.append(rng.integers(1, 200, 90), 1 + np.arange(0, 200, 16)))  # no gap is wide
        penalties = rng.integers(0, 5, len(cuts)).astype(float)
        ends = packing.choose_cuts(int(cuts[-1]), cuts, penalties, window, all_powers=True)
        fixed = dict(zip(cuts.tolist(), penalties.tolist()))

        def step(a, b):
            return (0 if b - a in powers else window - (b - a)) + fixed[b]

        best = {0: 0.0}
        for b in sorted(fixed):
            best[b] = min(best[a] + step(a, b) for a in best if b - a <= window)
        assert all(b - a <= window for a, b in zip([0, *ends], ends))
        assert sum(step(a, b) for a, b in zip([0, *ends], ends)) == best[int(cuts[-1])]


def test_streams_are_packed_with_all_powers():
    """Documents of 1, 2048, 64 and 2048 tokens leave no padding when small windows may stand inside the stream."""
    stream = packing._Stream(0)
    sizes = [1, 2048, 64, 2048]
    for i, n in enumerate(sizes):
        stream.add(i, np.full(n, 5, np.uint32))
    pieces = list(stream.solve(np.zeros(10, bool), True, 2048))
    assert [(p[0], p[2]) for p in pieces] == list(enumerate(sizes)) and [p[5] for p in pieces] == [0, 1, 2, 3]


# frequent lines

@pytest.mark.parametrize("options", [{}, {"group_bytes": 1}, {"least_documents": 2, "least_characters": 9, "group_bytes": 1}])
def test_frequent_lines(odd, none, options):
    least, letters = options.get("least_documents", 10), options.get("least_characters", 1)
    split = [[(line, line.strip(SPACES).translate(LOWER)) for line in (t or "").encode().split(b"\n")] for _, t, _ in odd_rows()]
    found = Counter(key for doc in split for key in {k for _, k in doc})
    gone = {k for k, n in found.items() if n >= least and len(k.decode()) >= letters}
    want = Counter((i, len(doc), sum(k in gone for _, k in doc), b"\n".join(x for x, k in doc if k not in gone).decode()) for (i, _, _), doc in zip(odd_rows(), split))
    assert gone
    assert some(lines.drop_frequent(odd, **options).collect()) == want
    assert lines.drop_frequent(none, **options).count() == 0


def test_what_is_broadcast_stays_below_group_bytes(spark, monkeypatch):
    """One shard that alone is larger than a group."""
    texts = ["\n".join(f"line {i}" for i in range(1500)) + f"\nown {n}" for n in range(2)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sent, broadcast = [], type(spark.sparkContext).broadcast

    def watched(self, value):
        sent.append(sum(len(blob) for _, blob in value))
        return broadcast(self, value)

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", watched)
    monkeypatch.setattr(lines, "shuffle_partitions", lambda _: 1)
    out = lines.drop_frequent(df, least_documents=2, group_bytes=12_000).collect()
    assert sorted((r.n_lines, r.n_dropped, r.kept_text) for r in out) == [(1501, 1500, "own 0"), (1501, 1500, "own 1")]
    assert len(sent) > 1 and max(sent) <= 12_000


def test_perfect_hash_numbers_all_keys():
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 63, 50_000).astype(np.uint64))
    table = lines.PerfectHash(keys)
    assert np.array_equal(np.sort(table.find(keys)), np.arange(len(keys)))
    shard = lines.Shard.of(lines.Shard(keys, keys * np.uint64(3), np.full(len(keys), 12)).state())
    assert (shard.documents(keys, keys * np.uint64(3)) == 12).all()
    assert not shard.documents(keys + np.uint64(1), keys).any()


# mixing

def test_mixing(odd, none):
    out = mixing.mix(odd).collect()
    sizes = [(i, len([w for w in re.split("[ \t\n\x0b\x0c\r]+", t or "") if w]), s) for i, t, s in odd_rows()]
    own = Counter()
    for _, n, s in sizes:
        own[s] += n
    assert some((r.doc_id, r.mix.size, r.source, r.mix.source_size) for r in out) == some((i, n, s, own[s]) for i, n, s in sizes)
    order = sorted(own, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    while True:
        left = sum(own.values()) - sum(3 * own[s] for s in order if s not in open_)
        target = {s: left * weight[s] / sum(weight[x] for x in open_) if s in open_ else 3 * own[s] for s in order}
        above = {s for s in open_ if target[s] > 3 * own[s]}
        if not above:
            break
        open_ -= above
    for r in out:
        assert r.mix.target == pytest.approx(target[r.source])
        assert r.mix.taken == r.mix.size * r.mix.copies <= 3 * r.mix.size
    for s in order:
        mine = [r for r in out if r.source == s]
        assert abs(sum(r.mix.taken for r in mine) - target[s]) <= max(r.mix.size for r in mine)
    assert some((r.doc_id, r.mix.taken) for r in mixing.mix(odd.repartition(3)).collect()) == some((r.doc_id, r.mix.taken) for r in out)
    repeated = mixing.repeat_taken(odd)
    assert repeated.columns == odd.columns
    assert sum(r.mix.copies for r in out) == repeated.count()
    assert mixing.mix(none).count() == 0


# token counts

def test_token_counts(odd, none):
    import sentencepiece

    file = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=file)
    want = Counter((i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for i, t, _ in odd_rows())
    assert some(tokens.count_tokens(odd, file).collect()) == want
    assert tokens.count_tokens(none, file).count() == 0


def test_shortcut_gives_the_library_counts():
    import random

    counter = tokens.PieceCounter(public_tokenizers.path("piece_bpe_32k.model"))
    assert counter.separable and len(counter.whole) > 1000
    rng = random.Random(4)
    parts = ["a", " ", "  ", "▁", "\n", "the", "é", "中", "<s>", "\x00", "ing", "\t", "🙂", "x" * 30, "<0x0A>", "12", "\r\n", "\x85", "\xa0"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(3000)]
    assert counter.count(texts) == [len(x) for x in counter.model.encode(texts)]


# repeated passages

@pytest.mark.parametrize("length, gram", [(50, 16), (10, 4)])
def test_repeated_passages(odd, none, length, gram):
    texts = [(i, [w for w in re.split(rb"[ \t\n\x0b\x0c\r]+", lowered(t)) if w]) for i, t, _ in odd_rows()]
    seen = Counter(tuple(w[k:k + length]) for _, w in texts for k in range(len(w) - length + 1))
    want = Counter()
    for i, w in texts:
        spans = []
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k:k + length])] > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + length
                else:
                    spans.append([k, k + length])
        if spans:
            want[i, len(w), tuple(map(tuple, spans))] += 1
    out = repeats.find(odd, length=length, gram=gram).collect()
    assert some((r.doc_id, r.n_words, tuple(map(tuple, r.repeated))) for r in out) == want
    # what is dropped leaves every repeated window once
    assert all(any(a <= c and d <= b for a, b in r.repeated) for r in out for c, d in r.dropped)
    assert repeats.find(none, length=length, gram=gram).count() == 0
