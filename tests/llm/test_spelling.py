"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from panelweave.llm import spelling

LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def edits(word, letters):
    return ({word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters} | {word[:i] + word[i + 1:] for i in range(len(word))}
            | {word[:i] + c + word[i + 1:] for i in range(len(word)) for c in letters}) - {word}


def brute(rows, rate=97):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
            if h % rate == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    letters, forms, near = sorted(set("".join(counts))), {}, {}
    for w, n in counts.items():
        found = sorted((-counts[v], v) for v in edits(w, letters) & counts.keys())
        near[w] = len(found)
        forms[w] = found[0][1] if found and -found[0][0] >= 2 * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.add((w, forms[w], root, n, near[w], counts[forms[w]] if forms[w] else None))
    return out


def variants(rng, letters, count, length):
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(4, length))) for _ in range(count)]
    for w in list(words):
        words += rng.sample(sorted(edits(w, letters)), 4)
    return words


@pytest.mark.parametrize("letters,length,seed", [("ab", 9, 0), ("abé", 8, 1), ("abcdefÿß", 12, 2), ("a", 12, 3)])
def test_pairs_come_once_and_in_one_side(letters, length, seed):
    rng = random.Random(seed)
    words = sorted({w for w in variants(rng, letters, 60, length) if w} if len(letters) > 1 else {"a" * i for i in range(3, 15)})
    index, asked = spelling.BidirectionalIndex(words), [w for w in words + ["zzzzz", "azbza"] if len(w) >= 2]
    got = Counter()
    for side in (0, 1):
        query, word = index.near(asked, side)
        got.update((asked[q], words[w]) for q, w in zip(query, word))
    assert got == Counter((q, w) for q in asked for w in edits(q, letters) & set(words))


def test_index_steps_count_occurrences():
    words = sorted(["banana", "ananas", "bandana", "nab"])
    index = spelling.BidirectionalIndex(words)
    text = "".join("$" + w for w in words) + "$"
    for pattern in ("$", "an", "ana", "$ban", "na$", "x", "$nab$"):
        state, back = index.delimiters(1), None
        codes = [0 if c == "$" else int(index.codes([c])[0][0, 0]) for c in pattern]
        whole = np.array([[0], [0], [sum(map(len, words)) + len(words)]])
        state, back = whole, whole
        for c in codes:
            state = index.extend(state, np.array([c]), 1)
        for c in reversed(codes):
            back = index.extend(back, np.array([c]), 0)
        count = len(words) if pattern == "$" else sum(text.startswith(pattern, i) for i in range(len(text)))
        assert state[2, 0] == back[2, 0] == count
        if count:
            assert state[:, 0].tolist() == back[:, 0].tolist()


def documents(rng):
    pool = variants(rng, "abcdé", 40, 9) + ["a" * i for i in range(4, 9)] + ["b" * 3000, "b" * 2999]
    weights = [rng.choice([1, 1, 2, 5, 30]) for _ in pool]
    rows = [(i, " 1.,-×÷\n"[i % 8].join(w.upper() if rng.random() < 0.2 else w for w in rng.choices(pool, weights, k=60))) for i in range(150)]
    return rows + [(1, None), (None, "aaaab aaaab"), (None, "aaaab"), (2, ""), (3, "\x00 中文 12"), rows[5], rows[5], (None, None)]


@pytest.mark.parametrize("options", [{}, {"block_words": 16}, {"block_words": 3}])
def test_words_forms_and_roots(spark, options):
    rows = documents(random.Random(4))
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, n int, word string, block int").repartition(5)
    out = spelling.group(df, typo_rate=7, **options).collect()
    got = Counter((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in out)
    want = brute(rows, 7)
    assert got == Counter(want)
    assert sum(r[1] is not None for r in want) > 20 and any(r[2] != r[1] and r[1] for r in want)


def test_task_tables_are_flushed(spark, odd, none, monkeypatch):
    monkeypatch.setattr(spelling, "TABLE_WORDS", 50)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert {tuple(r) for r in spelling.group(odd).collect()} == brute(rows)
    assert spelling.group(none).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert {tuple(r) for r in spelling.group(docs).collect()} == brute([(r.doc_id, r.text) for r in docs.collect()])
