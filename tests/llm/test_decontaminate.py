"""Benchmark passages against brute force over words."""

import hashlib
import random
import re
from collections import Counter

import pytest

from panelweave.llm import decontaminate, queries

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
ITEMS = "item_id string, text string, doc_id int, spans int, `a.b` int"


def cut(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, width):
    """(id, words, hit words, items, matched original text of each run) per row."""
    windows = {}
    for item, text in items:
        words = cut(text)
        for i in range(max(len(words) - width + 1, 1) if words else 0):
            windows.setdefault(tuple(words[i:i + width]), set()).add(item)
    sizes, out = {len(w) for w in windows}, Counter()
    for doc, text in docs:
        words, hit, found = cut(text), set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if tuple(words[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(words[i:i + n])]
        places = [m.span() for m in WORD.finditer((text or "").translate(LOWER))]
        runs = [text[places[i][0]:places[next(j for j in range(i, len(words) + 1) if j not in hit) - 1][1]] for i in sorted(hit) if i - 1 not in hit]
        out[doc, len(words), len(hit), tuple(sorted(i for i in found if i is not None)), tuple(runs)] += 1
    return out


def tables(spark, odd):
    rng = random.Random(3)
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    passage = " ".join(docs[9][1].split()[20:50])
    items = [(f"q{i}", " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 14)))) for i in range(30)]
    items += [("q0", "one two"), (None, "Straße"), ("none", None), ("empty", ""), ("marks", " .,! "), ("zoo", passage.upper()),
              ("zoo", passage), ("ant", "w1"), ("9", passage), ("10", passage + " x"), ("é", "文本"), ("long", docs[16][1][5000:9000])]
    items += [(f"hot{i}", passage) for i in range(40)]
    docs += [(200, "É; ONE--two  é×Straße, und: " + passage.title().replace(" ", "\t;;")), (201, "w1" + "﻿ 中文 w1")]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n_words int, items string")
    return docs, items, frame.repartition(4), spark.createDataFrame([(*i, 1, 1, 1) for i in items], ITEMS)


def shown(frame, docs):
    return Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), tuple(s.end - s.begin for s in r.spans),
                    sum(s.last_word - s.first_word + 1 for s in r.spans)) for r in frame.collect())


@pytest.mark.parametrize("width,group_bytes,piece", [(10, 8 << 20, 1 << 20), (10, 4000, 1 << 20), (3, 2000, 300), (1, 8 << 20, 50)])
def test_hits_items_and_places(spark, odd, monkeypatch, width, group_bytes, piece):
    monkeypatch.setattr(decontaminate, "PIECE_BYTES", piece)
    monkeypatch.setattr(decontaminate, "ITEMS_PER_LIST", 20)
    docs, items, frame, bench = tables(spark, odd)
    found = decontaminate.find(frame, bench, width=width, group_bytes=group_bytes)
    want = Counter()
    for (doc, words, hit, names, runs), n in brute(docs, items, width).items():
        want[doc, words, hit, names, tuple(len(r) for r in runs), hit] += n
    assert shown(found, docs) == want
    assert sum(n for (*_, hit), n in want.items() if hit) > 5
    if group_bytes < 8 << 20:
        assert decontaminate.window_table(bench.select(bench.item_id.alias("item"), "text"), width, group_bytes)[1] > 1


def test_spans_are_places_of_the_original(spark, odd):
    docs, items, frame, bench = tables(spark, odd)
    unique = frame.where("doc_id >= 200")
    found = decontaminate.find(unique, bench).collect()
    texts = dict(docs)
    want = {k[0]: k[4] for k in brute([d for d in docs if (d[0] or 0) >= 200], items, 10)}
    assert {r.doc_id: tuple(texts[r.doc_id][s.begin:s.end] for s in r.spans) for r in found} == want
    left = {r.doc_id: r.text for r in decontaminate.remove_spans(unique, decontaminate.find(unique, bench)).collect()}
    for r in found:
        rest, at = "", 0
        for s in r.spans:
            rest, at = rest + texts[r.doc_id][at:s.begin], s.end
        assert left[r.doc_id] == rest + texts[r.doc_id][at:]


def test_empty_sides(spark, odd, none):
    docs, items, frame, bench = tables(spark, odd)
    assert decontaminate.find(none, bench).count() == 0
    clean = decontaminate.find(odd, bench.limit(0)).collect()
    assert len(clean) == odd.count() and all(r.n_hit == 0 and not r["items"] and not r.spans for r in clean)
    digest = queries.QUERIES["op12_decontamination"](spark, "/root/testdata/sf0.001").where("NOT contaminated").select("items_sha256").distinct().collect()
    assert [r[0] for r in digest] == [hashlib.sha256(b"").hexdigest()]
