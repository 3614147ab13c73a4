import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelweave.functions import text as tx
from panelweave.operators import corpus as cp
from panelweave.operators import languages as lg
from panelweave.operators import subwords as sw


def py_paragraphs(text, least):
    parts = [re.sub(r"\n(?![^\u0000-\u007F]+)", "", p).strip(" ") for p in re.split(r"\n{2,}", text.strip("\n"))]
    return [p for p in parts if len(p.split(" ")) >= least]


def py_windows(text, size, overlap):
    words, step = text.split(" "), int(size * (1 - overlap))
    count = 1 if len(words) <= size else 1 + math.ceil((len(words) - size) / step)
    return [" ".join(words[i * step:i * step + size]).strip(" ") for i in range(count)]


def test_paragraphs_and_windows_equal_the_plain_rule_on_all_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    # blank lines and bullets that the given texts lack
    shaped = docs.select("doc_id", F.regexp_replace("text", r"\. ", ".\n\n").alias("text")).union(
        spark.createDataFrame([(-1, "\n\na b\n• c\nd e f\n\n\n  g h i \n")], "doc_id bigint, text string"))
    got = {}
    for r in cp.chunk_overlap(cp.split_paragraphs(shaped, "text", 3), "text", 7, 0.45).collect():
        got.setdefault(r.doc_id, {})[r.paragraph_no, r.chunk_no] = r.text
    for r in shaped.collect():
        want = {(i, j): c for i, p in enumerate(py_paragraphs(r.text, 3)) for j, c in enumerate(py_windows(p, 7, 0.45))}
        assert got.get(r.doc_id, {}) == want


def test_direction_marks_and_markers(spark):
    row = spark.range(1).select(
        tx.strip_direction_marks(F.lit("a‫\nb‬c‪")).alias("a"),
        tx.after_last_marker(F.lit("x Fixed: y Fixed: z \n"), "Fixed:").alias("b"),
        tx.after_last_marker(F.lit("none"), "Fixed:").alias("c"),
        tx.after_last_marker(F.lit("none "), "Fixed:", True).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == ("abc", "z", None, "none")


def test_language_of_given_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    learned = lg.learn_profiles(docs, "text", "lang")
    found = docs.select("lang", lg.detect_language(F.col("text"), learned).alias("found"))
    right, total = found.agg(F.sum((F.col("lang") == F.col("found")).cast("int")), F.count("lang")).first()
    assert right / total > 0.98
    for text in ("zzz qqq", "", "12 !?", None):
        assert spark.range(1).select(lg.detect_language(F.lit(text).cast("string"), learned).alias("l")).first().l is None


def test_pad_mask_and_labels(spark):
    row = spark.range(1).select(F.array(*[F.lit(x).cast("bigint") for x in (5, 1, 7, 2, 8, 2)]).alias("ids")).select(
        tx.pad_ids(F.col("ids"), 8, 9).alias("long"), tx.pad_ids(F.col("ids"), 3).alias("short"),
        tx.attention_mask(F.col("ids"), 8).alias("mask"), tx.attention_mask(F.col("ids"), 3).alias("full"),
        tx.labels_until_eos(F.col("ids"), 1, 2).alias("eos"), tx.labels_until_eos(F.col("ids"), 1, 99).alias("none")).first()
    assert row.long == [5, 1, 7, 2, 8, 2, 9, 9] and row.short == [5, 1, 7]
    assert row.mask == [1] * 6 + [0, 0] and row.full == [1, 1, 1]
    assert row.eos == [5, 1, 7, 2, -100, -100] and row.none == [5, 1, 7, 2, 8, 2]


@pytest.mark.parametrize("text,answer", [("ask me now the answer is here end of it", "the answer is"), ("a b c", "c"), ("a b c", "zz")])
def test_answer_span(spark, text, answer):
    words = text.split(" ")
    ends = [len(" ".join(words[:i + 1])) for i in range(len(words))]
    df = spark.createDataFrame([(text, answer, list(range(len(words))), [(e - len(w), e) for w, e in zip(words, ends)])],
                               "t string, a string, ids array<bigint>, spans array<struct<begin: int, end: int>>")
    got = df.select(sw.labels_answer_span(F.col("ids"), F.col("spans"), F.col("t"), F.col("a")).alias("l")).first().l
    want, pos = [-100] * len(words), text.find(answer)
    if pos >= 0:
        offsets, at = [], 0
        for w in words:
            offsets.append((at, at + len(w)))
            at += len(w) + 1
        first = next(i for i, (s, e) in enumerate(offsets) if s <= pos < e)
        last = next(i for i, (s, e) in enumerate(offsets) if s < pos + len(answer) <= e)
        for i in range(first, min(last + 2, len(words))):
            want[i] = i
    assert got == want


def test_encode_round_trip_and_frequency_order(spark):
    docs = spark.createDataFrame([(1, "b a  b\nc"), (2, "b a")], "doc_id bigint, text string")
    vocab = cp.vocabulary(docs, "doc_id", "text")
    ids = {r.token: r.token_id for r in vocab.collect()}
    assert ids == {"b": 0, "a": 1, "c": 2}
    assert {r.doc_id: r.ids for r in cp.encode(docs, "doc_id", "text", vocab).collect()} == {1: [0, 1, 0, 2], 2: [0, 1]}


def test_papers_keep_earliest_term_and_last_position(spark):
    rows = [(0, 0, 1, "t1", "a"), (0, 1, 2, "t2", "b"), (0, 2, 3, "t1", "a"), (1, 0, 4, "t2", "b"), (1, 1, 5, "t3", "c"), (1, 2, 6, "t1", "z")]
    df = spark.createDataFrame(rows, "term int, pos int, doc int, title string, author string")
    assert sorted(r.doc for r in cp.dedup_papers(df, "term", "pos").collect()) == [2, 3, 5, 6]


def test_signature(spark):
    df = spark.createDataFrame([(1, bytearray(b"%PDF-1.4")), (2, bytearray(b"<html>"))], "id int, content binary")
    assert [r.id for r in cp.signature_filter(df, "content").collect()] == [1]


def test_a_conversation_is_one_row_whatever_its_turn_numbers(spark):
    turns = [(1, 9_990 + i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(25)] + [(2, 0, "assistant", "x")]
    df = spark.createDataFrame(turns, "conv int, turn int, role string, text string")
    out = cp.flatten_chat(df, "conv", "turn", "role", "text").orderBy("conv").collect()
    assert [(r.conv, r.valid) for r in out] == [(1, 1), (2, 0)]
    assert out[0].chat == "\n".join(f"<{r}> {t}" for _, _, r, t in turns[:25])


def test_documents_without_tokens_stay(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, "c ?")], "doc_id int, text string")
    vocab = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "token string, token_id bigint")
    assert {r.doc_id: r.ids for r in cp.encode(docs, "doc_id", "text", vocab).collect()} == {1: [0, 1, 0], 2: [], 3: [], 4: [2]}
    assert {r.doc_id: r.ids for r in cp.encode(docs, "doc_id", "text", vocab, 2).collect()} == {1: [0, 1], 2: [], 3: [], 4: [2]}


@pytest.mark.parametrize("words,least", [(None, 0.98), (10, 0.95), (5, 0.95)])
def test_language_recall_and_precision_on_held_out_documents(spark, words, least):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learned = lg.learn_profiles(docs, "text", "lang", ["doc_id"], 0.25, 3)
    text, held = F.col("text"), docs.where(~lg.in_share(0.25, 3, "doc_id"))
    if words:  # a few words from inside the text
        held = held.where(F.size(F.split("text", r"\s+")) >= words + 2)
        text = F.array_join(F.slice(F.split("text", r"\s+"), 2, words), " ")
    rows = held.select("lang", lg.detect_language(text, learned).alias("found")).groupBy("lang", "found").count().collect()
    for language in learned.languages:
        hit = sum(r["count"] for r in rows if r.lang == r.found == language)
        assert hit >= least * sum(r["count"] for r in rows if r.lang == language), language
        assert hit >= least * sum(r["count"] for r in rows if r.found == language), language


def test_profiles_equal_plain_counting(spark, small):
    """Counts, weights and winners rebuilt in Python."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang").limit(40)
    docs = docs.union(spark.createDataFrame([(-1, None, "en"), (-2, "abc " * 3 + "x" * 70 + " Ärger", None), (-3, "", "xx"), (-4, "ß É", "xx")], docs.schema))
    rows = [(r.text, r.lang) for r in docs.collect()]

    def buckets(text):
        words = dict.fromkeys(w for w in re.findall(r"[^\W\d_]{1,30}", (text or "").lower()))
        return [(ord(s[i]) * 1723 + ord(s[i + 1]) * 59 + ord(s[i + 2])) % 16381 for w in words for s in [f"  {w}  "] for i in range(len(s) - 2)]

    counts = {}
    for text, lang in rows:
        if lang:
            counts.setdefault(lang, Counter()).update(buckets(text))
    counts = {k: c for k, c in counts.items() if c}
    learned = lg.learn_profiles(docs, "text", "lang")
    assert learned.languages == tuple(sorted(counts))
    for name, line in zip(learned.languages, learned.weights):
        total = sum(counts[name].values())
        want = {b: math.floor(1000 * math.log((n / total + 0.5 / 16381) / (0.5 / 16381)) + 0.5) for b, n in counts[name].items()}
        assert {b: w for b, w in enumerate(line) if w} == {b: w for b, w in want.items() if w}
    found = [r.l for r in docs.select(lg.detect_language(F.col("text"), learned).alias("l")).collect()]
    for (text, _), got in zip(rows, found):
        scores = sorted((-sum(line[b] for b in buckets(text)), name) for name, line in zip(learned.languages, learned.weights))
        assert got == (scores[0][1] if scores[1][0] - scores[0][0] >= 3000 else None)


def test_no_labelled_texts(spark):
    df = spark.createDataFrame([(1, "some text", None)], "id int, text string, lang string")
    assert lg.language_filter(df, "text", ["en"], lg.learn_profiles(df, "text", "lang")).count() == 0


def test_chat_layout_with_and_without_system(spark):
    df = spark.createDataFrame([("m", "hi", "be kind"), ("m", "hi", None), ("other", "hi", None)], "family string, ask string, sys string")
    layouts = {"m": ("S: {system} U: {user} A: {response}", "U: {user} A: {response}")}
    got = [r.text for r in cp.format_chat(df.withColumn("reply", F.lit("ok")), layouts, "family", "ask", "sys", "reply").collect()]
    assert got == ["S: be kind U: hi A: ok", "U: hi A: ok", None]


def test_document_split_is_stable(spark):
    docs = spark.range(2000)
    first = {r.id: r.split for r in cp.split_docs(docs, "id", 0.8, 1).collect()}
    again = {r.id: r.split for r in cp.split_docs(docs.repartition(7), "id", 0.8, 1).collect()}
    assert first == again
    assert 0.75 < sum(s == "train" for s in first.values()) / 2000 < 0.85


def test_language_filter_scores_batches_as_the_column_does(spark, small):
    """Whole batches in numpy, no run of characters as a row value, and the same choice also for odd texts."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang", "text")
    learned = lg.learn_profiles(docs, "text", "lang")
    odd = [None, "", "1 2", "a", "\U0001d4d0\U0001d4d1 \U0001f600", "\u0130\u03a3 ZUM \u00dfa", "the the the", "x" * 100]
    rows = docs.select("text").unionByName(spark.createDataFrame([(t,) for t in odd], "text string"))
    for margin in (3.0, 0.0, 200.0):
        ours = lg.language_filter(rows, "text", ["en", "fr"], learned, margin)
        plan = ours._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "sequence(" not in plan and "Exchange" not in plan
        same = rows.select("text", lg.detect_language(F.col("text"), learned, margin).alias("language")).where(F.col("language").isin("en", "fr"))
        order = ["text", "language"]
        assert ours.orderBy(*order).collect() == same.orderBy(*order).collect()
