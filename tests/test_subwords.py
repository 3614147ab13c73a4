"""Sub-word tokens against the library that the vocabulary belongs to."""

import base64
import random

import pytest
from pyspark.sql import functions as F

from panelweave.operators import subwords as sw
from panelweave.plans import flows
from panelweave.plans.text_queries import BEGIN, END, PAD, VOCABULARY

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return tokenizer


@pytest.fixture(scope="module")
def merges(spark):
    return sw.read_merges(spark, VOCABULARY)


ODD = ["", "  a \n\n b\t\tc  ", "中文 é ß 🎉🎉 x", "it's we'll 12 345!!", " x\u00a0y \x0b z", "<|endoftext|> now", "Straßenverkehr naïveté"]


def test_ids_and_places_equal_the_library(spark, small, merges, library):
    rows = [(i, t) for i, t in enumerate([*ODD, "a" * 5000 + "é" * 300, " " * 400])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").union(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text"))
    for r in sw.with_tokens(docs, "text", merges, spans="spans").collect():
        want = library.encode(r.text, add_special_tokens=False)
        assert r.ids == want.ids
        assert [(s.begin, s.end) for s in r.spans] == [tuple(o) for o in want.offsets]
        assert sw.decode(r.ids, merges) == r.text


def test_null_texts_other_columns_and_length(spark, merges, library):
    df = spark.createDataFrame([(1, None, "x"), (2, "one two three", None), (3, "", "y")], "`a.b` int, text string, name string")
    out = {r["a.b"]: r for r in sw.with_tokens(df, "text", merges, 2, "tokens").collect()}
    assert out[1].tokens == [] == out[3].tokens and out[2].tokens == library.encode("one two three").ids[:2]
    assert (out[1].name, out[2].name, out[1].text) == ("x", None, None)
    assert sw.with_tokens(df.limit(0), "text", merges).columns == ["a.b", "text", "name", "ids"]
    assert sw.with_tokens(df.limit(0), "text", merges).count() == 0


def test_long_pieces_merge_like_short_ones():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    rng = random.Random(0)
    for size in (1, 2, 3, 17, 90):
        for letters in (b"ab", b"thein ", bytes(range(256))):
            piece = bytes(rng.choice(letters) for _ in range(size))
            assert sw._merged_short(piece, ranks) == sw._merged_long(piece, ranks)
    assert b"".join(sw.merged(b"the" * 30_000, ranks)) == b"the" * 30_000


def test_only_byte_level_vocabularies(spark, tmp_path):
    (tmp_path / "v").write_text("YQ== 0\nYg== 1\n")
    with pytest.raises(ValueError, match="byte-level"):
        sw.read_merges(spark, str(tmp_path / "v"))


@pytest.mark.parametrize("answer", ["kehrs", "Straßenverkehrs", "ver", "war", "d", "nicht da", "ß"])
def test_labels_follow_tokens_that_begin_inside_a_word(spark, merges, library, answer):
    text = "Q: Was war A: der Straßenverkehrs-Verbund"
    got = sw.with_tokens(spark.createDataFrame([(text, answer)], "text string, answer string"), "text", merges, spans="spans").select(
        sw.labels_answer_span(F.col("ids"), F.col("spans"), F.col("text"), F.col("answer")).alias("labels")).first().labels
    found, at = library.encode(text), text.find(answer)
    want = [-100] * len(found.ids)
    if at >= 0:
        first = next(i for i, (a, b) in enumerate(found.offsets) if a <= at < b)
        last = next(i for i, (a, b) in enumerate(found.offsets) if a < at + len(answer) <= b)
        want[first:last + 2] = found.ids[first:last + 2]
    assert got == want
    assert any(text[a].isalpha() and text[a - 1].isalpha() for a, _ in found.offsets[1:])


def test_instructions_are_cut_behind_the_answer_or_in_it(spark, merges, library):
    rows = [(1, "say", "alpha beta"), (2, "say", "beta " * 40), (3, "long " * 60, "late"), (4, "none", None)]
    df = spark.createDataFrame(rows, "id int, ask string, reply string")
    out = {r.id: r for r in flows.instruct_rows(df, "id", "ask", "reply", "A {user} B {response}", merges, length=32).collect()}
    assert merges[1] == BEGIN and (merges.begin, merges.end, merges.pad) == (BEGIN, END, PAD)
    ids = library.encode("A say B alpha beta").ids
    assert out[1].input_ids == [*ids, END, *[PAD] * (31 - len(ids))] and sum(out[1].attention_mask) == len(ids) + 1
    assert [x for x in out[1].labels if x != -100] == [*library.encode(" alpha beta").ids, END]
    assert out[2].labels[-1] == END and out[2].labels[3] == library.encode("A say B beta").ids[3]  # cut inside the answer: to the end
    assert set(out[3].labels) == {-100}  # cut before it
