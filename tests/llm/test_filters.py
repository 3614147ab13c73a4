"""Fixed-size filters: the same rows at every size."""

import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.llm import common, exact_dedup, jaccard, repeats, warc


def counted(frame, *columns):
    return Counter(tuple(str(r[c]) for c in columns) for r in frame.collect())


OPERATORS = {
    "exact_dedup": lambda odd, **o: counted(exact_dedup.classify(odd, **o), "doc_id", "keep_id", "group_size", "kept", "text_sha256"),
    "jaccard": lambda odd, **o: counted(jaccard.near_duplicates(odd, **o), "doc_id", "n_shingles", "component_id"),
    "repeats": lambda odd, **o: counted(repeats.find(odd, **o), "doc_id", "n_words", "repeated"),
    "warc": lambda odd, **o: counted(warc.with_digests(odd.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html")), **o),
                                     "page_id", "digest", "refers_to"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_do_not_depend_on_the_size(odd, name):
    want = OPERATORS[name](odd)
    assert len(want) > 5
    for bits in (20, 24, 28):
        assert OPERATORS[name](odd, filter_bits=bits) == want, bits


@pytest.mark.parametrize("bits", [14, 20, 28])
def test_every_key_is_found(spark, bits):
    keys = common.mix(np.arange(1, 3001, dtype=np.uint64))
    df = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)] + [(None,)], "k long").repartition(5)
    flags = common.presence_filter(df, "k", bits)
    assert len(flags) == 1 << (bits - 3)
    assert common.in_filter(flags, keys).all()
    others = common.mix(np.arange(10_001, 20_001, dtype=np.uint64))
    assert common.in_filter(flags, others).mean() < (0.3 if bits == 14 else 0.02)


def test_the_size_follows_the_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "LEAST_BITS", 10)
    monkeypatch.setattr(common, "MOST_BITS", 17)
    sizes = [len(common.presence_filter(spark.range(n), "id")) * 8 for n in (0, 10, 100_000)]
    assert sizes == [1 << 10, 1 << 10, 1 << 17]


def test_records_of_one_large_piece_cost_their_size():
    one = warc.record("response", 1, "u", b"x" * 600, 600, "d")
    seconds = []
    for count in (4_000, 32_000):
        piece = one * count
        started = time.perf_counter()
        assert sum(len(whole) for _, _, whole in warc.split_records(iter([piece]))) == len(piece)
        seconds.append(time.perf_counter() - started)
    assert seconds[1] < 24 * seconds[0]
    odd = [one[:5], one[5:] + one[:300], b"", one[300:], one]
    assert [block for _, block, _ in warc.split_records(iter(odd))] == [block for _, block, _ in warc.split_records(iter([one * 3]))]
