"""Vectors, archives, the classifier and the pipeline."""

import gzip
import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from panelweave.llm import quality, topk, warc


def vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(700)]
    rows += [(1000 + i, [0.5] * 8) for i in range(60)]  # one common vector, with queries 1000
    rows += [(2000, None), (2100, [1.0, None] + [0.0] * 6), (2200, [float("nan")] * 8), (2300, [float("inf")] * 8), (None, [0.1] * 8),
             (2400, [0.25, 0.5]), (2500, [0.5, 0.25]), (300, rows[300][1])]
    return rows, spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, cell int, query int")


@pytest.mark.parametrize("options", [{}, {"block": 50, "pivots": 3, "queries_per_task": 3}])
def test_top_k(spark, options):
    rows, df = vectors(spark)
    good = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = Counter()
    for q, v in {(q, tuple(v)) for q, v in good if q % 100 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))
        want.update((q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:10]))
    out = topk.top_k(df, **options).collect()
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in out) == want


@pytest.mark.parametrize("repeats", [2, 3, 25])
def test_top_k_counts_ids_not_rows_among_equal_vectors(spark, repeats):
    """A query whose own id repeats inside a group of equal vectors still gets k hits; so do rows that repeat beside it."""
    ids = [100] * repeats + list(range(101, 121)) + [200] * 2 + [105, 105] + [90] * (repeats - 1)
    df = spark.createDataFrame([(i, [0.5, 0.25]) for i in ids], "vec_id long, embedding array<double>")
    want = Counter()
    for q in (100, 200):
        want.update((q, r + 1, i) for r, i in enumerate(sorted(i for i in ids if i != q)[:10]))
    assert Counter((r.query_id, r["rank"], r.vec_id) for r in topk.top_k(df).collect()) == want


def test_top_k_of_nothing(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_trees_cover_their_points():
    points = np.random.default_rng(1).integers(-50, 50, (900, 5)).astype(float)
    held = []

    def walk(node):
        assert np.sqrt(((points[node.points] - node.center) ** 2).sum(axis=1)).max() <= node.radius + 1e-9
        if node.children:
            assert sorted(np.concatenate([c.points for c in node.children])) == sorted(node.points)
            for child in node.children:
                walk(child)
        else:
            held.extend(node.points)

    walk(topk.cover_tree(points, np.arange(900)))
    assert sorted(held) == list(range(900))


PAGES = "page_id long, url string, html string, digest int, size int"


def test_archives(spark):
    long_ = "é" * 60
    rows = [(1, "http://a/ü b", long_), (2, None, long_), (3, "http://c\r\nx", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""),
            (None, "u", long_), (None, None, None), (7, "u", "x" * 99), (8, "u", "x" * 99), (9, "u", "y" * 100), (10, "u", "y" * 100), (9, "u", "y" * 100),
            (11, "u", "WARC/1.1\r\n\r\n" * 20), (12, "u", "z" * 300_000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], PAGES)
    out = warc.round_trip(df).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h] = min(i, first.get(h, i))
    want = Counter()
    for i, _, html in rows:
        body = (html or "").encode()
        revisit = len(body) >= 100 and i != first[html]
        want[i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first[html] if revisit else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out) == want
    assert Counter(bytes(r.payload) for r in out if r.record_type == "response")[("z" * 300_000).encode()] == 1
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_normalised_members_and_index(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://h/{i}", f"page {i} " * 50, 1, 2) for i in range(40)], PAGES).repartition(2)
    whole = warc.write_archives(df, f"file://{tmp_path}/whole")
    assert all(zlib.decompressobj(31).decompress(open(r.path.removeprefix("file://"), "rb").read()).count(b"WARC/1.1") == r.records for r in whole.collect())
    members = warc.normalise(whole, f"file://{tmp_path}/members").collect()
    assert sum(r.records for r in members) == 40
    for r in members:
        path = r.path.removeprefix("file://")
        data = open(path, "rb").read()
        assert gzip.decompress(data).count(b"WARC/1.1") == r.records
        assert len(open(path + ".index").read().splitlines()) == r.records


def test_cut_archives_fail():
    data = gzip.compress(warc.record("response", 1, "u", b"x" * 500, 500, "d"))
    import io

    assert len(list(warc.split_records(warc.inflate(io.BytesIO(data), 7)))) == 1
    with pytest.raises(ValueError):
        list(warc.split_records(warc.inflate(io.BytesIO(data[:-20]), 7)))


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    out = quality.score(spark.read.parquet(f"{folder}/documents.parquet"), labels).toPandas()
    assert out["score"].between(0, 1).all() and out["doc_id"].is_unique
    assert (out["held_out"] == out["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert (out["predicted"] == (out["score"] >= 0.3)).all()
    held = out[out["held_out"]].merge(labels.toPandas(), on="doc_id")
    good, bad = held[held["quality"] == 1]["score"], held[held["quality"] == 0]["score"]
    assert len(bad) > 3 and np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.97
    assert (good >= 0.3).mean() > 0.97 and (bad < 0.3).mean() > 0.8


def test_quality_of_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(9, 1), (9, 0), (17, 0), (None, 1), (41, None), (44, 1), (45, 0)], "doc_id long, quality int")
    out = quality.score(odd, labels).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out for r in out if r.doc_id is None)
    no_labels = quality.score(odd, labels.limit(0)).collect()
    assert {round(r.score, 2) for r in no_labels} == {0.5}
    assert quality.score(none, labels).count() == 0
    kept = quality.accepted(odd, labels)
    assert kept.columns == odd.columns
    want = Counter(r.doc_id for r in out if r.predicted)
    assert Counter(r.doc_id for r in kept.collect()) == want


def test_isotonic_pools_violators():
    knots, levels = quality.isotonic(np.array([0.0, 1, 2, 3]), np.array([1, 1, 1, 1]), np.array([0.0, 1, 0, 1]))
    assert levels.tolist() == [0, 0.5, 1] and knots.tolist() == [0, 1.5, 3]


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0
    texts = corpus_pipeline.without_copies(spark, spark.read.parquet(f"{small}/documents.parquet"), small)
    bodies = [r.text.lower() for r in texts.collect()]
    assert len(bodies) == len(set(bodies))
    pieces = corpus_pipeline.run(spark, small)
    assert pieces.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert pieces.count() > 0


def test_stages_take_odd_and_empty_documents(spark, small, odd, none):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, none):
            out = stage(spark, docs, small)
            rows = out.collect()
            assert rows or docs is none, name
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns, name
