"""The classifier against direct solves, and the rows of the whole pipeline against a chain of brute-force stages."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from panelweave.llm import quality

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def split_words(text):
    return [w for w in re.split("[ \t\n\x0b\x0c\r]+", text or "") if w]


# the classifier

def fold_of(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


def ridge_by_stacked_rows(z, y, ridge):
    """Least squares over the rows and one more row per penalised weight, without normal equations."""
    weights = np.sqrt([1e-6, *[ridge] * (z.shape[1] - 1)])
    return np.linalg.lstsq(np.vstack([z, np.diag(weights)]), np.concatenate([y, np.zeros(len(weights))]), rcond=None)[0]


def isotonic_by_min_max(points):
    """Blocks of the monotone fit: level i is the largest over starts a <= i of the smallest mean of a..b, b >= i."""
    mean = {(a, b): Fraction(sum(y for _, _, y in points[a:b + 1]), sum(n for _, n, _ in points[a:b + 1]))
            for a in range(len(points)) for b in range(a, len(points))}
    levels = [max(min(mean[a, b] for b in range(i, len(points))) for a in range(i + 1)) for i in range(len(points))]
    blocks = defaultdict(list)
    for (x, n, _), level in zip(points, levels):
        blocks[level].append((x, n))
    return [(sum(x * n for x, n in blocks[k]) / sum(n for _, n in blocks[k]), float(k)) for k in sorted(blocks)]


def test_classifier_equals_direct_solves(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    model = quality.train(quality.vectors(docs.repartition(5)), labels.repartition(3))
    x = {r.doc_id: quality.statistics((r.text or "").encode()) for r in docs.collect()}
    table = np.array(list(x.values()))
    scale = np.where(table.std(axis=0) == 0, 1, table.std(axis=0))
    assert np.allclose(model.mean, table.mean(axis=0)) and np.allclose(model.scale, scale)

    truth = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and r.doc_id in x and fold_of(r.doc_id)}
    ids = sorted(truth)
    z = quality.fourier(np.array([x[i] for i in ids]), table.mean(axis=0), scale, quality.FEATURES)
    y, folds = np.array([float(truth[i]) for i in ids]), np.array([fold_of(i) for i in ids])
    assert np.allclose(model.weights, ridge_by_stacked_rows(z, y, quality.RIDGE), atol=1e-7)

    unseen = np.zeros(len(ids))
    for k in range(1, quality.FOLDS):
        unseen[folds == k] = z[folds == k] @ ridge_by_stacked_rows(z[folds != k], y[folds != k], quality.RIDGE)
    steps = defaultdict(list)
    for raw, label in zip(unseen, y):
        steps[int(np.rint(raw * quality.STEPS))].append(int(label))
    want = isotonic_by_min_max([(s, len(steps[s]), sum(steps[s])) for s in sorted(steps)])
    assert np.allclose(model.knots, [s / quality.STEPS for s, _ in want], atol=1e-4)
    assert np.allclose(model.levels, [level for _, level in want])


# the chain

def one_of_each_text(rows):
    last = {}
    for r in rows:
        last[lowered(r.text)] = max(r.doc_id, last.get(lowered(r.text), r.doc_id))
    return [r for r in rows if last[lowered(r.text)] == r.doc_id]


def shingle_set(text):
    words = split_words(lowered(text))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def one_of_each_class(rows):
    sets = {r.doc_id: shingle_set(r.text) for r in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [r for r in rows if top(r.doc_id) == r.doc_id]


def copies_taken(rows):
    own = defaultdict(list)
    for r in rows:
        own[r.source].append(r)
    size = {s: sum(len(split_words(r.text)) for r in own[s]) for s in own}
    order = sorted(own, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    open_ = set(order)
    while True:
        left = sum(size.values()) - sum(3 * size[s] for s in order if s not in open_)
        target = {s: left * weight[s] / sum(weight[x] for x in open_) if s in open_ else 3.0 * size[s] for s in order}
        above = {s for s in open_ if target[s] > 3 * size[s]}
        if not above:
            break
        open_ -= above
    copies = Counter()
    for s in order:
        if not size[s]:
            continue
        whole = int(target[s] // size[s])
        budget, below, over = target[s] - whole * size[s], 0, False
        for r in sorted(own[s], key=lambda r: int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16)):
            n = len(split_words(r.text))
            takes = not over
            if not over and below + n > budget:  # the document at the boundary
                over, takes = True, below + n - budget <= budget - below
            below += n
            copies[r.doc_id] = whole + (takes and whole < 3)
    return +copies


@pytest.fixture(scope="module")
def planted(spark, small, tmp_path_factory):
    """The small tables with copies that differ in case, near copies of them, and texts without words."""
    folder = str(tmp_path_factory.mktemp("planted"))
    docs = spark.read.parquet(f"{small}/documents.parquet")
    shouted = docs.where("doc_id % 9 = 0").withColumns({"doc_id": F.col("doc_id") + 100_000, "text": F.translate("text", LOWER, UPPER)})
    tailed = docs.where("doc_id % 7 = 0").withColumns({"doc_id": F.col("doc_id") + 200_000, "text": F.concat("text", F.lit(" one more tail"))})
    bare = docs.where("doc_id % 50 = 0").withColumns({"doc_id": F.col("doc_id") + 300_000, "text": F.when(F.col("doc_id") % 100 == 0, F.lit(" \n"))})
    docs.unionByName(shouted).unionByName(tailed).unionByName(bare).select(*docs.columns).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{small}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_pipeline_rows_equal_a_chain_by_brute_force(spark, planted):
    docs, labels = spark.read.parquet(f"{planted}/documents.parquet"), spark.read.parquet(f"{planted}/labels.parquet")
    good = {r.doc_id for r in quality.score(docs, labels).collect() if r.predicted}
    accepted = [r for r in docs.collect() if r.doc_id in good]
    single = one_of_each_text(accepted)
    apart = one_of_each_class(single)
    copies = copies_taken(apart)
    assert docs.count() > len(accepted) > len(single) > len(apart) and set(copies.values()) > {1}

    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r.doc_id: np.array([*bpe.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in apart}
    covered, sequences = defaultdict(Counter), defaultdict(list)
    for r in corpus_pipeline.run(spark, planted).collect():
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and 0 < r.length <= len(own) - r.start
        assert r.ids_crc32 == zlib.crc32(own[r.start:r.start + r.length].tobytes())
        covered[r.doc_id].update(range(r.start, r.start + r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert covered == {i: Counter(dict.fromkeys(range(len(ids[i])), n)) for i, n in copies.items()}
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048
