"""Groups and regions of the Jaccard join: one rule for all sizes, linear work on members that never link."""

import time

import numpy as np
import pytest

from panelweave.llm import jaccard


@pytest.mark.parametrize("largest", [3, 40, 300])
def test_viable_entries_equal_all_pairs(largest):
    rng = np.random.default_rng(largest)
    group = np.sort(np.concatenate([np.full(rng.integers(1, largest), i) for i in range(25)]))
    sizes = rng.choice([1, 5, 6, 60, 80, 5000], len(group)) + rng.integers(0, 3, len(group))
    rests = np.maximum(1, (sizes * rng.random(len(group))).astype(np.int64) + 1)
    got = jaccard._viable(group, sizes, rests, 75)
    for i in range(len(group)):
        others = np.flatnonzero(group == group[i])
        others = others[others != i]
        assert got[i] == (175 * np.minimum(rests[i], rests[others]) >= 75 * (sizes[i] + sizes[others])).any()
    assert jaccard._viable(group[:0], sizes[:0], rests[:0], 75).tolist() == []


def test_region_links_join_what_all_pairs_join():
    rng = np.random.default_rng(1)
    base = [np.sort(rng.integers(0, 1 << 60, 40).astype(np.uint64)) for _ in range(12)]
    sets = [np.unique(np.concatenate([rng.permutation(base[rng.integers(12)])[:rng.integers(30, 41)], rng.integers(0, 1 << 60, rng.integers(0, 6)).astype(np.uint64)])) for _ in range(150)]
    region = jaccard.Region([s.tobytes() for s in sets])

    def classes(links):
        root = list(range(len(sets)))
        for a, b in links:
            ra, rb = root[a], root[b]
            root = [ra if r == rb else r for r in root]
        return {frozenset(i for i, r in enumerate(root) if r == c) for c in set(root)}

    pairs = []
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                pairs.append((i, j))
    found = jaccard.join_region(region, 75)
    assert classes(found) == classes(pairs) and len(found) == len(sets) - len(classes(pairs))


def test_documents_of_a_template_that_never_link_stay_cheap(spark):
    """Ten words of which one differs: five of six shingles shared, below three quarters."""
    seconds = []
    for count in (2_000, 16_000):
        df = spark.range(count).selectExpr("id AS doc_id", "concat('v', id, ' the order was sent to you on that day') AS text").repartition(8)
        started = time.perf_counter()
        out = jaccard.near_duplicates(df)
        assert out.where("component_id <> doc_id OR n_shingles <> 6").count() == 0 and out.count() == count
        seconds.append(time.perf_counter() - started)
    assert seconds[1] < 5 * seconds[0] + 5
