"""Whitening against a direct decomposition of the exact covariance."""

import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from panelweave.llm import queries, whitening

FORM = "vec_id long, embedding array<double>, component int, n int, x int, `a.b` int"


def direct(vectors, count, scale=64):
    """n, sums, eigenvalues and eigenvectors over the distinct whole vectors, the covariance summed in fractions."""
    fit = sorted({tuple(math.floor(scale * c) + 1_000_000 for c in v) for v in vectors})
    n, sums = len(fit), [sum(x) for x in zip(*fit)]
    shifted = np.array([[n * x - s for x, s in zip(v, sums)] for v in fit], object)
    exact = shifted.T @ shifted
    cov = np.array([[float(Fraction(int(v), n ** 3)) for v in row] for row in exact])
    values, columns = np.linalg.eigh(cov)
    order = np.argsort(-values)
    order = order[values[order] > 1e-12 * values.max()][:count] if values.max() > 0 else order[:0]
    return n, sums, values[order], columns[:, order], values.sum()


def expect(rows, got, count=16):
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    want = Counter()
    for length in {len(v) for _, v in good}:
        own = [(i, v) for i, v in good if len(v) == length]
        n, sums, values, columns, trace = direct([v for _, v in own], count)
        mine = [r for r in got if r.n == n]
        for i, v in own:
            x = [math.floor(64 * c) + 1_000_000 for c in v]
            deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
            projected = np.array([a - s / n for a, s in zip(x, sums)]) @ columns / np.sqrt(values)
            want.update((i, k + 1, n, deviation, round(abs(p), 6), round(e / trace, 8)) for k, (p, e) in enumerate(zip(projected, values)))
        errors = {r.identity_error for r in mine}
        assert len(errors) == (1 if len(values) else 0) and all(e <= 1e-10 for e in errors)
    assert Counter((r.vec_id, r.component, r.n, int(r.deviation), round(abs(r.whitened), 6), round(r.explained, 8)) for r in got) == want


def random_rows(seed, count, width, first=0):
    rng = np.random.default_rng(seed)
    return [(first + i, [float(c) for c in rng.normal(size=width) * np.linspace(0.3, 2, width) + 5]) for i in range(count)]


def frame(spark, rows, parts):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], FORM).repartition(parts)


@pytest.mark.parametrize("width,count,parts", [(20, 300, 7), (3, 50, 1), (18, 9, 4), (24, 400, 40)])
def test_components_and_rows(spark, width, count, parts):
    rows = random_rows(width, count, width)
    rows += [(900 + i, rows[0][1]) for i in range(200)]  # one hot vector
    rows += [(1, rows[1][1]), (None, rows[2][1]), (None, None), (5, None), (6, []), (7, [1.0, None] * (width // 2)), (8, [math.nan] * width),
             (9, [math.inf] + [0.0] * (width - 1))]
    got = whitening.whiten(frame(spark, rows, parts)).collect()
    expect(rows, got)


def test_lengths_apart_and_no_variance(spark, none):
    rows = random_rows(1, 60, 5) + random_rows(2, 45, 4, 1000) + [(2000, [1.0, 2.0]), (2001, [1.0, 2.0])]
    got = whitening.whiten(frame(spark, rows, 6)).collect()
    expect(rows, got)
    assert {r.n for r in got} == {60, 45}
    assert whitening.whiten(frame(spark, rows[:0], 2)).count() == 0
    assert whitening.whiten(frame(spark, rows[-2:], 2)).count() == 0
    flat = [(i, [float(i), 1.0, 2.0]) for i in range(30)]  # two dimensions without variance
    assert {r.component for r in whitening.whiten(frame(spark, flat, 3)).collect()} == {1}
    assert {r.component for r in whitening.whiten(frame(spark, random_rows(1, 60, 5), 3), components=2).collect()} == {1, 2}


def test_large_entries_stay_exact(spark):
    rows = [(i, [1e9 + i * 3.5e7, -2e8 * (i % 7)]) for i in range(50)]
    expect(rows, whitening.whiten(frame(spark, rows, 3)).collect())
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(frame(spark, [(1, [1e300]), (2, [0.0])], 1)).collect()


def test_given_table(spark, small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    got = queries.QUERIES["op11_whitening"](spark, small)
    assert dict(got.dtypes)["deviation"] == "bigint"
    expect(rows, got.collect())


def spectra():
    rng = np.random.default_rng(0)
    for size in (1, 2, 5, 40):
        turn = np.linalg.qr(rng.normal(size=(size, size)))[0]
        some, v = np.sort(rng.random(size)), rng.normal(size=size)
        for values in (some, np.zeros(size), np.full(size, 3.0), np.sort(np.repeat(some, 2)[:size]), np.sort(10.0 ** -np.arange(size)),
                       np.sort(1 + 1e-14 * rng.random(size))):
            for vector in (v, turn[:, 0] * 2, turn @ (10.0 ** -np.arange(size)), v * 1e-9, v * 1e9, v * 0):
                yield values, turn, vector


def test_rank_one_updates():
    for values, turn, vector in spectra():
        matrix = turn @ np.diag(values) @ turn.T + np.outer(vector, vector)
        new, basis = whitening.rank_one(values, turn, vector)
        scale = max(np.abs(matrix).max(), 1e-300)
        assert np.abs(basis @ np.diag(new) @ basis.T - matrix).max() <= 1e-13 * scale
        assert np.abs(basis.T @ basis - np.eye(len(values))).max() <= 1e-13
        assert (np.diff(new) >= 0).all()
        # roots lie between the old values
        assert (new >= values - 1e-13 * scale).all() and (new[:-1] <= values[1:] + 1e-13 * scale).all()


def test_updates_add_up():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 12)) * np.linspace(0.01, 4, 12)
    whole = np.zeros(12), np.eye(12)
    halves = []
    for part in (x[:200], x[200:]):
        held = np.zeros(12), np.eye(12)
        for v in part:
            held, whole = whitening.rank_one(*held, v), whitening.rank_one(*whole, v)
        halves.append(held)
    both = whitening.combine(*halves[0], *halves[1])
    for values, basis in (whole, both):
        assert np.allclose(basis @ np.diag(values) @ basis.T, x.T @ x, atol=1e-9)
