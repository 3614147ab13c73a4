"""Smoothing: parameters against a grid search, means and spreads against direct solves."""

import itertools

import numpy as np
import pytest

from panelweave.operators import panel as pn
from panelweave.operators import smoothing as sm

YEARS = np.arange(2013, 2020)


def gram(a, b, constant, scale):
    d = np.sqrt(3) * np.abs(np.subtract.outer(np.asarray(a, float), np.asarray(b, float))) / scale
    return constant + (1 + d) * np.exp(-d)


def likelihood(x, y, constant, scale, noise):
    k = gram(x, x, constant, scale) + noise * np.eye(len(x))
    return -0.5 * (y @ np.linalg.solve(k, y) + np.linalg.slogdet(k)[1] + len(x) * np.log(2 * np.pi))


def sample_series(seed, count):
    rng = np.random.default_rng(seed)
    level, slope = rng.normal(scale=3, size=(count, 1)), rng.normal(size=(count, 1))
    noise = rng.choice([0.01, 0.3, 2.0, 20.0], size=(count, 1))
    return level + slope * (YEARS - 2016) * rng.choice([0, 0.2, 1], size=(count, 1)) + noise * rng.normal(size=(count, len(YEARS)))


@pytest.mark.parametrize("known,seed", [([0, 1, 2, 3, 4, 5, 6], 7), ([0, 1, 2, 3, 4, 5, 6], 21), ([0, 3, 4], 3), ([0, 1, 2, 4, 6], 22), ([2, 6], 2), ([5], 1)])
def test_likelihood_is_not_below_a_fine_grid(known, seed):
    x, values = YEARS[known], sample_series(seed, 40)[:, known]
    distances = np.abs(np.subtract.outer(x, x)).astype(float)
    found = sm.fit_parameters(distances, values)
    assert (found >= sm.LOWER).all() and (found <= sm.UPPER).all()
    fine = np.array(list(itertools.product(np.linspace(sm.LOWER, sm.UPPER, 47), np.linspace(np.log(0.1), np.log(100), 41), np.linspace(sm.LOWER, sm.UPPER, 47))))
    inverses, logs = sm._inverses(sm._matrices(fine, distances))
    for parameters, y in zip(found, values):
        best = (-0.5 * (np.einsum("i,gij,j->g", y, inverses, y) + logs + len(x) * np.log(2 * np.pi))).max()
        reached = likelihood(x, y, *np.exp(parameters))
        assert reached >= best - 1e-6
        assert reached == pytest.approx(sm.log_likelihood(parameters[None], distances, y[None])[0], abs=1e-6)


def test_slopes_equal_differences():
    rng, x = np.random.default_rng(0), YEARS[[0, 1, 4, 6]]
    distances, values = np.abs(np.subtract.outer(x, x)).astype(float), rng.normal(size=(5, 4)) * 3
    at = rng.normal(size=(5, 3))
    gradient, curvature = sm._slopes(at, distances, values)
    for p in range(3):
        move = np.eye(3)[p] * 1e-5
        slope = (sm.log_likelihood(at + move, distances, values) - sm.log_likelihood(at - move, distances, values)) / 2e-5
        assert gradient[:, p] == pytest.approx(slope, rel=1e-5, abs=1e-7)
    assert np.linalg.eigvalsh(curvature).min() > -1e-12


def test_fitted_gap_fill(spark):
    grid = sample_series(3, 30)
    rng = np.random.default_rng(9)
    rows = [(f"s{i}", int(y), float(v)) for i, line in enumerate(grid) for y, v in zip(YEARS, line) if rng.random() < 0.6]
    rows += [("full", int(y), float(y)) for y in YEARS] + [("one", 2015, 4.0), ("none", 2014, None), ("flat", 2013, 2.0), ("flat", 2019, 2.0)]
    df = spark.createDataFrame(rows, "series string, year int, value double")
    got = {}
    for r in pn.gap_fill(df, "series", "year", "value", YEARS.tolist(), "fitted").collect():
        got.setdefault(r.series, {})[r.year] = r
    seen = {}
    for s, y, v in rows:
        seen.setdefault(s, {}).update({y: v} if v is not None else {})
    assert set(got) == set(seen)
    for s, points in seen.items():
        assert sorted(got[s]) == YEARS.tolist()
        x, y = np.array(sorted(points), int), np.array([points[k] for k in sorted(points)])
        if not len(x):
            assert all(r.value is None and r.sd is None and r.imputed for r in got[s].values())
            continue
        constant, scale, noise = np.exp(sm.fit_parameters(np.abs(np.subtract.outer(x, x)).astype(float), y[None])[0])
        k, cross = gram(x, x, constant, scale) + noise * np.eye(len(x)), gram(YEARS, x, constant, scale)
        mean = cross @ np.linalg.solve(k, y)
        sd = np.sqrt(np.maximum(constant + 1 + noise - np.einsum("ij,ji->i", cross, np.linalg.solve(k, cross.T)), 0))
        for year, m, e in zip(YEARS.tolist(), mean, sd):
            r = got[s][year]
            assert r.imputed == (year not in points)
            if r.imputed:
                # a batch of other series rounds differently, which flat likelihoods carry into the parameters
                assert r.value == pytest.approx(m, rel=1e-4, abs=1e-4) and r.sd == pytest.approx(e, rel=1e-2, abs=1e-4)
            else:
                assert r.value == points[year] and r.sd is None
    assert pn.gap_fill(df.limit(0), "series", "year", "value", YEARS.tolist(), "fitted").count() == 0
    with pytest.raises(ValueError):
        pn.gap_fill(df, "series", "year", "value", YEARS.tolist(), "other")


def test_prefixes_of_one_factor_equal_direct_solves():
    rng = np.random.default_rng(4)
    grid = rng.normal(size=(400, len(YEARS))) * 100 + 1e4
    grid[rng.random(grid.shape) < 0.25] = np.nan
    grid[:, 0] = np.where(np.isnan(grid[:, 0]), 5.0, grid[:, 0])
    lengths = rng.integers(1, len(YEARS), size=400)
    got = sm.prefix_means(YEARS, grid, lengths)
    for line, length, found in zip(grid, lengths, got):
        known = (np.arange(len(YEARS)) < length) & ~np.isnan(line)
        want = sm.posterior_mean(YEARS, known, line[None, known])[0]
        assert found == pytest.approx(want, rel=1e-9, abs=1e-9)
