"""Gaussian-process smoothing of many short series at once: constant + Matérn 3/2 + white noise.

Series with the same known years share their distances, so one factorisation, or one stack of them, serves all. These
functions run inside Arrow batches and hold a batch's series at most.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

# fixed values of the smoothing kernel, and the start of its fit
CONSTANT, LENGTH_SCALE, NOISE = 1.0, 2.0, 1.0
# fixed values: bounds of the three parameters, as natural logarithms of 1e-5 and 1e5
LOWER, UPPER = float(np.log(1e-5)), float(np.log(1e5))
GRID = (16, 14, 16)  # points per parameter where the fit looks for starts
BLOCKS = (3, 4)  # of constant by length scale; the best point of each block is a start
STEPS = 120
_MEMBERS = 2048  # series that are fitted together


def matern(distances: np.ndarray, length_scale: np.ndarray | float) -> np.ndarray:
    d = np.sqrt(3.0) * distances / length_scale
    return (1.0 + d) * np.exp(-d)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.abs(np.subtract.outer(a.astype(float), b.astype(float)))


def fixed_kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return CONSTANT + matern(_distances(a, b), LENGTH_SCALE)


def posterior_mean(years: np.ndarray, known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Smoothed values at all years given the known positions, with the fixed kernel; rows of ``values`` are series,
    which are centred."""
    x = years[known]
    weights = np.linalg.solve(fixed_kernel(x, x) + NOISE * np.eye(len(x)), fixed_kernel(x, years))
    weights += (1.0 - weights.sum(axis=0)) / len(x)  # the mean takes what the weights leave
    # summed year by year: a product of matrices rounds differently from batch to batch
    return sum(values[:, i, None] * weights[i] for i in range(len(x)))


def prefix_means(years: np.ndarray, grid: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """As :func:`posterior_mean` for the first ``lengths`` years of each series (at least one known), whatever they are.

    One Cholesky factor of all years serves every prefix, as a leading block of it is the factor of that prefix. A gap
    inside a prefix is closed by the value that gets no weight, a solve of the gap's size.
    """
    size = len(years)
    factor = np.linalg.inv(np.linalg.cholesky(fixed_kernel(years, years) + NOISE * np.eye(size)))
    onto = fixed_kernel(years, years) @ factor.T
    inside = np.arange(size) < lengths[:, None]
    known = inside & ~np.isnan(grid)
    values = np.where(known, grid, 0.0)
    centre = values.sum(axis=1, keepdims=True) / known.sum(axis=1, keepdims=True)
    values = np.where(known, grid - centre, 0.0)
    gaps = inside & ~known
    holed = np.flatnonzero(gaps.any(axis=1))
    if len(holed):
        patterns, which = np.unique(np.column_stack([lengths[holed], gaps[holed]]), axis=0, return_inverse=True)
        for i, pattern in enumerate(patterns):
            own, lost = holed[which.ravel() == i], np.flatnonzero(pattern[1:])
            block = factor[:pattern[0], :pattern[0]]
            inverse = block.T @ block  # of the prefix's matrix
            pull = values[own][:, :pattern[0]] @ inverse[:, lost]
            values[np.ix_(own, lost)] = -np.linalg.solve(inverse[np.ix_(lost, lost)], pull.T).T
    return (values @ factor.T * inside) @ onto.T + centre


# ---- parameters by marginal likelihood --------------------------------------

def _matrices(parameters: np.ndarray, distances: np.ndarray) -> np.ndarray:
    constant, scale, noise = (np.exp(parameters[:, i])[:, None, None] for i in range(3))
    return constant + matern(distances, scale) + noise * np.eye(len(distances))


def _inverses(matrices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    factors = np.linalg.cholesky(matrices)
    logs = 2 * np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(axis=1)
    half = np.linalg.inv(factors)
    return half.transpose(0, 2, 1) @ half, logs


def log_likelihood(parameters: np.ndarray, distances: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Log marginal likelihood of each series under its own parameters (logarithms of constant, length scale, noise)."""
    inverses, logs = _inverses(_matrices(parameters, distances))
    fit = np.einsum("mi,mij,mj->m", values, inverses, values)
    return -0.5 * (fit + logs + len(distances) * np.log(2 * np.pi))


def _slopes(parameters: np.ndarray, distances: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and expected curvature of the log likelihood of each series."""
    size = len(distances)
    inverses, _ = _inverses(_matrices(parameters, distances))
    constant, scale, noise = (np.exp(parameters[:, i])[:, None, None] for i in range(3))
    d = np.sqrt(3.0) * distances / scale
    changes = np.stack([constant * np.ones((size, size)), d * d * np.exp(-d), noise * np.eye(size)], axis=1)  # series, parameter, i, j
    weights = np.einsum("mij,mj->mi", inverses, values)
    turned = inverses[:, None] @ changes
    gradient = 0.5 * (np.einsum("mi,mpij,mj->mp", weights, changes, weights) - np.einsum("mpii->mp", turned))
    return gradient, 0.5 * np.einsum("mpij,mqji->mpq", turned, turned)


def _starts(distances: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Starts (series, block, parameter): for each series the best point of each block of a grid. The likelihood
    has several humps, mostly along constant and length scale, so blocks cut these two. The grid's matrices do not
    depend on the series."""
    axes = [np.linspace(LOWER, UPPER, GRID[0]), np.concatenate([np.linspace(np.log(0.2), np.log(60.0), GRID[1] - 1), [UPPER]]), np.linspace(LOWER, UPPER, GRID[2])]
    grid = np.stack(np.meshgrid(*axes, indexing="ij"), axis=-1)
    inverses, logs = _inverses(_matrices(grid.reshape(-1, 3), distances))
    products = (values[:, :, None] * values[:, None, :]).reshape(len(values), -1)
    cost = (products @ inverses.reshape(len(logs), -1).T + logs).reshape(len(values), *GRID)
    points = []
    for rows in np.array_split(np.arange(GRID[0]), BLOCKS[0]):
        for columns in np.array_split(np.arange(GRID[1]), BLOCKS[1]):
            block = cost[:, rows[0]:rows[-1] + 1, columns[0]:columns[-1] + 1].reshape(len(values), -1)
            points.append(grid[rows[0]:rows[-1] + 1, columns[0]:columns[-1] + 1].reshape(-1, 3)[block.argmin(axis=1)])
    return np.array(points).transpose(1, 0, 2)


def fit_parameters(distances: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Logarithms of constant, length scale and noise of largest marginal likelihood, within their bounds, for series
    (rows) with the same known years: damped scoring steps for all series at once, from several starts."""
    starts = _starts(distances, values)
    climbed, reached = _climb(starts.reshape(-1, 3), distances, np.repeat(values, starts.shape[1], axis=0))
    best = reached.reshape(starts.shape[:2]).argmax(axis=1)
    return climbed.reshape(starts.shape)[np.arange(len(values)), best]


def _climb(parameters: np.ndarray, distances: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    reached, damping = log_likelihood(parameters, distances, values), np.full(len(values), 1e-3)
    moving = np.arange(len(values))
    for _ in range(STEPS):
        if not len(moving):
            break
        gradient, curvature = _slopes(parameters[moving], distances, values[moving])
        at = parameters[moving]
        free = ~((at <= LOWER) & (gradient < 0) | (at >= UPPER) & (gradient > 0))
        gradient = np.where(free, gradient, 0.0)
        curvature = np.where(free[:, :, None] & free[:, None, :], curvature, 0.0)
        diagonal = np.einsum("mpp->mp", curvature)
        curvature[:, [0, 1, 2], [0, 1, 2]] += damping[moving, None] * np.maximum(diagonal, 1e-6) + 1e-12 + ~free
        step = np.linalg.solve(curvature, gradient[:, :, None])[:, :, 0]
        new = np.clip(at + np.clip(step, -2, 2), LOWER, UPPER)
        gained = log_likelihood(new, distances, values[moving]) - reached[moving]
        better = gained > 0
        parameters[moving[better]], reached[moving[better]] = new[better], reached[moving[better]] + gained[better]
        damping[moving] = np.where(better, np.maximum(damping[moving] / 5, 1e-9), damping[moving] * 6)
        done = (np.abs(gradient).max(axis=1) < 1e-9) | (damping[moving] > 1e9) | better & (gained < 1e-13 * (1 + np.abs(reached[moving])))
        moving = moving[~done]
    return parameters, reached


def fitted_posterior(years: np.ndarray, known: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and spread (noise included) at all years of series with these known years, each under its own fitted
    parameters. Values are not centred; the constant stands for their level."""
    means, spreads = [], []
    among, towards = _distances(years[known], years[known]), _distances(years, years[known])
    for start in range(0, len(values), _MEMBERS):
        part = values[start:start + _MEMBERS]
        parameters = fit_parameters(among, part)
        constant, scale, noise = (np.exp(parameters[:, i])[:, None, None] for i in range(3))
        cross = constant + matern(towards, scale)
        weights = cross @ _inverses(_matrices(parameters, among))[0]
        means.append(np.einsum("myi,mi->my", weights, part))
        left = (constant + 1.0 + noise)[:, :, 0] - np.einsum("myi,myi->my", weights, cross)
        spreads.append(np.sqrt(np.maximum(left, 0.0)))
    return np.concatenate(means), np.concatenate(spreads)
