"""Whitening of embeddings by incremental eigendecomposition.

1. Entries become whole numbers; the distinct vectors are the fit list, written to the checkpoint folder. Its
   size and sums per dimension are exact.
2. Every partition turns its centred vectors, one by one, into rank-one updates of a spectrum: the new
   eigenvalues are the roots of the secular equation, found between the old ones; directions that the vector
   does not touch, and all but one of equal eigenvalues, are deflated and stay.
3. Spectra are combined the same way, as rank-one updates by the other's scaled eigenvectors, first those of
   some partitions, then those of all. A spectrum has dimension * (dimension + 1) numbers, whatever it has seen.
4. A Rayleigh-Ritz step refines the basis: partitions sum the products of the vectors projected on it, and the
   small matrix is diagonalised. This takes off what rounding has added over many updates.

A vector costs a rank-one update, dimension cubed; nothing grows with the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import add_arrays, array_chunks, pick, shuffle_partitions
from panelweave.session import durable

SCALE = 64
COMPONENTS = 16
MOST_LENGTHS = 64  # different vector lengths; each is a space with a fit of its own
_EPS = np.finfo(float).eps
_SPECTRUM = "values binary, basis binary"


class Whitening(NamedTuple):
    """The fit of one vector length. ``sums`` are of the scaled entries without the shift."""

    length: int
    n: int
    sums: np.ndarray
    values: np.ndarray  # eigenvalues of the leading components, falling
    components: np.ndarray  # a column each
    explained: np.ndarray
    identity_error: float


# ---- rank-one updates -------------------------------------------------------

def secular_roots(poles: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(squares / (poles - x)) for rising poles and positive squares: one behind each pole.

    Returned as the nearest pole's distance matrix: (roots, poles[i] - roots[j]), so that differences keep their
    digits. Every step fits one pole on either side of the root with the slopes of the two halves of the sum, and
    falls back to halving the interval.
    """
    size = len(poles)
    total = squares.sum()
    beyond = np.append(poles[1:], poles[-1] + total)  # the last root is at most that far out
    index = np.arange(size)
    lower = np.tri(size, dtype=bool).T  # [i, j]: pole i is at or before root j
    middle = (poles + beyond) / 2
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        above = 1 + (squares[:, None] / (poles[:, None] - middle)).sum(0) >= 0  # the root is in the nearer half
        above[-1] = True
        origin = np.where(above, poles, beyond)
        gaps = poles[:, None] - origin
        left, right = poles - origin, beyond - origin
        right[-1] = 2 * total  # no pole there: a place well beyond the root
        low, high = np.where(above, 0.0, (left - right) / 2), np.where(above, (right - left) / 2, 0.0)
        high[-1] = total * (1 + 4 * _EPS)
        x, settled = (low + high) / 2, np.zeros(size, bool)
        for _ in range(80):
            distance = gaps - x
            terms = squares[:, None] / distance
            value = 1 + terms.sum(0)
            settled |= np.abs(value) <= 2 * _EPS * (1 + np.abs(terms).sum(0))
            if settled.all():
                break
            slopes = terms / distance
            before = np.where(lower, slopes, 0).sum(0)
            after = slopes.sum(0) - before
            low, high = np.where(value < 0, x, low), np.where(value > 0, x, high)
            a, b = left - x, right - x
            c = value - a * before - b * after
            linear, constant = c * (a + b) + before * a * a + after * b * b, a * b * value
            root = np.sqrt(np.abs(linear * linear - 4 * constant * c))
            move = np.where(linear <= 0, (linear - root) / (2 * c), 2 * constant / (linear + root))
            settled |= np.abs(move) <= _EPS * np.abs(x)
            new = x + move
            new = np.where((new > low) & (new < high), new, (low + high) / 2)
            settled |= (new == low) | (new == high)  # the interval cannot be halved any more
            x = np.where(settled, x, new)
    return origin + x, gaps - x


def rank_one(values: np.ndarray, basis: np.ndarray, vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum (rising eigenvalues, orthonormal columns) of ``basis diag(values) basis' + vector vector'``."""
    z = vector @ basis
    total = z @ z
    if total == 0:
        return values, basis
    tolerance = _EPS * max(values[-1], total)
    # equal eigenvalues: turn their directions so that only the last of each group meets the vector
    equal = np.diff(values) <= tolerance
    if equal.any():
        basis, z = basis.copy(), z.copy()
        edges = np.flatnonzero(np.concatenate([[True], ~equal, [True]]))
        for first, stop in zip(edges[:-1], edges[1:]):
            part = z[first:stop]
            norm = np.sqrt(part @ part)
            if stop - first > 1 and norm > 0:
                mirror, signed = part.copy(), norm if part[-1] >= 0 else -norm
                mirror[-1] += signed
                mirror /= np.sqrt(mirror @ mirror)
                own = basis[:, first:stop]
                basis[:, first:stop] = own - 2 * np.outer(own @ mirror, mirror)
                z[first:stop] = 0
                z[stop - 1] = -signed
    active = np.flatnonzero(np.abs(z) * np.sqrt(total) > tolerance)
    if not len(active):
        return values, basis
    poles, squares = values[active], z[active] ** 2
    roots, differences = secular_roots(poles, squares)
    # the vector for which these roots are exact, so that the new directions are orthogonal
    size = len(active)
    exact = -differences[:, -1]
    if size > 1:
        between = poles[None, :] - poles[:, None]  # [i, j]
        following = np.where(np.arange(size)[:, None] > np.arange(size - 1), between[:, :-1], between[:, 1:])
        exact = exact * np.prod(-differences[:, :-1] / following, axis=1)
    weights = np.sqrt(np.abs(exact)) * np.sign(z[active])
    differences = np.where(differences == 0, -np.finfo(float).tiny, differences)
    turned = weights[:, None] / differences
    turned /= np.sqrt((turned * turned).sum(0))
    values, basis = values.copy(), basis.copy()
    values[active], basis[:, active] = roots, basis[:, active] @ turned
    order = np.argsort(values, kind="stable")
    return values[order], basis[:, order]


def combine(values: np.ndarray, basis: np.ndarray, other_values: np.ndarray, other_basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of the sum of two matrices, by one update for each direction of the other."""
    for value, direction in zip(other_values, other_basis.T):
        if value > 0:
            values, basis = rank_one(values, basis, np.sqrt(value) * direction)
    return values, basis


# ---- passes over the fit list -----------------------------------------------

def _matrix(batch: pa.RecordBatch, length: int, name: str = "x") -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Vectors less their mean. The difference is taken in whole numbers times ``n``."""
    if n * int(np.abs(x).max(initial=0)) < 1 << 62:
        return (n * x - sums.astype(np.int64)) / n
    return ((x.astype(object) * n - sums) / n).astype(float)


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each length that a task meets: number of vectors and sums, at most some ``MOST_LENGTHS`` rows."""
    held: dict[int, list] = {}
    for batch in batches:
        column = batch.column("x")
        lengths = column.value_lengths().to_numpy(zero_copy_only=False)
        flat, starts = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])
        for length in np.unique(lengths):
            x = flat[(starts[:-1][lengths == length, None] + np.arange(length)).ravel()].reshape(-1, length)
            n, sums = held.get(int(length), (0, 0))
            small = len(x) * int(np.abs(x).max(initial=0)) < 1 << 62
            held[int(length)] = [n + len(x), sums + (x.sum(0).astype(object) if small else x.astype(object).sum(0))]
    for length, (n, sums) in held.items():
        yield pa.RecordBatch.from_arrays([
            pa.array([length] * (length + 1), pa.int32()), pa.array(range(-1, length), pa.int32()),
            pa.array([int(v) for v in [n, *sums]], pa.decimal128(38, 0))], names=["length", "dimension", "total"])


def _spectrum_batch(values: np.ndarray, basis: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([values.tobytes()], pa.binary()), pa.array([basis.tobytes()], pa.binary())], names=["values", "basis"])


def _updates(length: int, n: int, sums: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, basis, seen = np.zeros(length), np.eye(length), False
        for batch in batches:
            for vector in centred(_matrix(batch, length), n, sums):
                values, basis, seen = *rank_one(values, basis, vector), True
        if seen:
            yield _spectrum_batch(values, np.ascontiguousarray(basis))
    return run


def _combined(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for values, basis in zip(batch.column("values").to_pylist(), batch.column("basis").to_pylist()):
                other = np.frombuffer(values), np.frombuffer(basis).reshape(length, length)
                held = other if held is None else combine(*held, *other)
        if held is not None:
            yield _spectrum_batch(held[0], np.ascontiguousarray(held[1]))
    return run


def _products(length: int, n: int, sums: np.ndarray, onto: np.ndarray):
    """Sums of the projections and of their products."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = onto.shape[1]
        total = np.zeros((width + 1, width))
        for batch in batches:
            seen = centred(_matrix(batch, length), n, sums) @ onto
            total[:width] += seen.T @ seen
            total[width] += seen.sum(0)
        keys, data = array_chunks(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(data, pa.binary())], names=["chunk", "data"])
    return run


def _covariance(rows: DataFrame, length: int, n: int, sums: np.ndarray, onto: np.ndarray) -> np.ndarray:
    """Covariance of the projections of the fit list on the columns of ``onto``."""
    width = onto.shape[1]
    partial = rows.mapInArrow(_products(length, n, sums, onto), "chunk int, data binary")
    total = add_arrays(partial, (width + 1) * width, "float64").reshape(width + 1, width)
    mean = total[width] / n
    return total[:width] / n - np.outer(mean, mean)


def _fit(rows: DataFrame, length: int, n: int, sums: np.ndarray, components: int) -> Whitening | None:
    tasks = shuffle_partitions(rows)
    spectra = rows.mapInArrow(_updates(length, n, sums), _SPECTRUM)
    some = max(1, int(tasks ** 0.5))
    for parts in (some, 1):  # first the spectra of some partitions, then those of all
        spectra = (spectra.withColumn("some", F.pmod(F.spark_partition_id(), F.lit(parts))).repartition(parts, "some")
                   .select("values", "basis").mapInArrow(_combined(length), _SPECTRUM))
    basis = np.frombuffer(spectra.first().basis).reshape(length, length)  # one spectrum
    basis = np.linalg.qr(basis)[0]
    small = _covariance(rows, length, n, sums, basis)
    values, turned = np.linalg.eigh((small + small.T) / 2)
    trace, order = values.sum(), np.argsort(-values, kind="stable")
    order = order[values[order] > length * _EPS * max(values.max(), 0)][:components]
    if not len(order):
        return None
    values, kept = values[order], basis @ turned[:, order]
    whitened = _covariance(rows, length, n, sums, kept / np.sqrt(values))
    return Whitening(length, n, sums, values, kept, values / trace, float(np.abs(whitened - np.eye(len(values))).max()))


# ---- the operator -----------------------------------------------------------

def whole_entries(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, x) of vectors with finite entries only; x is floor(scale * entry), without the shift."""
    entries = F.transform("vector", lambda e: e.cast("double"))
    finite = F.forall("vector", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))))
    whole = F.when(F.forall("vector", lambda e: F.abs(e * scale) < F.lit(2.0 ** 53)), F.transform("vector", lambda e: F.floor(e * scale))).otherwise(
        F.raise_error(F.lit("an entry is too large to be a whole number")))
    return (pick(vectors, vec_id=id_col, vector=vector_col).withColumn("vector", entries)
            .where(F.col("vector").isNotNull() & finite & (F.size("vector") > 0)).select("vec_id", whole.alias("x")))


def fit(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """Fits by vector length over the distinct vectors ``x`` of ``rows``; a length without variance has none."""
    distinct = durable(rows.select("x").distinct())
    totals = durable(distinct.mapInArrow(_sum_up, "length int, dimension int, total decimal(38,0)")
                     .groupBy("length", "dimension").agg(F.sum("total").cast("decimal(38,0)").alias("total")))
    counts = totals.where("dimension = -1").limit(MOST_LENGTHS + 1).collect()
    if len(counts) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} different lengths")
    found = {}
    for row in counts:
        sums = totals.where((F.col("length") == row.length) & (F.col("dimension") >= 0)).orderBy("dimension").collect()  # one per dimension
        one = _fit(distinct.where(F.size("x") == row.length), row.length, int(row.total), np.array([int(r.total) for r in sums], object), components)
        if one:
            found[row.length] = one
    return found


def apply(rows: DataFrame, fits: dict[int, Whitening]) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    id_type = rows.schema["vec_id"].dataType.simpleString()

    def deviations(x: np.ndarray, one: Whitening) -> list[int]:
        # sums are at most n times the largest entry of the fit list; the bound covers both
        largest = one.n * int(np.abs(x).max()) + max(abs(int(s)) for s in one.sums)
        if largest ** 2 * one.length < 1 << 62:
            return ((one.n * x - one.sums.astype(np.int64)) ** 2).sum(1).tolist()
        return [int(v) for v in ((x.astype(object) * one.n - one.sums) ** 2).sum(1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("x").value_lengths().to_numpy(zero_copy_only=False)
            for length, one in fits.items():
                own = batch.take(pa.array(np.flatnonzero(lengths == length)))
                if not own.num_rows:
                    continue
                x, width = _matrix(own, length), len(one.values)
                whitened = centred(x, one.n, one.sums) @ one.components / np.sqrt(one.values)
                place = np.repeat(np.arange(len(x)), width)
                count = len(place)
                yield pa.RecordBatch.from_arrays([
                    own.column("vec_id").take(pa.array(place)), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(count, one.n, np.int64)), pa.array(deviations(x, one), pa.decimal128(38, 0)).take(pa.array(place)),
                    pa.array(whitened.ravel()), pa.array(np.tile(one.explained, len(x))), pa.array(np.full(count, one.identity_error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, f"vec_id {id_type}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Vectors on their leading principal components, with unit variance over the distinct vectors.

    Entry c counts as floor(scale * c), plus a constant that cancels. Vectors that are null, empty or hold null or
    non-finite entries drop; an entry beyond 2**53 / scale raises an error. The fit takes each distinct vector once,
    the result has every remaining row, also repeated ones and null ids. Vectors of different lengths are
    different spaces with a fit each (at most ``MOST_LENGTHS``). Components without variance give no rows, so neither
    does a single distinct vector or an empty table. ``deviation`` is the sum over dimensions of (n * x - sum)**2, exact.
    Extra columns do not matter.
    """
    rows = whole_entries(vectors, id_col, vector_col, scale)
    return apply(rows, fit(rows, components))
