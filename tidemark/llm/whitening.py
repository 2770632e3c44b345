"""Whitening of embeddings by an eigendecomposition kept up to date, one centred rank-one update at a time.

A spectrum is a count, sums, and the eigenvalues and vectors of the scatter about the mean. Adding a rank-one term in the basis
of a spectrum leaves a diagonal plus z z'; its eigenvalues are the roots of the secular equation, one between each two old ones, and
its vectors follow from them. Entries of z that vanish, and equal eigenvalues, are deflated first: these pairs stay.

1. Each task reads its part of the distinct vectors in chunks. A chunk, centred, is turned by an orthogonal map into at most as many rows as
   it has dimensions, which have the same scatter; these are its rank-one updates, and one more is the distance of the two means.
2. Spectra are combined eight at a time, the smaller one's pairs added to the other as rank-one updates, until one is left.
3. Rayleigh and Ritz: all vectors are projected once more on the basis found, the covariance of the projections is summed over tasks, and
   its eigenvectors turn the basis. What rounding the updates gathered is gone after that.

Vectors are whole numbers, floor(256 c), so counts and sums are exact. Bounds: a task holds one chunk and a few matrices of dimension x
dimension; so does the driver, whatever the number of rows. Equal vectors collapse before the shuffle.

Defined cases: rows whose vector is null, holds a null, a not-finite entry or one beyond 2**52 / 256 are left out, as are rows
of another dimension than that of most rows (the larger, if equal). Repeated rows come back each, and count once. A component without variance has no whitened
value (null); without any variance nothing is explained (null) either. An empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

SCALE, COMPONENTS, FAN_IN = 256, 4, 8
LARGEST = float(1 << 52)
CHUNK_BYTES = 8 << 20
WHOLE = pa.decimal128(38, 0)
#: Entries of z, and gaps between eigenvalues, that are smaller than this part of the whole are taken for zero.
DEFLATE = 1e-14


# --- rank-one updates

def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of diag(d) + z z', d rising strictly and no z zero: the eigenvalues, and d_i - eigenvalue_k without cancellation.

    Each root is sought as its distance from the nearer of its two poles, all roots at once: the function is replaced by one with these two
    poles that meets it in value and slope on either side of the root, and its root taken, or the middle of what is left if that falls outside.
    """
    m, z2, each = len(d), z * z, np.arange(len(d))
    last = each == m - 1
    gap = np.append(d[1:], d[-1] + z2.sum()) - d
    apart = d[:, None] - d[None, :]
    left = last | (1 + (z2[:, None] / (apart - gap / 2)).sum(axis=0) >= 0)  # the root is nearer to its left pole, or there is no right one
    from_base = d[:, None] - d[np.where(left, each, np.minimum(each + 1, m - 1))]
    low = np.where(left, 0.0, -gap / 2)
    high = np.where(left, np.where(last, gap, gap / 2), 0.0)
    step, below = (low + high) / 2, each[:, None] <= each[None, :]
    for _ in range(60):
        away = from_base - step
        part = z2[:, None] / away
        slope = part / away
        psi, psi_slope = np.where(below, part, 0.0).sum(axis=0), np.where(below, slope, 0.0).sum(axis=0)
        phi, phi_slope = part.sum(axis=0) - psi, slope.sum(axis=0) - psi_slope
        f = 1 + psi + phi
        found = np.abs(f) <= 2e-16 * m * (1 + np.abs(psi) + np.abs(phi))
        low, high = np.where(f < 0, step, low), np.where(f < 0, high, step)
        here, there = away[each, each], np.where(last, 0.0, away[np.minimum(each + 1, m - 1), each])
        s, t = psi_slope * here ** 2, phi_slope * there ** 2
        c = 1 + (psi - psi_slope * here) + (phi - phi_slope * there)
        # c (here - x)(there - x) + s (there - x) + t (here - x) = 0; without a right pole c (here - x) + s = 0
        q = -(c * (here + there) + s + t)
        e = c * here * there + s * there + t * here
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(q * q - 4 * c * e, 0.0))
            big = -(q + np.copysign(root, q)) / 2
            one, two = step + big / c, step + e / big
            alone = step + here + s / c
            inside = lambda x: (x > low) & (x < high)
            better = np.where(last, np.where(inside(alone), alone, (low + high) / 2), np.where(inside(two), two, np.where(inside(one), one, (low + high) / 2)))
        found |= np.abs(better - step) <= 4e-16 * np.abs(step)
        step = np.where(found, step, better)
        if found.all():
            break
    return d - np.diagonal(from_base) + step, from_base - step


def add_rank_one(values: np.ndarray, vectors: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and vectors (columns) after ``term term'`` is added to their matrix."""
    z = vectors.T @ term
    size = float(np.abs(z).max(initial=0.0))
    if size == 0.0:
        return values, vectors
    vectors, z = vectors.copy(), z.copy()
    near = DEFLATE * max(float(np.abs(values).max()), size * size)
    start = 0
    for end in np.flatnonzero(np.append(np.diff(values) > near, True)) + 1:
        if end - start > 1:  # equal eigenvalues: turn their vectors until only the last meets the term
            own = z[start:end].copy()
            norm = float(np.linalg.norm(own))
            if norm > 0:
                mirror = own.copy()
                mirror[-1] += norm if own[-1] >= 0 else -norm
                mirror /= np.linalg.norm(mirror)
                vectors[:, start:end] -= 2 * np.outer(vectors[:, start:end] @ mirror, mirror)
                z[start:end] = 0.0
                z[end - 1] = -norm if own[-1] >= 0 else norm
        start = end
    open_ = np.flatnonzero(np.abs(z) > DEFLATE * size)
    d, own = values[open_], z[open_]
    roots, apart = secular_roots(d, own)
    # the z whose exact roots these are: its vectors are orthogonal however close two roots lie
    between = d[:, None] - d[None, :]
    np.fill_diagonal(between, 1.0)
    ratio = -apart
    np.fill_diagonal(ratio, 1.0)
    exact = np.sqrt(np.abs((ratio / -between).prod(axis=1) * -np.diagonal(apart)))
    turn = np.copysign(exact, own)[:, None] / apart
    turn /= np.linalg.norm(turn, axis=0)
    values = values.copy()
    values[open_] = roots
    vectors[:, open_] = vectors[:, open_] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Vectors seen so far: their number, exact sums, and the eigenpairs of their scatter about the mean."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, dimension: int) -> Spectrum:
        return cls(0, [0] * dimension, np.zeros(dimension), np.eye(dimension))

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def _join(self, n: int, sums: list[int], terms: np.ndarray) -> None:
        if self.n:
            apart = self.mean - np.array([s / n for s in sums])
            self.values, self.vectors = add_rank_one(self.values, self.vectors, apart * np.sqrt(self.n * n / (self.n + n)))
        for term in terms:
            self.values, self.vectors = add_rank_one(self.values, self.vectors, term)
        self.n, self.sums = self.n + n, [a + b for a, b in zip(self.sums, sums)]

    def add_rows(self, rows: np.ndarray) -> None:
        sums = exact_sums(rows)
        centred = rows.astype(np.float64) - np.array([s / len(rows) for s in sums])
        self._join(len(rows), sums, centred if len(rows) <= rows.shape[1] else np.linalg.qr(centred, mode="r"))

    def add(self, other: Spectrum) -> None:
        real = other.values > DEFLATE * max(float(other.values.max(initial=0.0)), 1e-300)
        self._join(other.n, other.sums, (other.vectors[:, real] * np.sqrt(other.values[real])).T)


def exact_sums(rows: np.ndarray) -> list[int]:
    if float(np.abs(rows).max(initial=0)) * len(rows) < 2 ** 62:
        return [int(s) for s in rows.sum(axis=0)]
    return [int(s) for s in rows.astype(object).sum(axis=0)]


# --- over the table

def whole_vectors(vector: Column) -> Column:
    """floor(256 c) of each entry; null for a vector that cannot be used."""
    scaled = F.transform(vector, lambda c: c.cast("double") * SCALE)
    usable = F.forall(scaled, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < LARGEST), F.lit(False)))
    return F.when(usable, F.transform(scaled, lambda c: F.floor(c)))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("x")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _spectra(dimension: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows = Spectrum.empty(dimension), max(4 * dimension, CHUNK_BYTES // (8 * dimension))
        held, waiting = [], 0
        for batch in batches:
            held.append(_matrix(batch))
            waiting += batch.num_rows
            if waiting >= rows:
                own.add_rows(np.concatenate(held))
                held, waiting = [], 0
        if waiting:
            own.add_rows(np.concatenate(held))
        if own.n:
            yield _row(own)
    return run


def _row(spectrum: Spectrum) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([spectrum.n], pa.int64()), pa.array([[Decimal(s) for s in spectrum.sums]], pa.list_(WHOLE)), pa.array([spectrum.values.tolist()], pa.list_(pa.float64())),
                                       pa.array([spectrum.vectors.ravel().tolist()], pa.list_(pa.float64()))], ["n", "sums", "eigenvalues", "vectors"])


def _spectrum(row: dict) -> Spectrum:
    values = np.array(row["eigenvalues"])
    return Spectrum(row["n"], [int(s) for s in row["sums"]], values, np.array(row["vectors"]).reshape(len(values), -1))


def _merge(key: tuple, group: pa.Table) -> pa.Table:
    spectra = sorted((_spectrum(r) for r in group.to_pylist()), key=lambda s: -s.n)
    for other in spectra[1:]:
        spectra[0].add(other)
    return pa.Table.from_batches([_row(spectra[0])]).append_column("id", pa.array([key[0].as_py()], pa.int64()))


def incremental_spectrum(points: DataFrame, dimension: int) -> Spectrum:
    """The spectrum of all rows ``x`` of ``points``."""
    fields = "n long, sums array<decimal(38,0)>, eigenvalues array<double>, vectors array<double>"
    spectra = stored(points.select("x").mapInArrow(_spectra(dimension), fields).select("*", F.spark_partition_id().cast("long").alias("id")), "whitening-spectra")
    while spectra.count() > 1:
        spectra = stored(spectra.groupBy(F.floor(F.col("id") / FAN_IN).alias("group")).applyInArrow(_merge, f"{fields}, id long"), "whitening-spectra")
    return _spectrum(spectra.first().asDict())


def _products(mean: np.ndarray, basis: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((basis.shape[1], basis.shape[1]))
        for batch in batches:
            projected = (_matrix(batch) - mean) @ basis
            total += projected.T @ projected
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "row"])
    return run


def projected_covariance(points: DataFrame, spectrum: Spectrum, basis: np.ndarray) -> np.ndarray:
    """The covariance of the rows projected on ``basis``, centred before multiplying. Tasks sum; dimension x dimension numbers reach the driver."""
    size = basis.shape[1]
    parts = points.select("x").mapInArrow(_products(spectrum.mean, basis), "i int, row array<double>")
    out = np.zeros((size, size))
    for r in parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = r.v
    return out / spectrum.n


def _whitened(kind: pa.DataType, n: int, sums: list[int], mean: np.ndarray, basis: np.ndarray, explained: list[float | None], error: float):
    count, root = basis.shape[1], basis

    def deviations(x: np.ndarray) -> list[Decimal]:
        bound = max(n * int(np.abs(x).max(initial=0)), *(abs(s) for s in sums)) * 2
        if x.shape[1] * bound * bound < 2 ** 62:
            return [Decimal(int(v)) for v in ((n * x - np.array(sums, dtype=np.int64)) ** 2).sum(axis=1)]
        return [Decimal(sum((n * int(c) - s) ** 2 for c, s in zip(row, sums))) for row in x]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch)
            value = ((x - mean) @ root).ravel()
            at = np.repeat(np.arange(batch.num_rows), count)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").take(pa.array(at)), pa.array(np.tile(np.arange(1, count + 1), batch.num_rows), pa.int32()), pa.array(np.full(len(at), n), pa.int64()),
                 pa.array(deviations(x), WHOLE).take(pa.array(at)), pa.array(value, pa.float64(), mask=np.isnan(value)), pa.array(explained * batch.num_rows, pa.float64()), pa.array(np.full(len(at), error))],
                ["_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def whiten(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component: ``component`` from 1 by falling variance, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    ``deviation`` is n**2 times the squared distance from the mean, exact, as a decimal. The model is fitted when this is called; the result
    is lazy.
    """
    kind = dict(rows.dtypes)[id_col]
    schema = f"_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    usable = rows.select(F.col(id_col).alias("_id"), whole_vectors(F.col(vector_col)).alias("x")).filter("x is not null and size(x) > 0")
    distinct = stored(usable.groupBy("x").agg(F.count(F.lit(1)).alias("n")), "whitening-points")
    common = distinct.groupBy(F.size("x").alias("d")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if common is None:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("_id", id_col)
    points = distinct.filter(F.size("x") == common.d)
    found = incremental_spectrum(points, common.d)
    basis = np.linalg.qr(found.vectors)[0]
    inner = projected_covariance(points, found, basis)
    values, turn = np.linalg.eigh(inner)
    count = min(components, common.d)
    values, basis, trace = values[::-1][:count], (basis @ turn)[:, ::-1][:, :count], float(np.trace(inner))
    basis = basis * np.sign(basis[np.argmax(np.abs(basis), axis=0), np.arange(count)])
    real = values > DEFLATE * trace
    root = np.where(real, basis / np.sqrt(np.where(real, values, 1.0)), np.nan)
    error = float(np.abs(projected_covariance(points, found, root[:, real]) - np.eye(int(real.sum()))).max()) if real.any() else 0.0
    explained = [float(max(v, 0.0) / trace) if trace > 0 else None for v in values]
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(rows.schema[id_col].dataType)
    return (usable.filter(F.size("x") == common.d).mapInArrow(_whitened(arrow, found.n, found.sums, found.mean, root, explained, error), schema).withColumnRenamed("_id", id_col))
