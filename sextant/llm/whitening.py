"""Embedding whitening by spectral divide and conquer on QDWH polar decompositions.

The vectors are floored to multiples of 1/256, exact integers, and each
distinct one counts once for the mean and the covariance.  Tasks sum up their
part, and the parts of one row of the matrix are added by one task, so that
what reaches the driver is one matrix whatever the table's size.

The polar factor of a shifted covariance is its sign: from it comes the
projector onto the components above the shift.  An orthonormal basis of the
projector's range and of the rest turns the matrix into two blocks, and each
is divided again until its components stand alone.  The polar factors come
from the dynamically weighted Halley iteration in its QR form.  Components and
mean, a few kilobytes, go to all tasks, which whiten all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import give_back, result_schema, stored

SCALE = 256
#: An eigenvalue below this share of the trace, times the dimension, is rounding and counts as zero.
ROUNDING = 1e-15


def qdwh_polar(a: np.ndarray, least: float = 1e-16, rounds: int = 40) -> np.ndarray:
    """The orthogonal polar factor of a square matrix by the QR-based dynamically weighted Halley iteration."""
    size = len(a)
    norm = np.linalg.norm(a, 2)
    if norm == 0:
        return np.eye(size)
    x, low = a / norm, least
    for _ in range(rounds):
        low = min(low, 1.0)
        gap = np.cbrt(4 * (1 - low * low) / low ** 4)
        wide = np.sqrt(1 + gap)
        wa = wide + 0.5 * np.sqrt(max(8 - 4 * gap + 8 * (2 - low * low) / (low * low * wide), 0.0))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(size)]))
        moved = (wb / wc) * x + (wa - wb / wc) / np.sqrt(wc) * (q[:size] @ q[size:].T)
        low = low * (wa + wb * low * low) / (1 + wc * low * low)
        step = np.linalg.norm(moved - x)
        x = moved
        if step < 1e-14 * size and abs(low - 1) < 1e-14:
            break
    return x


def divided(a: np.ndarray, shift: float, tiny: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces of symmetric ``a`` above and below ``shift``.

    None where the shift does not divide, or is so near an eigenvalue that the blocks stay coupled.
    """
    size = len(a)
    sign = qdwh_polar(a - shift * np.eye(size))
    projector = (sign + sign.T) / 4 + np.eye(size) / 2
    above = int(round(np.trace(projector)))
    if not 0 < above < size:
        return None
    start = np.random.default_rng(size).standard_normal((size, above))
    for _ in range(2):  # the second pass removes what the first leaves of the other subspace
        start = np.linalg.qr(projector @ start)[0]
    basis = np.linalg.qr(start, mode="complete")[0]
    upper, lower = basis[:, :above], basis[:, above:]
    if np.abs(lower.T @ a @ upper).max() > tiny:
        return None
    return upper, lower


def components(a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest ``wanted`` eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns."""
    norm = np.linalg.norm(a)
    tiny = 1e-14 * norm * max(1, len(a)) ** 0.5

    def split(block: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
        size = len(block)
        mean = np.trace(block) / size if size else 0.0
        if size <= 1 or np.linalg.norm(block - mean * np.eye(size)) <= tiny:
            return np.diag(block).copy(), np.eye(size)  # one component, or all with one value: any basis
        spread = np.linalg.norm(block - mean * np.eye(size)) / size ** 0.5
        diagonal = np.sort(np.diag(block))
        shifts = [float(np.median(diagonal)), mean, *(mean + spread * f for f in (0.05, -0.05, 0.3, -0.3, 0.7, -0.7, 0.011, -0.013))]
        for shift in shifts:
            parts = divided(block, shift, tiny)
            if parts:
                break
        else:
            raise ArithmeticError("no shift divides the covariance")
        values, vectors = [], []
        for basis in parts:
            if need > len(values):
                inner = basis.T @ block @ basis
                w, v = split((inner + inner.T) / 2, need - len(values))
                values += list(w)
                vectors.append(basis @ v)
        return np.array(values), np.hstack(vectors)

    values, vectors = split((a + a.T) / 2, min(wanted, len(a)))
    order = np.argsort(-values, kind="stable")[:wanted]
    return values[order], vectors[:, order]


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    lists = batch.column(column)
    return pc.list_flatten(lists).to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _added(parts: DataFrame, width: int) -> np.ndarray:
    """The sums over ``(i, row array)`` for every i: the partial rows are added by tasks, the driver gets one row for each i."""
    def add(key: tuple, group: pa.Table) -> pa.Table:
        rows = pc.list_flatten(group.column("row").combine_chunks()).to_numpy(zero_copy_only=False).reshape(-1, width)
        return pa.table({"i": [key[0].as_py()], "row": pa.array([rows.sum(axis=0)], type=pa.list_(pa.float64()))})
    added = parts.groupBy("i").applyInArrow(add, parts.schema).collect()
    return np.array([r["row"] for r in sorted(added, key=lambda r: r["i"])])


def _fit_sums(fit: DataFrame) -> list[int]:
    """Number of vectors, then the exact sum of every dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch, "x")
                part = (x if np.abs(x.astype(np.float64)).max() * len(x) < 2 ** 62 else x.astype(object)).sum(axis=0).astype(object)
                total = part if total is None else total + part
                n += len(x)
        if n:
            sums = pa.array([Decimal(int(s)) for s in [n, *total]], type=pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), sums], ["d", "s"])
    added = fit.mapInArrow(run, "d long, s decimal(38,0)").groupBy("d").agg(F.sum("s").alias("s"))
    return [int(r["s"]) for r in added.orderBy("d").collect()]  # one number per dimension


def _fit_covariance(fit: DataFrame, mean: np.ndarray, onto: np.ndarray, n: int) -> np.ndarray:
    """Covariance, divisor n, of the centred vectors times ``onto``."""
    width = onto.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                z = (_matrix(batch.slice(at, 4096), "x") - mean) @ onto
                total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(list(total), type=pa.list_(pa.float64()))], ["i", "row"])
    return _added(fit.mapInArrow(run, "i long, row array<double>"), width) / n


def floored(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("long"))


def whole_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, x)`` of the rows whose vector has entries, all finite, and the length that most such rows have."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = table.select(F.col(id_col).alias("id"), v.alias("v")).where(v.isNotNull() & (F.size(v) > 0)).where(~F.coalesce(bad, F.lit(False)))
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("v") == (length["d"] if length else 0)).select("id", floored(F.col("v")).alias("x"))


def whiten(table: DataFrame, n_components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)`` per row and component.

    Rows whose vector is null, empty or holds a null or an entry that is not
    finite are left out, and rows whose vector has another length than most
    (of equally frequent lengths the largest counts).  Null ids and repeated
    rows give their rows like others; equal vectors count once in the fit.
    Vectors of fewer dimensions have fewer components.  Where a component has
    no variance (one distinct vector, dependent dimensions), ``whitened`` and ``explained`` are 0 and it
    does not count in ``identity_error``, which is 0 if none counts.  A
    ``deviation`` beyond 64 bits is null.  Components of equal eigenvalue are
    any orthonormal ones of their subspace.  An empty table gives an empty
    result; other columns are not read.
    """
    rows = whole_vectors(table, id_col, vector_col)
    fit = stored(rows.select("x").distinct(), "fit")
    sums = _fit_sums(fit)
    schema = result_schema(table, {id_col: id_col}, "component int, n long, deviation long, whitened double, explained double, identity_error double")
    if not sums:
        return table.sparkSession.createDataFrame([], schema)
    n, total = sums[0], sums[1:]
    mean = np.array([int(s) / n for s in total])
    v = _fit_covariance(fit, mean, np.eye(len(total)), n)
    values, vectors = components(v, n_components)
    trace = float(np.trace(v))
    real = values > trace * len(total) * ROUNDING
    scale = np.where(real, 1 / np.sqrt(np.where(real, values, 1.0)), 0.0)
    onto = vectors * scale
    explained = np.where(real, values / trace if trace else 0.0, 0.0)
    measured = _fit_covariance(fit, mean, onto[:, real], n) if real.any() else np.eye(0)
    error = float(np.abs(measured - np.eye(int(real.sum()))).max()) if real.any() else 0.0
    width = len(values)
    sum_of = np.array(total, dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                x = _matrix(batch, "x")
                z = (x - mean) @ onto
                bound = float(np.abs(x).max()) * n + max(abs(s) for s in total)
                if bound * bound * len(total) < 2 ** 62:
                    deviation = ((n * x - sum_of.astype(np.int64)) ** 2).sum(axis=1)
                else:
                    exact = ((x.astype(object) * n - sum_of) ** 2).sum(axis=1)
                    deviation = [d if d < 2 ** 63 else None for d in exact]
                several = len(x) * width
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").take(pa.array(np.repeat(np.arange(len(x)), width))),
                    pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(x))), pa.array(np.full(several, n)),
                    pa.array(deviation, type=pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), width))), pa.array(z.ravel()),
                    pa.array(np.tile(explained, len(x))), pa.array(np.full(several, error))], schema.names)
        give_back()

    return rows.mapInArrow(run, schema)
