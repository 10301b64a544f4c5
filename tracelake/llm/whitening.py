"""Embedding whitening: principal components by a randomised range finder, and every vector in their scaled coordinates.

The covariance V of all vectors never needs to be formed while few components are wanted. A random basis Q of
`components + OVERSAMPLE` columns is multiplied by V in passes over all centred rows (a task adds up X'(XQ) over its rows,
Spark adds up the tasks), made orthonormal again after each of `POWER` further passes, and Rayleigh-Ritz on Q'VQ gives
eigenvalues and components. The pass for Rayleigh-Ritz also gives VQ, and with it each component's residual |Vw - ew|. Where
one of them exceeds TOLERANCE times the largest eigenvalue, as in spectra that are nearly flat, the basis is expanded
to the full dimension: VQ is then V itself, and the components are those of a dense eigenproblem.

Entries go through integers, x = floor(64 c) + 1000000, so that counts, sums and deviations are exact at every size and in
every order of the rows. Columns are centred before they are multiplied.

Defined results: a vector that is null, empty, or holds null, NaN or infinity takes no part, and nor does one with an entry
of 2^47 or more (its integer isn't exact) or of another length than most have (of equally frequent lengths the longest).
All others do, repeated rows and rows without a vec_id included. There are as many components as asked for or as V has
rank: what can't be scaled to unit variance isn't returned, so identical vectors and an empty table give no rows. A
deviation beyond 64 bits is null. Other columns aren't read, whatever their names. A vector of `d` entries needs d x d
doubles in a task, which does for some thousands.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.vectors import matrix, summed, usable, usual_length

#: Further columns of the random basis, and passes over all rows that sharpen it.
OVERSAMPLE, POWER = 10, 2
#: Largest residual of a component, as a part of the largest eigenvalue.
TOLERANCE = 1e-13
#: Entries that are worked on at a time.
CELLS = 1_000_000
#: Eigenvalues below this part of the trace, for each dimension, are rounding.
RANK = 1e-14


@dataclass
class Whitening:
    """What whitening a table takes: exact counts and sums, the trace, and components (columns) with their eigenvalues."""

    length: int
    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    components: np.ndarray
    #: Whether the basis had to be expanded to the full dimension.
    full: bool


def vectors_of(rows: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, embedding) of the rows that take part, as doubles, and their length."""
    rows = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    rows = rows.where(F.coalesce(F.forall("embedding", lambda x: F.abs(x) < 2.0**47), F.lit(False)))
    length = usual_length(rows, "embedding")
    return rows.where(usable(F.col("embedding")) & (F.size("embedding") == length)), length


def _blocks(batches, length: int):
    """(batch, integers) in blocks of a bounded number of entries."""
    step = max(1, CELLS // length)
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            piece = batch.slice(start, step)
            yield piece, np.floor(64 * matrix(piece.column("embedding"), length)).astype(np.int64) + 1_000_000


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exactly; as Python's integers where 64 bits wouldn't do."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums)) < 2**62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _counted(vectors: DataFrame, length: int) -> tuple[int, list[int]]:
    """Number of rows and sums of each dimension. The halves of the integers are added up apart, so nothing overflows."""

    def work(batches):
        n, high, low = 0, np.zeros(length, np.int64), np.zeros(length, np.int64)
        for _, x in _blocks(batches, length):
            n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_pydict({"totals": [[n, *high, *low]]}, pa.schema([("totals", pa.list_(pa.int64()))]))

    (totals,) = summed(vectors.select("embedding").mapInArrow(work, "totals array<long>"), "totals")
    if not len(totals):
        return 0, [0] * length
    return int(totals[0]), [(int(h) << 32) + int(w) for h, w in zip(totals[1 : length + 1], totals[length + 1 :], strict=True)]


def _products(vectors: DataFrame, n: int, sums: list[int], basis: np.ndarray) -> tuple[np.ndarray, float]:
    """V times a basis and the trace of V, in one pass over all centred rows."""
    length = len(basis)

    def work(batches):
        out, squares = np.zeros(basis.shape), 0.0
        for _, x in _blocks(batches, length):
            centred = _deviations(x, n, sums).astype(float) / n
            out += centred.T @ (centred @ basis)
            squares += float((centred * centred).sum())
        yield pa.RecordBatch.from_pydict({"out": [[squares, *out.ravel()]]}, pa.schema([("out", pa.list_(pa.float64()))]))

    (total,) = summed(vectors.select("embedding").mapInArrow(work, "out array<double>"), "out")
    return total[1:].reshape(basis.shape) / n, float(total[0]) / n


def fit(rows: DataFrame, components: int = 32, oversample: int = OVERSAMPLE, power: int = POWER, tolerance: float = TOLERANCE, seed: int = 7) -> Whitening | None:
    """Components of all vectors; None if no row takes part."""
    vectors, length = vectors_of(rows)
    n, sums = _counted(vectors, length) if length else (0, [])
    if not n:
        return None
    wide, full = min(length, components + oversample), False
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(length, wide)))[0] if wide < length else np.eye(length)
    for _ in range(1 + power if wide < length else 0):
        basis = np.linalg.qr(_products(vectors, n, sums, basis)[0])[0]
    while True:
        product, trace = _products(vectors, n, sums, basis)
        small = basis.T @ product
        values, inner = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values)[:components]
        values, inner = values[order], inner[:, order]
        full = basis.shape[1] == length
        residual = np.linalg.norm(product @ inner - basis @ inner * values, axis=0).max(initial=0)
        if full or residual <= tolerance * max(values.max(initial=0), 0):
            break
        basis = np.eye(length)
    kept = values > RANK * length * trace
    return Whitening(length, n, sums, trace, values[kept], (basis @ inner)[:, kept], full)


def _identity_error(vectors: DataFrame, fitted: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, over all rows."""
    wide, scaled = len(fitted.values), fitted.components / np.sqrt(fitted.values)
    n, sums, length = fitted.n, fitted.sums, fitted.length

    def work(batches):
        first, second = np.zeros(wide), np.zeros((wide, wide))
        for _, x in _blocks(batches, length):
            white = _deviations(x, n, sums).astype(float) / n @ scaled
            first, second = first + white.sum(0), second + white.T @ white
        yield pa.RecordBatch.from_pydict({"out": [[*first, *second.ravel()]]}, pa.schema([("out", pa.list_(pa.float64()))]))

    (total,) = summed(vectors.select("embedding").mapInArrow(work, "out array<double>"), "out")
    mean, second = total[:wide] / n, total[wide:].reshape(wide, wide) / n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(wide)).max(initial=0))


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, components: int = 32, **parameters) -> DataFrame:
    """One row for each vector and component: see SCHEMA, and the module for what takes part. Parameters are those of fit()."""
    fitted = fit(rows, components, **parameters)
    if fitted is None or not len(fitted.values):
        return rows.sparkSession.createDataFrame([], SCHEMA)
    vectors, _ = vectors_of(rows)
    error, wide, scaled = _identity_error(vectors, fitted), len(fitted.values), fitted.components / np.sqrt(fitted.values)
    n, sums, length, explained = fitted.n, fitted.sums, fitted.length, fitted.values / fitted.trace

    def work(batches):
        for piece, x in _blocks(batches, length):
            d = _deviations(x, n, sums)
            if d.dtype == object or float(np.abs(d).max(initial=0)) ** 2 * length >= 2**62:
                exact = [int(s) if s < 2**63 else None for s in (d.astype(object) ** 2).sum(1)]
            else:
                exact = (d * d).sum(1)
            at = np.repeat(np.arange(len(x)), wide)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("vec_id").take(pa.array(at)), pa.array(np.tile(np.arange(1, wide + 1, dtype=np.int32), len(x))), pa.array(np.full(len(at), n)),
                    pa.array(exact, pa.int64()).take(pa.array(at)), pa.array((d.astype(float) / n @ scaled).ravel()), pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(at), error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.mapInArrow(work, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
