"""Embedding whitening from polarised variances.

Entries become integers ``x = floor(1024 * c) + 100000``, so all statistics
are exact. One pass counts the vectors and sums every dimension (``n``, ``S``).
A second one subtracts the rounded mean and adds up, for every dimension ``i``
and every sum ``x_i + x_j`` of two dimensions, the squared centred values; what
the rounding left is corrected exactly (``sum (n*x - S)^2 = n^2 * sum y^2 -
n * (sum y)^2`` with ``y = x - m``). A covariance is then half of
``Var(x_i + x_j) - Var(x_i) - Var(x_j)``: no product of two dimensions is ever
formed. The ``d x d`` matrix is assembled on the driver for ``eigh``; its size
depends on the dimension alone. A third pass projects the rows, and a last
one measures the covariance of what came out.

Defined results: rows whose vector is null, empty, or holds a null or
non-finite entry are dropped; the others must have one common length
(``ValueError`` otherwise); repeated rows count as often as they occur and null
ids are kept; an empty table gives an empty result. A component whose variance
is not above ``d * 2^-52`` of the largest is constant: its values are 0 and it
is left out of the identity error. Entries must be below 2^40 in size
(``ValueError``). Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featsearch.llm.common import python_ready, stored

STEP, SHIFT = 1024.0, 100000
#: Rows that are squared together, and the size up to which their squares are
#: added in 64-bit integers (larger entries take Python's integers).
UNIT, NARROW = 1024, 1 << 25
LARGEST = 2.0**40


@dataclass(frozen=True)
class Whitening:
    """``n`` and ``sums`` of the fit list; eigenvalues and unit eigenvectors
    (columns) by falling eigenvalue; ``explained`` share of the trace."""

    n: int
    sums: tuple[int, ...]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray


def usable(vectors: DataFrame, id_col="vec_id", vector_col="embedding") -> DataFrame:
    """``id`` and ``vector`` (doubles) of the rows that have a whole vector."""
    rows = vectors.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector")
    )
    finite = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & finite)


def _integers(vectors: pa.ListArray) -> np.ndarray:
    """``x`` of a batch, one row per vector."""
    lengths = np.diff(vectors.offsets.to_numpy())
    if len(set(lengths.tolist())) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(set(lengths.tolist()))}")
    c = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
    if np.abs(c).max(initial=0) >= LARGEST:
        raise ValueError("an entry of 2^40 or more")
    return np.floor(STEP * c).astype(np.int64) + SHIFT


def _exact(numbers) -> pa.Array:
    return pa.array([str(int(x)) for x in numbers]).cast(pa.decimal128(38, 0))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per vector length: the number of vectors (dimension -1) and the sums."""
    found: dict[int, list] = {}
    for batch in batches:
        if batch.num_rows:
            x = _integers(batch.column(0))
            here = found.setdefault(x.shape[1], [0, np.zeros(x.shape[1], object)])
            here[0] += len(x)
            here[1] += x.sum(axis=0).astype(object)
    for d, (n, sums) in found.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([d] * (d + 1), pa.int32()), pa.array(range(-1, d), pa.int32()), _exact([n, *sums])], ["d", "i", "total"]
        )


def _squares(y: np.ndarray) -> list[np.ndarray]:
    """Row ``i``: sums of ``y_i^2``, then of ``(y_i + y_j)^2`` for ``j > i``."""
    out = []
    for i in range(y.shape[1]):
        both = y[:, i:] + y[:, i : i + 1]
        both[:, 0] = y[:, i]
        out.append((both * both).sum(axis=0))
    return out


def _polarised(centre: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, total = len(centre), None
        for batch in batches:
            x = _integers(batch.column(0)) if batch.num_rows else np.zeros((0, d), np.int64)
            for at in range(0, len(x), UNIT):
                y = x[at : at + UNIT] - centre
                y = y if np.abs(y).max(initial=0) < NARROW else y.astype(object)
                found = np.concatenate(_squares(y)).astype(object)
                total = found if total is None else total + found
        if total is not None:
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), _exact(total)], ["i", "j", "squares"]
            )

    return run


def fit(rows: DataFrame) -> Whitening | None:
    """Statistics and components of ``usable`` rows (None: no rows)."""
    python_ready(rows.sparkSession)
    vectors = rows.select("vector")
    sums = vectors.mapInArrow(_moments, "d int, i int, total decimal(38,0)").groupBy("d", "i").agg(F.sum("total").alias("total"))
    found = {(r.d, r.i): int(r.total) for r in sums.collect()}  # d + 1 rows
    if not found:
        return None
    if len({d for d, _ in found}) > 1:
        raise ValueError(f"vectors of different lengths: {sorted({d for d, _ in found})}")
    d = next(iter(found))[0]
    n, s = found[d, -1], [found[d, i] for i in range(d)]
    centre = [(2 * v + n) // (2 * n) for v in s]
    rest = [v - n * m for v, m in zip(s, centre, strict=True)]  # sums of y
    squares = vectors.mapInArrow(_polarised(np.array(centre, np.int64)), "i int, j int, squares decimal(38,0)")
    spread = {}  # n^2 * variance, exact
    for r in squares.groupBy("i", "j").agg(F.sum("squares").alias("squares")).collect():  # d (d + 1) / 2 rows
        left = rest[r.i] if r.i == r.j else rest[r.i] + rest[r.j]
        spread[r.i, r.j] = n * int(r.squares) - left * left
    covariance = np.empty((d, d))
    for (i, j), both in spread.items():
        twice = 2 * both if i == j else both - spread[i, i] - spread[j, j]
        covariance[i, j] = covariance[j, i] = twice / (2 * n * n)  # one rounding
    values, vectors_ = np.linalg.eigh(covariance)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    sign = np.sign(vectors_[np.abs(vectors_).argmax(axis=0), np.arange(d)])
    trace = sum(spread[i, i] for i in range(d)) / (n * n)
    return Whitening(n, tuple(s), covariance, values, vectors_ * sign, values / trace if trace else np.zeros(d))


def constant(model: Whitening) -> np.ndarray:
    """Per component: its variance is nothing but rounding."""
    return model.values <= len(model.values) * 2.0**-52 * max(model.values[0], 0)


def transform(rows: DataFrame, model: Whitening, components: int) -> DataFrame:
    """``id``, ``deviation`` (sum over dimensions of ``(n*x - S)^2``, exact) and
    ``whitened``, the first ``components`` coordinates."""
    python_ready(rows.sparkSession)
    n, sums = model.n, np.array(model.sums, object)
    centre = np.array([(2 * v + n) // (2 * n) for v in model.sums], np.int64)
    offset = np.array([(v - n * int(m)) / n for v, m in zip(model.sums, centre, strict=True)])
    flat = constant(model)[:components]
    scaled = np.where(flat, 0, model.vectors[:, :components] / np.sqrt(np.where(flat, 1, model.values[:components])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _integers(batch.column("vector"))
            far = n * int(np.abs(x - centre).max()) + n  # bounds |n*x - S|
            away = n * (x - centre) - (sums - n * centre.astype(object)).astype(np.int64) if far < 1 << 62 else n * x.astype(object) - sums
            if far * far * len(centre) < 1 << 63:
                deviation = pa.array((away * away).sum(axis=1)).cast(pa.decimal128(38, 0))
            else:
                away = away.astype(object)
                deviation = _exact((away * away).sum(axis=1))
            out = ((x - centre) - offset) @ scaled
            ends = np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), deviation, pa.ListArray.from_arrays(ends, pa.array(out.ravel()))],
                ["id", "deviation", "whitened"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, deviation decimal(38,0), whitened array<double>")


def identity_error(whitened: DataFrame, model: Whitening, components: int) -> float:
    """Largest entry of the covariance of ``whitened`` less the identity."""
    live = np.flatnonzero(~constant(model)[:components]).tolist()
    pairs = [(i, j) for i in live for j in live if i <= j]
    if not pairs:
        return 0.0
    w = F.col("whitened")
    row = whitened.agg(*[F.covar_pop(w[i], w[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(row, pairs, strict=True))


def whiten(vectors: DataFrame, components=8, id_col="vec_id", vector_col="embedding") -> DataFrame:
    """A row per vector and component: ``id``, ``component`` (from 1), ``n``,
    ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    rows = usable(vectors, id_col, vector_col)
    model = fit(rows)
    kind = rows.schema["id"].dataType.simpleString()
    if model is None:
        none = f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        return rows.sparkSession.createDataFrame([], none)
    components = min(components, len(model.values))
    whitened = stored(transform(rows, model, components))
    error = identity_error(whitened, model, components)
    share = F.array(*[F.lit(float(v)) for v in model.explained[:components]])
    return (
        whitened.select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
        .select("id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                share[F.col("at")].alias("explained"), F.lit(float(error)).alias("identity_error"))
    )
