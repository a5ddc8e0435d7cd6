"""Fits inside one task, over distinct inputs with weights.

The iterative models round their inputs to fixed-point units. Rows that agree in
the rounded genes of a gene set and in the label are the same to every problem
with that set, so they are one cell with a weight, and the sums over rows stay the
same whole numbers. The cells of few genes are bounded by the grid of the units,
not by the rows: all steps of such a fit run in one task, without a pass over the
rows for each.

``fitted`` chooses the sets whose cells fit in a task (by an estimate of their
number that costs one pass), sorts the rows by their rounded genes, so that equal
cells meet before they are shuffled, adds up the weights per cell, and runs
``fit`` once per set. Problems of other sets are left to the passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featsearch.operators.models import exact

#: Only sets of so many genes are tried: larger ones hardly repeat.
GENES = 16
#: Most bytes (genes, label and weights) of the cells of a set in its task, and
#: of all sets in the shuffle.
BYTES, SHUFFLED = 96 << 20, 3 << 30
#: Hashes that an estimate keeps of a set; rows that a task folds into cells at a time.
KEPT, CHUNK = 256, 1 << 18
#: Rounded inputs must fit 32 bits.
LARGEST = 2.0**31 - 1


@dataclass
class Cells:
    """``x`` (cells, genes) in units, ``y``, and the rows per cell: of all folds
    and, for problems that leave a fold out, per fold of ``folds``."""

    genes: np.ndarray
    x: np.ndarray
    y: np.ndarray
    rows: np.ndarray
    folds: np.ndarray
    of_fold: np.ndarray  # (cells, folds)

    def weights(self, excl) -> np.ndarray:
        """Rows (cells, problems) that count in every problem."""
        if excl is None:
            return self.rows[:, None]
        return self.rows[:, None] - self.of_fold[:, np.searchsorted(self.folds, excl)]


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _inputs(batch: pa.RecordBatch, d: int, genes: np.ndarray, unit: int) -> np.ndarray:
    x = batch.column(batch.schema.get_field_index("features")).flatten().to_numpy(zero_copy_only=False)
    return exact.rounded(x.astype(np.float64).reshape(-1, d)[:, genes], unit)


def _mixed(h: np.ndarray) -> np.ndarray:
    """63-bit hashes of 64-bit sums (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(1)).astype(np.int64)


def estimated(rows: DataFrame, d: int, genes: np.ndarray, sets: list[np.ndarray], unit: int) -> np.ndarray | None:
    """About how many cells every set (of places in ``genes``) has: exact below
    ``KEPT``, else from its smallest hashes. None if an input exceeds 32 bits."""
    factors = np.random.default_rng(1).integers(1 << 32, 1 << 63, len(genes) + 1).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, fits = [np.zeros(0, np.int64)] * len(sets), True
        for batch in batches:
            if not batch.num_rows or not fits:
                continue
            x = _inputs(batch, d, genes, unit)
            fits = bool((np.abs(x) <= LARGEST).all())  # false for NaN
            if not fits:
                continue
            terms = x.astype(np.int64).astype(np.uint64) * factors[:-1]
            label = _column(batch, "y").astype(np.uint64) * factors[-1]
            for i, s in enumerate(sets):
                h = _mixed(terms[:, s].sum(axis=1, dtype=np.uint64) + label)
                if len(least[i]) == KEPT:
                    h = h[h < least[i][-1]]
                if len(h):
                    least[i] = np.unique(np.concatenate([least[i], h]))[:KEPT]
        of = np.repeat(np.arange(len(sets)), [len(h) for h in least])
        found = np.concatenate([*least, np.zeros(0, np.int64)])
        if not fits:
            of, found = np.array([-1]), np.array([0])
        yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(found, pa.int64())], ["s", "h"])

    smallest = F.slice(F.array_sort(F.collect_set("h")), 1, KEPT)
    got = rows.mapInArrow(run, "s long, h long").groupBy("s").agg(smallest.alias("h")).select("s", F.size("h").alias("n"), F.element_at("h", -1).alias("last")).collect()
    out = np.zeros(len(sets))
    for r in got:
        if r.s < 0:
            return None
        out[r.s] = r.n if r.n < KEPT else (KEPT - 1) * 2.0**63 / max(r.last, 1)
    return out


def _binary(x: np.ndarray) -> pa.Array:
    """Rows of ``x`` as binary values."""
    width = x.shape[1] * x.dtype.itemsize
    offsets = np.arange(len(x) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x))])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The int32 rows of a binary column."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = b"" if data is None else memoryview(data)[offsets[0] : offsets[-1]]
    return np.frombuffer(raw, np.int32).reshape(len(column), width)


def _sortable(x: np.ndarray) -> np.ndarray:
    """32-bit numbers whose bytes order as the numbers do."""
    return (x.astype(np.int64) + (1 << 31)).astype(">u4")


def _numbers(column: pa.Array, width: int) -> np.ndarray:
    return (_matrix(column, width).view(">u4").astype(np.int64) - (1 << 31)).astype(np.int32)


def _distinct(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A place of every different code and how often it occurs."""
    if size > 4 * len(codes):
        _, first, n = np.unique(codes, return_index=True, return_counts=True)
        return first, n
    n, first = np.bincount(codes, minlength=size), np.empty(size, np.int64)
    first[codes] = np.arange(len(codes))
    return first[n > 0], n[n > 0]


def _projected(x: np.ndarray, y: np.ndarray, fold: np.ndarray, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The cells of every set among some rows, a fold at a time."""
    levels, places = zip(*(np.unique(c, return_inverse=True) for c in x.T)) if x.shape[1] else ((), ())
    folds, at = np.unique(fold, return_inverse=True)
    for i, s in enumerate(sets):
        codes, size = at * 2 + y, 2 * len(folds)
        for g in s:
            if size * len(levels[g]) >= 1 << 62:  # codes that occur, numbered anew
                seen, codes = np.unique(codes, return_inverse=True)
                size = len(seen)
            codes, size = codes * len(levels[g]) + places[g], size * len(levels[g])
        first, n = _distinct(codes, size)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(first), i, np.int32)), _binary(x[np.ix_(first, s)]), pa.array(y[first].astype(np.int32)),
             pa.array(fold[first].astype(np.int32)), pa.array(n.astype(np.int64))],
            ["s", "x", "y", "fold", "n"],
        )


def fitted(rows: DataFrame, bits: np.ndarray, excl: np.ndarray | None, unit: int,
           fit: Callable[[Cells, np.ndarray, np.ndarray | None], list[bytes]]) -> dict[int, bytes]:
    """What ``fit(cells, problems, left-out folds)`` returns for every problem whose
    cells fit in a task; ``rows``: ``y, features`` and, with ``excl``, ``fold``."""
    bits = np.asarray(bits, np.int8)
    d, of_set = bits.shape[1], {}
    for k, b in enumerate(bits):
        if b.sum() <= GENES:
            of_set.setdefault(b.tobytes(), []).append(k)
    if not of_set:
        return {}
    members = [np.array(ks) for ks in of_set.values()]
    genes = np.flatnonzero(bits[np.concatenate(members)].any(axis=0))
    own = [np.flatnonzero(bits[ks[0], genes]) for ks in members]
    single = [np.array([j]) for j in range(len(genes))]
    size = estimated(rows, d, genes, own + single, unit)
    if size is None:
        return {}
    order = np.argsort(-size[len(own) :], kind="stable")  # rows are sorted by the gene with most levels first
    folds = np.zeros(0, np.int64) if excl is None else np.unique(excl)
    held = np.array([size[i] * (4 * len(s) + 9 + 16 * len(folds)) for i, s in enumerate(own)])
    small = np.argsort(held, kind="stable")
    small = small[(held[small] <= BYTES) & (np.cumsum(held[small]) <= SHUFFLED)]
    chosen = small[::-1]  # the task with most to do is number 0
    if not len(chosen):
        return {}
    genes, place = genes[order], np.argsort(order)
    sets = [np.sort(place[own[i]]) for i in chosen]
    problems, wide = [members[i] for i in chosen], len(genes)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = _column(batch, "y").astype(np.int32)
                fold = np.zeros(len(y), np.int32) if excl is None else _column(batch, "fold").astype(np.int32)
                yield pa.RecordBatch.from_arrays([_binary(_sortable(_inputs(batch, d, genes, unit))), pa.array(y), pa.array(fold)], ["key", "y", "fold"])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append((_numbers(batch.column(0), wide), _column(batch, "y"), _column(batch, "fold")))
            n += batch.num_rows
            if n >= CHUNK:
                yield from _projected(*map(np.concatenate, zip(*held)), sets)
                held, n = [], 0
        if n:
            yield from _projected(*map(np.concatenate, zip(*held)), sets)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            if batch.num_rows:
                at = int(batch.column(0)[0].as_py())
                own = genes[sets[at]]
                by = np.argsort(own)
                x = _matrix(batch.column(1), len(own))[:, by]
                x = x.astype(np.int16 if np.abs(x.astype(np.int64)).max(initial=0) < 1 << 15 else np.int32)
                of_fold = np.stack([_column(batch, f"n{f}") for f in folds], axis=1) if len(folds) else np.zeros((batch.num_rows, 0), np.int64)
                held.append((x, _column(batch, "y").astype(np.int8), _column(batch, "n"), of_fold))
        if at is None:
            return
        x, y, n, of_fold = map(np.concatenate, zip(*held))
        held.clear()
        ks = problems[at]
        cells = Cells(own[by], x, y, n, folds, of_fold)
        out = fit(cells, ks, None if excl is None else excl[ks])
        yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(out, pa.binary())], ["k", "v"])

    packed = rows.mapInArrow(pack, "key binary, y int, fold int")
    spread = rows.sparkSession.sparkContext.defaultParallelism
    ordered = packed.repartitionByRange(max(spread, packed.rdd.getNumPartitions()), "key", "y", "fold").sortWithinPartitions("key")
    counts = [F.sum("n").alias("n")] + [F.sum(F.when(F.col("fold") == int(f), F.col("n")).otherwise(0)).alias(f"n{f}") for f in folds]
    cells = ordered.mapInArrow(project, "s int, x binary, y int, fold int, n long").groupBy("s", "x", "y").agg(*counts)
    found = cells.repartitionById(len(sets), "s").mapInArrow(solve, "k long, v binary").collect()
    return {r.k: bytes(r.v) for r in found}
