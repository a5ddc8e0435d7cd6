"""Sums over partitioned rows that do not depend on how the rows are dealt out.

Model passes add up whole numbers: gradients are rounded to fixed-point units
row by row before they are summed, so any grouping of rows, tasks and executors
gives the same totals, and with them the same fits.

Products of two rounded factors are formed by ordinary matrix products of
doubles: as long as every partial sum is a whole number below 2^53, each is
exact in any order. ``product`` takes as many rows at a time as that allows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a whole number that a double holds exactly.
EXACT_BITS = 53


def rounded(values: np.ndarray, bits: int) -> np.ndarray:
    """Whole numbers (as doubles) of units ``2^-bits``."""
    return np.rint(values * 2.0**bits)


def product(left: np.ndarray, right: np.ndarray, most: float | None = None) -> np.ndarray:
    """``left.T @ right`` of whole numbers (doubles), exact, as int64.

    ``left`` (rows, a) or a stack (p, rows, a), ``right`` (rows, b) or a stack;
    ``most``: no entry of ``right`` is larger, if that is known.
    """
    rows = left.shape[-2]
    if rows == 0:
        return np.zeros((*left.shape[:-2], left.shape[-1], right.shape[-1]), np.int64)
    largest = np.abs(left).max(initial=0) * (np.abs(right).max(initial=0) if most is None else most)
    if largest >= 2.0**EXACT_BITS:
        raise OverflowError("entries too large for exact sums")
    step = rows if largest == 0 else max(1, int(2.0**EXACT_BITS // largest))
    out = 0
    for at in range(0, rows, step):
        out = out + np.matmul(np.swapaxes(left[..., at : at + step, :], -1, -2), right[..., at : at + step, :]).astype(np.int64)
    return out


#: Bits of a weight that enter one product.
DIGIT = 12


def weighted(left: np.ndarray, weight: np.ndarray, right: np.ndarray, most: float | None = None) -> np.ndarray:
    """``product`` with every row of ``left`` taken ``weight`` times: whole numbers (int64)
    of the shape of ``left`` or one per row, as large as they may be."""
    out, shift = 0, 0
    while weight.any():
        out = out + (product(left * (weight & ((1 << DIGIT) - 1)), right, most) << shift)
        weight, shift = weight >> DIGIT, shift + DIGIT
    return out + np.zeros((left.shape[-1], right.shape[-1]), np.int64)


#: Bytes of totals that leave a task in one batch.
BATCH = 64 << 20


def emitted(totals: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A row per problem: its number and its int64 totals."""
    ks, vs, size = [], [], 0
    for k, v in totals.items():
        ks.append(k)
        vs.append(np.ascontiguousarray(v, np.int64).tobytes())
        size += len(vs[-1])
        if size >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(vs, pa.binary())], ["k", "v"])
            ks, vs, size = [], [], 0
    if ks:
        yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(vs, pa.binary())], ["k", "v"])


#: Bytes of the totals of problems that one reducer adds together.
BUNDLE = 1 << 20


def sums(rows: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
         finish: Callable[[int, np.ndarray], bytes] | None = None, length: int = 1) -> dict[int, bytes | np.ndarray]:
    """One pass: ``task`` turns a task's rows into ``emitted`` totals, which are
    added per problem on the executors; ``finish(k, totals)`` there reduces them
    to what the driver needs (default: the totals themselves).

    The shuffle is one row per task and problem; the driver gets one per problem.
    ``length`` is the usual length of a problem's totals: short ones are added
    in bundles, long ones each in a task of its own.
    """

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column("k").to_pylist(), batch.column("v").to_pylist(), strict=True):
                here = np.frombuffer(v, np.int64)
                if k in totals:
                    totals[k] += here
                else:
                    totals[k] = here.copy()
        out = [v.tobytes() if finish is None else finish(k, v) for k, v in totals.items()]
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int64()), pa.array(out, pa.binary())], ["k", "v"])

    width = max(1, BUNDLE // (8 * max(length, 1)))
    made = rows.mapInArrow(task, "k long, v binary").groupBy(F.expr(f"k div {width}"))
    found = made.applyInArrow(reduce, "k long, v binary").collect()
    return {r.k: np.frombuffer(r.v, np.int64) if finish is None else bytes(r.v) for r in found}
