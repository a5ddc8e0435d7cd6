"""Bit-vector algebra on ``genes ARRAY<INT>`` columns (0/1 per feature).

All operators are built-in higher-order functions, so they stay JVM-side.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from featsearch.functions.rng import threshold, u32


def crossover_onepoint(a: Column, b: Column, n_genes: int) -> Column:
    """First ``n_genes // 2`` genes from ``a``, the rest from ``b`` (fixed cut)."""
    half = n_genes // 2
    return F.transform(a, lambda x, i: F.when(i < half, x).otherwise(b[i]))


def crossover_multipoint(a: Column, b: Column) -> Column:
    """Even positions from ``a``, odd positions from ``b``."""
    return F.transform(a, lambda x, i: F.when(i % 2 == 0, x).otherwise(b[i]))


def crossover(a: Column, b: Column, n_genes: int, method: str) -> Column:
    if method == "onepoint":
        return crossover_onepoint(a, b, n_genes)
    if method == "multipoint":
        return crossover_multipoint(a, b)
    raise ValueError(f"unknown crossover {method!r}; valid: onepoint, multipoint")


def mutate(genes: Column, rate: float, seed: int, generation: int, slot: Column) -> Column:
    """Flip each bit independently with probability ``rate`` (xor with a hashed mask)."""
    t = threshold(rate)
    return F.transform(
        genes,
        lambda x, i: F.when(u32(seed, "mutate", generation, slot, i) < F.lit(t), 1 - x).otherwise(x),
    )


def n_selected(genes: Column) -> Column:
    return F.aggregate(genes, F.lit(0).cast("bigint"), lambda acc, x: acc + x)


def bitstring(genes: Column) -> Column:
    """Lossless text form, e.g. ``0110``; used for CSV export and result keys."""
    return F.array_join(F.transform(genes, lambda x: x.cast("string")), "")


def from_bitstring(s: Column) -> Column:
    """Inverse of :func:`bitstring` (never ``eval``)."""
    return F.transform(F.split(s, ""), lambda c: c.cast("int"))


def jaccard_overlap(a: Column, b: Column) -> Column:
    """Common ones / union of ones (``1 - jaccard distance``); 1 when both are empty."""
    inter = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0), lambda s, v: s + v)
    union = F.aggregate(F.zip_with(a, b, lambda x, y: F.greatest(x, y)), F.lit(0), lambda s, v: s + v)
    return F.when(union == 0, F.lit(1.0)).otherwise(inter / union)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: F.when(x != y, 1).otherwise(0)), F.lit(0).cast("bigint"), lambda s, v: s + v
    )
