"""Population algebra (G1-G12) on ``(chrom_id BIGINT, genes ARRAY<INT>)``.

Populations are small (P rows, bounded by the search config), so global
ranking windows over them are fine; they never touch data rows. Every random
draw is keyed by (seed, purpose, generation, slot[, gene]).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from featsearch.functions import bits
from featsearch.functions.rng import u32
from featsearch.session import ship_package, written

# Upper bound of the bytes shipped to tasks with a population of P * d bits.
MAX_POPULATION_BITS = 200_000_000


def init(spark: SparkSession, n_chromosomes: int, n_genes: int, seed: int = 0, generation: int = 0,
         purpose: str = "init", first_id: int = 0) -> DataFrame:
    """Fair random bits, one row per chromosome (generate_population)."""
    if n_chromosomes <= 0 or n_genes <= 0:
        raise ValueError("population and chromosome sizes must be positive")
    cid = F.col("id")
    genes = F.transform(
        F.sequence(F.lit(0), F.lit(n_genes - 1)),
        lambda g: (u32(seed, purpose, generation, cid, g) % 2).cast("int"),
    )
    return spark.range(first_id, first_id + n_chromosomes).select(cid.alias("chrom_id"), genes.alias("genes"))


def ones(spark: SparkSession, n_genes: int, chrom_id: int = 0) -> DataFrame:
    return spark.range(chrom_id, chrom_id + 1).select(
        F.col("id").alias("chrom_id"), F.array_repeat(F.lit(1), n_genes).alias("genes")
    )


def from_rows(spark: SparkSession, rows: list[tuple[int, list[int]]]) -> DataFrame:
    return literal_frame(spark, [r[0] for r in rows], [list(r[1]) for r in rows])


def literal_frame(spark: SparkSession, ids: list, genes: list, scores: list | None = None) -> DataFrame:
    """A P-row population as one JSON literal parsed on the JVM.

    Unlike ``createDataFrame`` over Python rows (an RDD scan that goes through
    Python workers on every use) the plan is JVM-only, and unlike nested list
    literals it costs one literal, not one per gene.
    """
    import json

    if len(ids) == 0:
        empty = "chrom_id bigint, genes array<int>" + (", score double" if scores is not None else "")
        return spark.createDataFrame([], empty)
    recs = [{"chrom_id": int(i), "genes": "".join(str(int(x)) for x in g)} for i, g in zip(ids, genes)]
    struct = "chrom_id:bigint,genes:string"
    if scores is not None:
        struct += ",score:double"
        for r, v in zip(recs, scores):
            r["score"] = None if v is None else float(v)
    parsed = F.from_json(F.lit(json.dumps(recs)), f"array<struct<{struct}>>")
    df = spark.range(1).select(F.inline(parsed))
    cols = [F.col("chrom_id"), bits.from_bitstring(F.col("genes")).alias("genes")]
    if scores is not None:
        cols.append(F.col("score"))
    return df.select(*cols)


def to_matrix(pop: DataFrame, bits_per_byte: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Collect a population (bounded by config) for shipping to tasks, by a model
    that ships ``bits_per_byte``.

    One bit string per chromosome travels through Arrow and is decoded with
    numpy: one byte per gene, no Python object per gene.
    """
    t = pop.select(F.col("chrom_id").cast("bigint").alias("chrom_id"), bits.bitstring(F.col("genes")).alias("g")).toArrow()
    if t.num_rows == 0:
        return np.zeros(0, np.int64), np.zeros((0, 0), np.int8)
    ids = t.column("chrom_id").to_numpy()
    strs = t.column("g").to_pylist()  # one string per chromosome
    d = len(strs[0])
    if t.num_rows * d > MAX_POPULATION_BITS * bits_per_byte:
        raise ValueError(f"population of {t.num_rows * d} bits exceeds MAX_POPULATION_BITS")
    if any(len(x) != d for x in strs):
        raise ValueError("chromosomes of different lengths")
    mat = np.empty((len(strs), d), np.int8)
    for row, text in zip(mat, strs, strict=True):  # no second copy of a wide population
        np.subtract(np.frombuffer(text.encode("ascii"), np.int8), ord("0"), out=row)
    return ids.astype(np.int64), mat


#: Genes of a piece of a chromosome.
PIECE = 1 << 16


def _packed(batches):
    """Pieces of genes, eight to a byte, with a digest of each."""
    for b in batches:
        row, chrom_id, at, genes = (b.column(i) for i in range(4))
        packed = [np.packbits(np.asarray(g.values, np.uint8)).tobytes() for g in genes]
        digest = [hashlib.sha256(p).digest() for p in packed]
        n = [len(g.values) for g in genes]
        yield pa.RecordBatch.from_arrays([row, chrom_id, at, pa.array(n, pa.int64()), pa.array(packed, pa.binary()), pa.array(digest, pa.binary())],
                                         ["row", "chrom_id", "at", "n", "packed", "digest"])


class Pieces:
    """A population as packed bits in pieces of ``PIECE`` genes, written once below the
    checkpoint folder: the driver knows ids and digests, and reads some genes of all
    chromosomes at a time, so its memory does not grow with the width."""

    def __init__(self, pop: DataFrame, bits_per_byte: int):
        ship_package(pop.sparkSession)
        last = F.greatest(F.ceil(F.size("genes") / PIECE), F.lit(1)) - 1
        cut = pop.select(
            F.monotonically_increasing_id().alias("row"), F.col("chrom_id").cast("bigint").alias("chrom_id"), F.col("genes").cast("array<int>").alias("genes"),
        ).select("row", "chrom_id", "genes", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("at"))
        cut = cut.select("row", "chrom_id", "at", F.slice("genes", (F.col("at") * PIECE + 1).cast("int"), F.lit(PIECE)).alias("genes"))
        self.table = written(cut.mapInArrow(_packed, "row bigint, chrom_id bigint, at bigint, n bigint, packed binary, digest binary"), "pieces")
        known: dict = {}
        for r in self.table.select("row", "chrom_id", "at", "n", "digest").collect():  # a row per piece
            known.setdefault(r["row"], []).append((r["at"], r["n"], bytes(r["digest"]), r["chrom_id"]))
        self.rows = np.array(sorted(known), np.int64)
        pieces = [sorted(known[k]) for k in self.rows.tolist()]
        self.ids = np.array([p[0][3] for p in pieces], np.int64)
        widths = {sum(n for _, n, _, _ in p) for p in pieces}
        if len(widths) > 1:
            raise ValueError("chromosomes of different lengths")
        self.d = widths.pop() if widths else 0
        if len(self.rows) * self.d > MAX_POPULATION_BITS * bits_per_byte:
            raise ValueError(f"population of {len(self.rows) * self.d} bits exceeds MAX_POPULATION_BITS")
        self.keys = [b"".join(h for _, _, h, _ in p) for p in pieces]

    def distinct(self) -> tuple[Pieces, np.ndarray]:
        """The different chromosomes, in the order of their first rows, and the place of every row among them."""
        first: dict = {}
        inverse = np.array([first.setdefault(k, len(first)) for k in self.keys])
        uniq = object.__new__(Pieces)
        at = np.unique(inverse, return_index=True)[1]
        uniq.table, uniq.d, uniq.rows, uniq.ids, uniq.keys = self.table, self.d, self.rows[at], self.ids[at], list(first)
        return uniq, inverse

    def __len__(self) -> int:
        return len(self.rows)

    def part(self, lo: int, hi: int) -> np.ndarray:
        """Bits (P, hi - lo) of genes ``lo`` to ``hi``; ``lo`` begins a piece."""
        place = {int(r): i for i, r in enumerate(self.rows)}
        out = np.zeros((len(self.rows), hi - lo), np.int8)
        got = self.table.where((F.col("at") >= lo // PIECE) & (F.col("at") * PIECE < hi)).select("row", "at", "n", "packed").toArrow()
        for row, at, n, packed in zip(got["row"].to_pylist(), got["at"].to_pylist(), got["n"].to_pylist(), got["packed"], strict=True):
            if row in place:
                start = at * PIECE - lo
                piece = np.unpackbits(np.frombuffer(packed.as_buffer(), np.uint8), count=n)[: hi - lo - start]
                out[place[row], start : start + len(piece)] = piece
        return out


def rank(scored: DataFrame, score: str = "score") -> DataFrame:
    """Total order: score descending, null last, then chrom_id ascending."""
    w = Window.orderBy(F.col(score).desc_nulls_last(), F.col("chrom_id").asc())
    return scored.withColumn("rank", F.row_number().over(w))


def select_top(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """Truncation selection: the best ``k``."""
    return rank(scored, score).where(F.col("rank") <= k)


def next_generation(scored: DataFrame, n_chromosomes: int, n_genes: int, generation: int, seed: int = 0,
                    crossover: str = "onepoint", mutation_rate: float = 0.2, elitism: int = 2,
                    score: str = "score") -> DataFrame:
    """Elites + crossover children + mutated survivors.

    ``generation`` is the number of the generation being produced; it keys
    every draw. Survivors are the best ``K = n div 2``; children fill slots
    ``elitism .. K-1`` from two parents drawn with replacement among them;
    mutants (of all survivors, elites included) fill slots ``K .. 2K-1``.
    """
    k = n_chromosomes // 2
    if not 0 <= elitism <= k:
        raise ValueError(f"elitism must be within 0..{k} for a population of {n_chromosomes}")
    surv = select_top(scored, k, score).select("rank", "genes")
    elites = surv.where(F.col("rank") <= elitism).select(
        (F.col("rank") - 1).cast("bigint").alias("chrom_id"), "genes"
    )
    slot = F.col("id")
    mates = F.broadcast(  # P-bounded
        surv.sparkSession.range(elitism, k).select(
            slot.alias("chrom_id"),
            (u32(seed, "mate1", generation, slot) % k + 1).alias("p1"),
            (u32(seed, "mate2", generation, slot) % k + 1).alias("p2"),
        )
    )
    s1 = F.broadcast(surv.select(F.col("rank").alias("p1"), F.col("genes").alias("g1")))
    s2 = F.broadcast(surv.select(F.col("rank").alias("p2"), F.col("genes").alias("g2")))
    children = mates.join(s1, "p1").join(s2, "p2").select(
        "chrom_id", bits.crossover(F.col("g1"), F.col("g2"), n_genes, crossover).alias("genes")
    )
    new_id = (F.col("rank") + k - 1).cast("bigint")
    mutants = surv.select(
        new_id.alias("chrom_id"), bits.mutate(F.col("genes"), mutation_rate, seed, generation, new_id).alias("genes")
    )
    return elites.unionByName(children).unionByName(mutants)


def mating(scored: DataFrame, n_chromosomes: int, n_genes: int, generation: int, seed: int = 0,
           crossover: str = "onepoint", elitism: int = 2, score: str = "score") -> DataFrame:
    """The crossover branch alone with its parent ranks."""
    k = n_chromosomes // 2
    surv = select_top(scored, k, score).select("rank", "genes")
    slot = F.col("id")
    mates = surv.sparkSession.range(elitism, k).select(
        slot.alias("chrom_id"),
        (u32(seed, "mate1", generation, slot) % k + 1).alias("p1"),
        (u32(seed, "mate2", generation, slot) % k + 1).alias("p2"),
    )
    s1 = F.broadcast(surv.select(F.col("rank").alias("p1"), F.col("genes").alias("g1")))
    s2 = F.broadcast(surv.select(F.col("rank").alias("p2"), F.col("genes").alias("g2")))
    return mates.join(s1, "p1").join(s2, "p2").select(
        "chrom_id", "p1", "p2", bits.crossover(F.col("g1"), F.col("g2"), n_genes, crossover).alias("genes")
    )


def mutate(pop: DataFrame, rate: float, generation: int, seed: int = 0) -> DataFrame:
    return pop.select("chrom_id", bits.mutate(F.col("genes"), rate, seed, generation, F.col("chrom_id")).alias("genes"))


def diversity(pop: DataFrame) -> DataFrame:
    """Number of distinct chromosomes."""
    return pop.select(F.countDistinct("genes").alias("n_distinct"))


def drift(before: DataFrame, after: DataFrame, n_genes: int) -> DataFrame:
    """Fraction of genes changed, keyed by chrom_id."""
    j = before.select("chrom_id", F.col("genes").alias("a")).join(
        after.select("chrom_id", F.col("genes").alias("b")), "chrom_id"
    )
    return changed(j, n_genes)


def changed(pairs: DataFrame, n_genes: int) -> DataFrame:
    """Fraction of genes that differ between ``a`` and ``b`` over all rows."""
    return pairs.select(
        (F.sum(bits.hamming(F.col("a"), F.col("b"))) / (F.count(F.lit(1)) * n_genes)).alias("changed_fraction")
    )
