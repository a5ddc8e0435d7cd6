"""Sparse feature blocks and the centroid model over them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from featsearch.operators import fitness, population as popops, sparse
from featsearch.operators.models import get
from featsearch.operators.models import sparse as model
from featsearch.plans import search
from featsearch.sources import abt as A
from featsearch.sources.tables import table
from conftest import SF001


def _orders(spark):
    return table(spark, SF001, "orders").select(
        F.col("o_orderkey").alias("row_id"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), "o_totalprice",
        F.month("o_orderdate").cast("double").alias("order_month"), "o_orderpriority",
    )


def test_equals_dense_path(spark, monkeypatch):
    dense = A.load(spark, SF001, "orders")
    rows, names, d = sparse.features(_orders(spark), ["o_totalprice", "order_month"], ["o_orderpriority"])
    assert d == dense.d and [r["feature"] for r in names.orderBy("gene").collect()] == dense.names
    ab = sparse.build(rows.select("row_id", "y", "indices", "values"), d, search.shared_path(spark, "sparse"))
    assert ab.d == d
    pop = popops.init(spark, 40, d, 3)
    want = {r["chrom_id"]: r[1:] for r in fitness.confusion(dense.df, pop, get("centroid"), ("val",)).select("chrom_id", "tp", "fp", "fn", "tn").collect()}
    for cells in (model.CELLS, 1):  # 1: every entry a block of its own
        monkeypatch.setattr(model, "CELLS", cells)
        got = fitness.confusion(ab.df, pop, get("sparse_centroid"), ("val",)).select("chrom_id", "tp", "fp", "fn", "tn")
        assert {r["chrom_id"]: r[1:] for r in got.collect()} == want


def test_moments_against_numpy(spark):
    rng = np.random.default_rng(4)
    x = np.where(rng.random((300, 6)) < 0.3, rng.normal(1e6, 3.0, (300, 6)), 0.0)
    x[:, 4], x[:, 5] = 0.0, 7.0
    rows = [([int(j) for j in np.flatnonzero(r)], [float(v) for v in r[r != 0]]) for r in x]
    df = spark.createDataFrame(rows, "indices array<int>, values array<double>").repartition(5)
    mean, sd = model.moments(df, 6)
    assert np.allclose(mean, x.mean(0), rtol=1e-12)
    assert np.allclose(sd, np.where(x.std(0) == 0, 1.0, x.std(0)), rtol=1e-9)


def test_nulls_and_empty_rows(spark):
    df = spark.createDataFrame([(1, 0, 0.0, None), (2, 1, 2.0, "b"), (3, 0, 0.0, "a")], "row_id long, y int, v double, c string")
    rows, names, d = sparse.features(df, ["v"], ["c"])
    got = {r["row_id"]: (r["indices"], r["values"]) for r in rows.collect()}
    assert d == 3 and got == {1: ([], []), 2: ([0, 2], [2.0, 1.0]), 3: ([1], [1.0])}
    assert [r["feature"] for r in names.orderBy("gene").collect()] == ["v", "c_a", "c_b"]
    bad = spark.createDataFrame([(1, 0, None, "a")], "row_id long, y int, v double, c string")
    with pytest.raises(Exception, match="null feature value"):
        sparse.features(bad, ["v"], ["c"])[0].collect()


def test_hundred_thousand_levels(spark):
    """A width no dense array could hold per row is prepared, split and searched."""
    n = 120_000
    df = spark.range(n).select(
        F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("y"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("p"), F.col("id") % 2)).otherwise(F.concat(F.lit("l"), F.col("id"))).alias("c"),
    )
    rows, _, d = sparse.features(df, [], ["c"])
    assert d == 80_002
    ab = sparse.build(rows.select("row_id", "y", "indices", "values"), d, search.shared_path(spark, "sparse"))
    assert ab.df.selectExpr("max(size(indices))").first()[0] == 1
    genes = np.ones((2, d), np.int8)
    genes[1, -2:] = 0  # without the two planted levels
    conf = {r["chrom_id"]: r for r in get("sparse_centroid").confusion(ab.df, np.arange(2), genes, ("val",)).collect()}
    planted = ab.df.where("split = 'val' and indices[0] >= 80000").count()
    # the planted levels tell the class; a level met once tells nothing
    assert conf[0]["tp"] + conf[0]["tn"] >= planted > 0
    assert conf[0]["tp"] + conf[0]["tn"] > conf[1]["tp"] + conf[1]["tn"]


def test_driver_reads_a_wide_population_by_ranges(spark, monkeypatch):
    """No step holds all genes of all chromosomes on the driver; results are those of one range."""
    n, d, p, shipped = 300, 700, 40, []
    r = np.random.default_rng(6)
    genes = np.sort(np.stack([r.choice(d, 5, replace=False) for _ in range(n)]), axis=1)
    rows = [(i, i % 2, ("train", "val")[i % 3 == 0], [int(g) for g in genes[i]], [float(v) for v in r.normal(size=5)]) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id long, y int, split string, indices array<int>, values array<double>").repartition(4).localCheckpoint()
    mat = r.integers(0, 2, (p, d)).astype(np.int8)
    mat[7], mat[9] = mat[3], 0  # a duplicate and an empty chromosome
    pop = popops.from_rows(spark, [(i + 5, row.tolist()) for i, row in enumerate(mat)])
    want = {c.chrom_id + 5: tuple(c)[2:] for c in get("sparse_centroid").confusion(df, np.arange(p), mat).collect()}

    class Recorded(model.Payload):
        def __init__(self, spark, value, nbytes):
            shipped.append(nbytes)
            super().__init__(spark, value, nbytes)

    def whole(*args, **kw):
        raise AssertionError("the whole population on the driver")

    monkeypatch.setattr(model, "Payload", Recorded)
    monkeypatch.setattr(popops, "to_matrix", whole)
    monkeypatch.setattr(popops, "PIECE", 64)
    monkeypatch.setattr(model, "RANGE", 128)
    scored = fitness.score(df, pop, get("sparse_centroid"), "f1").collect()
    assert {c.chrom_id: (c.tp, c.fp, c.fn, c.tn) for c in scored} == want and len(scored) == p
    assert [c.score is None for c in scored].count(True) == 1 and all(list(c.genes) == mat[c.chrom_id - 5].tolist() for c in scored)
    assert max(shipped) <= 128 * 48 and len(shipped) == 2 * 6 + 1
    known = popops.Pieces(pop, 8)
    assert (known.part(0, d) == mat).all() and (known.part(640, 700) == mat[:, 640:]).all()
    uniq, inverse = known.distinct()
    assert len(uniq) == p - 1 and (uniq.part(0, d)[inverse] == mat).all()
    monkeypatch.setattr(popops, "MAX_POPULATION_BITS", 100)
    with pytest.raises(ValueError, match="exceeds"):
        popops.Pieces(pop, 8)
    with pytest.raises(ValueError, match="different lengths"):
        popops.Pieces(popops.from_rows(spark, [(0, [1, 0]), (1, [1])]), 8)
