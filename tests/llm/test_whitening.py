"""Whitening: exact statistics against Fractions, components against NumPy."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from featsearch.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def _rows(n=300, d=6, seed=3):
    r = random.Random(seed)
    mix = [[r.gauss(0, 1) for _ in range(d)] for _ in range(d)]
    rows = []
    for i in range(n):
        z = [r.gauss(0, 1) for _ in range(d)]
        rows.append((i, [float(np.float32(sum(a * b for a, b in zip(m, z)))) for m in mix], 0))
    return rows + [rows[0], (None, rows[1][1], 1)]


BAD = [(900, None, 1), (901, [], 1), (902, [1.0, None] * 3, 1), (903, [math.nan] + [0.0] * 5, 1), (904, [-math.inf] + [0.0] * 5, 1)]


def _frame(spark, rows):
    clash = ("id", "vector", "n", "d", "i", "component", "whitened")
    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit(c) for c in clash})


def _integers(rows):
    return [[math.floor(1024 * c) + 100000 for c in v] for _, v, _ in rows]


def test_against_exact(spark):
    rows = _rows()
    x = _integers(rows)
    n, d = len(x), len(x[0])
    model = whitening.fit(whitening.usable(_frame(spark, rows + BAD)))
    assert model.n == n and list(model.sums) == [sum(c) for c in zip(*x)]
    mean = [Fraction(s, n) for s in model.sums]
    for i in range(d):
        for j in range(d):
            exact = sum((a[i] - mean[i]) * (a[j] - mean[j]) for a in x) / n
            assert model.covariance[i, j] == float(exact)
    assert (np.diff(model.values) <= 0).all()
    got = whitening.whiten(_frame(spark, rows + BAD), components=4).collect()
    assert len(got) == 4 * n and {r.n for r in got} == {n}
    deviation = {str(r[0]): sum((n * a - s) ** 2 for a, s in zip(v, model.sums)) for r, v in zip(rows, x)}
    of_row = {}
    for r in got:
        assert int(r.deviation) == deviation[str(r.id)] and r.identity_error <= 1e-9
        of_row.setdefault(str(r.id), {})[r.component] = r.whitened
        assert r.explained == pytest.approx(model.values[r.component - 1] / np.trace(model.covariance))
    w = np.array([[of_row[str(r[0])][k] for k in range(1, 5)] for r in rows])
    assert np.abs(np.cov(w.T, bias=True) - np.eye(4)).max() < 1e-9
    basis = np.linalg.eigh(np.cov(np.array(x, float).T, bias=True))[1][:, ::-1][:, :4]
    assert np.abs(np.abs((basis * model.vectors[:, :4]).sum(axis=0)) - 1).max() < 1e-6


def test_large_entries_stay_exact(spark):
    r = random.Random(1)
    rows = [(i, [float(r.randrange(-(1 << 34), 1 << 34)), float(r.randrange(9))], 0) for i in range(50)]
    x = _integers([(i, [float(np.float32(c)) for c in v], 0) for i, v, _ in rows])
    n = len(x)
    model = whitening.fit(whitening.usable(_frame(spark, rows)))
    assert list(model.sums) == [sum(c) for c in zip(*x)]
    exact = Fraction(sum((n * a[0] - model.sums[0]) ** 2 for a in x), n**3)
    assert model.covariance[0, 0] == float(exact)
    got = {r.id: int(r.deviation) for r in whitening.whiten(_frame(spark, rows)).collect()}
    assert got == {i: sum((n * a - s) ** 2 for a, s in zip(v, model.sums)) for i, v in enumerate(x)}
    with pytest.raises(Exception, match="2\\^40"):
        whitening.fit(whitening.usable(_frame(spark, [(1, [1e30], 0)])))


def test_empty_constant_and_ragged(spark):
    assert whitening.whiten(_frame(spark, BAD)).collect() == []
    got = whitening.whiten(_frame(spark, [(i, [float(i), 2.0], 0) for i in range(4)])).collect()
    assert {r.whitened for r in got if r.component == 2} == {0.0} and {r.identity_error < 1e-9 for r in got} == {True}
    alone = whitening.whiten(_frame(spark, [(7, [1.0, 2.0], 0)])).collect()
    assert [(r.component, r.whitened, r.explained, r.deviation) for r in alone] == [(1, 0, 0, 0), (2, 0, 0, 0)]
    with pytest.raises(Exception, match="lengths"):
        whitening.fit(whitening.usable(_frame(spark, [(1, [1.0], 0), (2, [1.0, 2.0], 0)])))


def test_query(spark):
    got = queries.op13_whitening(spark, "/root/testdata/sf0.001")
    assert got.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert dict(got.dtypes)["deviation"] == "bigint" and dict(got.dtypes)["n"] == "bigint"
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    x = np.array(_integers([(r.vec_id, r.embedding, 0) for r in rows]), float)
    values, basis = np.linalg.eigh(np.cov(x.T, bias=True))
    want = (x - x.mean(axis=0)) @ basis[:, ::-1][:, :8] / np.sqrt(values[::-1][:8])
    at = {r.vec_id: k for k, r in enumerate(rows)}
    out = np.zeros_like(want)
    for r in got.collect():
        out[at[r.vec_id], r.component - 1] = r.whitened
    assert np.abs(np.abs(out) - np.abs(want)).max() < 1e-6
