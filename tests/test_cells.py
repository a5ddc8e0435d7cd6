"""Fits in one task over distinct inputs: the same as passes over the rows, without them."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from featsearch.operators.models import cells, exact, mlp
from featsearch.operators.models.logistic import LogisticModel
from featsearch.operators.models.mlp import MlpModel
from featsearch.session import Payload
from test_trees import _frame, _rows

BITS = np.array([[1, 1, 1, 1, 1], [1, 0, 0, 0, 1], [0, 0, 0, 0, 0], [1, 1, 0, 0, 0], [0, 0, 1, 0, 0]], np.int8)


def _no_pass(*args, **kw):
    raise AssertionError("a pass over the rows")


def _folded(spark, parts=3):
    from featsearch.operators.split import fold_of

    df = _frame(spark, _rows(200), parts)
    return df.where("split = 'train'").select(fold_of(df, 3, 2).alias("fold"), "y", "features")


def test_weighted_product_is_that_of_repeated_rows():
    r = np.random.default_rng(0)
    left, right = r.integers(-9, 9, (50, 3)).astype(float), r.integers(-9, 9, (50, 4)).astype(float)
    weight = r.integers(0, 9000, 50)
    want = np.repeat(left, weight, axis=0).T @ np.repeat(right, weight, axis=0)
    assert (exact.weighted(left, weight[:, None], right) == want).all()
    assert (exact.weighted(left, weight[:, None], right, 9.0) == want).all()
    large = exact.weighted(np.array([[2.0**30]]), np.array([[1 << 25]]), np.array([[64.0]]))  # beyond what a double holds exactly
    assert large.tolist() == [[1 << 61]] and (exact.weighted(left, 0 * weight[:, None], right) == 0).all()


@pytest.mark.parametrize("chunk", [cells.CHUNK, 7])
def test_cells_of_every_set_and_fold(spark, monkeypatch, chunk):
    monkeypatch.setattr(cells, "CHUNK", chunk)
    r = np.random.default_rng(3)
    rows = [(int(r.integers(2)), int(r.integers(3)), [float(v) for v in (r.integers(-2, 3), r.normal(), 5.0)]) for _ in range(150)]
    df = spark.createDataFrame(rows, "y int, fold int, features array<double>").repartition(4)
    bits = np.array([[1, 0, 0], [1, 1, 0], [1, 0, 0], [0, 0, 0], [1, 0, 1]], np.int8)
    excl = np.array([0, 1, 2, 1, 0])

    def told(c, problems, left_out):
        found = [(tuple(x.tolist()), int(y)) for x, y in zip(c.x, c.y)]
        assert len(set(found)) == len(found)
        return [repr(sorted((*f, int(n)) for f, n in zip(found, w) if n)).encode() for w in c.weights(left_out).T]

    got = cells.fitted(df, bits, excl, 4, told)
    for k, (b, out) in enumerate(zip(bits, excl)):
        want: dict = {}
        for y, fold, x in rows:
            if fold != out:
                key = (tuple(int(np.rint(v * 16)) for v, on in zip(x, b) if on), y)
                want[key] = want.get(key, 0) + 1
        assert eval(got[k]) == sorted((*key, n) for key, n in want.items())


def test_estimates_and_what_is_left_to_passes(spark, monkeypatch):
    df = spark.range(20_000).select((F.col("id") % 2).cast("int").alias("y"), F.array(F.col("id").cast("double"), (F.col("id") % 3).cast("double")).alias("features"))
    size = cells.estimated(df, 2, np.array([0, 1]), [np.array([0]), np.array([1]), np.array([], int)], 0)
    assert abs(size[0] - 20_000) < 6_000 and size[1:].tolist() == [6, 2]
    bits = np.array([[1, 0], [0, 1], [0, 0]], np.int8)
    monkeypatch.setattr(cells, "BYTES", 1000)
    assert sorted(cells.fitted(df, bits, None, 0, lambda c, ks, out: [b""] * len(ks))) == [1, 2]
    wide = df.select("y", (F.transform("features", lambda v: v * 1e9)).alias("features"))
    assert cells.fitted(wide, bits, None, 0, _no_pass) == {}  # inputs beyond 32 bits


def test_logistic_folds_fit_without_passes(spark, monkeypatch):
    rows, bits, excl = _folded(spark), np.repeat(BITS, 3, axis=0), np.tile(np.arange(3), len(BITS))
    with monkeypatch.context() as m:
        m.setattr(LogisticModel, "_pass", _no_pass)
        here = LogisticModel()
        got = here._fit_rows(rows, bits, None, excl)
    with monkeypatch.context() as m:
        m.setattr(cells, "GENES", -1)
        passes = LogisticModel()
        want = passes._fit_rows(rows, bits, None, excl)
    assert (got == want).all() and (here.certificate == passes.certificate).all() and here.iterations == passes.iterations
    monkeypatch.setattr(cells, "GENES", 2)  # some of the problems in tasks, some by passes
    mixed = LogisticModel()
    assert (mixed._fit_rows(rows, bits, None, excl) == want).all() and mixed.converged.all() == here.converged.all()


def test_perceptrons_fit_without_passes(spark, monkeypatch):
    rows, bits, excl = _folded(spark), np.repeat(BITS, 3, axis=0), np.tile(np.arange(3), len(BITS))
    small = {"hidden": 12, "max_iter": 8}
    with monkeypatch.context() as m:
        m.setattr(MlpModel, "_pass", _no_pass)
        here = MlpModel(**small)
        got = here.fit_rows(rows, bits, excl)
    with monkeypatch.context() as m:
        m.setattr(cells, "GENES", -1)
        passes = MlpModel(**small)
        want = passes.fit_rows(rows, bits, excl)
    assert (got == want).all() and (here.converged == passes.converged).all() and here.passes == passes.passes
    monkeypatch.setattr(cells, "GENES", 2)  # some of the problems in tasks, some by passes
    assert (MlpModel(**small).fit_rows(rows, bits, excl) == want).all()


def test_a_perceptron_pass_over_cells_is_one_over_rows(spark):
    """Totals of heavy cells, far more rows than are summed at a time, as of the rows themselves."""
    r = np.random.default_rng(5)
    x, y, n = r.integers(-9000, 9000, (1100, 2)), r.integers(0, 2, 1100), r.integers(1, 4, 1100)
    n[7] = 5000
    stack, problems = mlp.Stack(3, 6), np.zeros(1, np.int64)
    theta = r.normal(size=(1, stack.size))
    theta[0, 6:12] = 0.0  # gene 1 is missing
    c = cells.Cells(np.array([0, 2]), x.astype(np.int32), y, n, np.zeros(0, int), np.zeros((1100, 0), int))
    wide = np.zeros((n.sum(), 3))
    wide[:, [0, 2]] = np.repeat(x, n, axis=0) / 2.0**mlp.VALUE
    batch = pa.RecordBatch.from_arrays([pa.array(list(wide)), pa.array(np.repeat(y, n))], ["features", "y"])
    out = [*mlp._pass_task(Payload(spark, (problems, theta, None), 0), stack)([batch])][0]
    want = np.frombuffer(out.column("v")[0].as_py(), np.int64).copy()
    want[2 + 6 : 2 + 12] = 0
    assert (mlp.cell_totals(c, n, stack, theta[0]) == want).all()
