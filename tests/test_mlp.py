"""Population-wide perceptron: gradients, reproducibility, single fits, folds."""

import numpy as np
from pyspark.sql import functions as F

from featsearch.operators import models
from featsearch.operators.models import mlp
from featsearch.operators.models.mlp import MlpModel, Stack
from test_trees import _frame, _rows

BITS = np.array([[1, 1, 1, 1, 1], [1, 0, 0, 0, 1], [0, 0, 0, 0, 0], [1, 1, 0, 0, 0]], np.int8)


def _small(**kw):
    return MlpModel(**{"hidden": 12, "max_iter": 25, **kw})


def test_gradient_is_that_of_the_loss(spark):
    df = _frame(spark, _rows(120), 2).where("split = 'train'").select("y", "features")
    model, stack = _small(alpha=0.5), Stack(5, 12)
    mask = stack.mask(BITS)
    theta = model.start(BITS) * mask
    _, grad = model._pass(df, stack, np.arange(4), theta, mask, None)
    r = np.random.default_rng(0)
    way = r.normal(size=theta.shape) * mask
    size = 1e-3
    up, _ = model._pass(df, stack, np.arange(4), theta + size * way, mask, None)
    down, _ = model._pass(df, stack, np.arange(4), theta - size * way, mask, None)
    slope = (grad * way).sum(axis=1)
    assert np.abs((up - down) / (2 * size) - slope).max() < 2e-2 * (1 + np.abs(slope).max())
    assert (grad[mask == 0] == 0).all()


def test_any_partitioning_and_single_fits_agree(spark):
    rows = _rows()
    found = []
    for parts in (1, 5):
        model = _small()
        found.append(sorted(tuple(r) for r in model.confusion(_frame(spark, rows, parts), np.arange(4), BITS).collect()))
        passes = model.passes
    assert found[0] == found[1]
    by = {r[1]: r for r in found[0]}
    assert by[3][2] + by[3][5] > 85  # the planted pair, of 100
    df = _frame(spark, rows, 3).where("split = 'train'").select("y", "features")
    together = _small().fit_rows(df, BITS)
    split = _small(max_doubles=100)  # the same fits, one problem per pass over the rows
    assert (split.fit_rows(df, BITS) == together).all() and split.passes <= passes + 1
    for k in (0, 3):
        alone = _small()
        assert (alone.fit_rows(df, BITS[k : k + 1]) == together[k]).all()
        assert alone.passes <= passes


def test_folds_do_not_train_their_problem(spark):
    from featsearch.operators.split import fold_of

    df = _frame(spark, _rows(200), 3)
    train = df.where("split = 'train'").select(fold_of(df, 3, 2).alias("fold"), "y", "features")
    both = np.repeat(BITS[[3]], 3, axis=0)
    shared = _small(max_iter=8).fit_rows(train, both, np.arange(3))
    for f in range(3):
        direct = _small(max_iter=8).fit_rows(train.where(F.col("fold") != f), BITS[[3]])
        assert (direct[0] == shared[f]).all()
    cv = _small(max_iter=8).cv_confusion(df, np.array([7]), BITS[[3]], folds=3, seed=2).collect()
    assert sorted(r.fold for r in cv) == [0, 1, 2] and sum(r.tp + r.fp + r.fn + r.tn for r in cv) == train.count()


def test_defaults_and_start():
    model = models.get("mlp")
    assert (model.hidden, model.max_iter, model.alpha) == (100, 200, 1e-4)
    start = model.start(np.ones((2, 5), np.int8))
    assert (start[0] == start[1]).all() and np.abs(start[:, :600]).max() <= np.sqrt(6 / 105)
    assert not np.array_equal(mlp.draws(1, 0, (9,)), mlp.draws(2, 0, (9,)))
