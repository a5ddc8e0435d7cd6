"""Population-wide boosted trees against a plain recursive version."""

import numpy as np
import pytest

from featsearch.operators import fitness
from featsearch.operators import models
from featsearch.operators import population as P
from featsearch.operators.models import exact
from featsearch.operators.models.trees import UNIT, TreesModel, best_splits, cuts_of
from pyspark.sql import functions as F


def _rows(n=400, d=5, seed=4):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, d)), 3)
    x[:, 4] = r.integers(0, 2, n)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > -0.2)) | (r.random(n) < 0.05)
    split = np.where(np.arange(n) % 4 == 0, "val", "train")
    return [(i, int(y[i]), str(split[i]), [float(v) for v in x[i]]) for i in range(n)]


def _frame(spark, rows, parts):
    return spark.createDataFrame(rows, "row_id long, y long, split string, features array<double>").repartition(parts)


def _plain(codes, y, train, genes, model):
    """Margins of all rows after ``model.trees`` trees fitted on ``train`` rows."""
    margin = np.zeros(len(y))
    for _ in range(model.trees if len(genes) else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = np.rint((p - y) * 2.0**UNIT), np.rint(p * (1 - p) * 2.0**UNIT)
        g, h = g.astype(np.int64), h.astype(np.int64)
        value = np.zeros(len(y))
        # the other rows follow the splits of the training rows
        _follow(codes, g, h, np.flatnonzero(train), np.flatnonzero(~train), genes, model, value)
        margin = margin + value
    return margin


def _follow(codes, g, h, rows, others, genes, model, value, depth=None):
    depth = model.depth if depth is None else depth
    scale = 2.0**-UNIT
    G, H, best = g[rows].sum(), h[rows].sum(), None

    def worth(a, b):
        return (a * scale) ** 2 / (b * scale + model.l2)

    for j in genes if depth else ():
        for b in range(model.bins):
            left = codes[rows, j] <= b
            lg, lh = g[rows[left]].sum(), h[rows[left]].sum()
            if lh * scale >= model.least and (H - lh) * scale >= model.least:
                gain = worth(lg, lh) + worth(G - lg, H - lh) - worth(G, H)
                if gain > 1e-9 and (best is None or gain > best[0]):
                    best = (gain, j, b)
    if best is None:
        value[rows] = value[others] = -model.step * (G * scale) / (H * scale + model.l2)
        return
    _, j, b = best
    for take in (lambda c: c <= b, lambda c: c > b):
        _follow(codes, g, h, rows[take(codes[rows, j])], others[take(codes[others, j])], genes, model, value, depth - 1)


BITS = np.array([[1, 1, 1, 1, 1], [1, 0, 0, 0, 1], [0, 0, 0, 0, 0], [1, 1, 0, 0, 0], [0, 0, 1, 1, 0]], np.int8)


def _small(**kw):
    return TreesModel(**{"trees": 5, "depth": 3, "bins": 8, "store_every": 2, **kw})


def test_equals_plain_trees_for_any_partitioning(spark):
    rows = _rows()
    x, y = np.array([r[3] for r in rows]), np.array([r[1] for r in rows])
    train = np.array([r[2] == "train" for r in rows])
    found = []
    for parts, cells in ((1, 10**7), (7, 10**7), (3, 100)):
        df, model = _frame(spark, rows, parts), _small(max_cells=cells)
        cuts = cuts_of(df.where("split = 'train'"), 5, model.bins)
        got = {r.chrom_id: (r.tp, r.fp, r.fn, r.tn) for r in model.confusion(df, np.arange(5) + 10, BITS).collect()}
        if cells > 1000:
            assert model.passes <= model.trees * model.depth
        found.append(got)
    assert found[0] == found[1] == found[2]
    assert all(0 < len(c) < 8 for c in cuts)
    codes = np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)], axis=1)
    for k, bits in enumerate(BITS):
        said = _plain(codes, y, train, np.flatnonzero(bits), model) > 0
        of = [int(((y == a) & (said == b) & ~train).sum()) for a, b in ((1, 1), (0, 1), (1, 0), (0, 0))]
        assert found[0][10 + k] == tuple(of)
    assert found[0][13][0] + found[0][13][3] > 85  # the planted pair, of 100


def test_population_equals_single_fits_and_folds(spark):
    df = _frame(spark, _rows(), 3)
    together = _small().confusion(df, np.arange(5), BITS).collect()
    alone = [r for k in (0, 4) for r in _small().confusion(df, np.array([k]), BITS[k : k + 1]).collect()]
    assert {tuple(r) for r in alone} <= {tuple(r) for r in together}
    cv = _small(trees=3).cv_confusion(df, np.array([3, 1]), BITS[[3, 1]], folds=3, seed=1).collect()
    assert sorted((r.fold, r.chrom_id) for r in cv) == [(f, k) for f in range(3) for k in (1, 3)]
    from featsearch.operators.split import fold_of

    for fold in range(3):
        own = df.where("split = 'train'").withColumn("split", F.when(fold_of(df, 3, 1) == fold, "val").otherwise("train"))
        train = own.where("split = 'train'")
        model = _small(trees=3)
        # cut points come from all training rows, as in the shared fit
        coded, _ = model._coded_rows(df.where("split = 'train'"), 5, {"train"}, fold_of(df, 3, 1))
        forest = model.fit_rows(coded.where(F.col("fold") != fold), BITS[[3, 1]])
        direct = model._counts(coded.where(F.col("fold") == fold), np.array([3, 1]), forest, 5, "split", None).collect()
        assert train.count() and {(r.chrom_id, r.tp, r.fp, r.fn, r.tn) for r in direct} == {
            (r.chrom_id, r.tp, r.fp, r.fn, r.tn) for r in cv if r.fold == fold
        }


def test_best_split_ties_and_exact_sums():
    g = np.array([[[4, -4], [4, -4]]]) << UNIT
    h = np.full((1, 2, 2), 2) << UNIT
    place, cut, left_g, left_h, all_g, all_h = best_splits(np.concatenate([g.ravel(), h.ravel()]), 2, 2, 1.0, 1.0)[0]
    assert (place, cut, left_g >> UNIT, left_h >> UNIT, all_g, all_h >> UNIT) == (0, 0, 4, 2, 0, 4)
    assert best_splits(np.concatenate([g.ravel(), h.ravel()]), 2, 2, 1.0, 3.0)[0][1] == -1  # children too small
    r = np.random.default_rng(0)
    a, b = r.integers(-(2**30), 2**30, (5000, 3)), r.integers(-(2**20), 2**20, (5000, 2))
    assert (exact.product(a.astype(float), b.astype(float)) == a.T @ b).all()
    with pytest.raises(OverflowError):
        exact.product(np.array([[2.0**40]]), np.array([[2.0**20]]))


def test_registry_and_scores(spark):
    df = _frame(spark, _rows(200), 2)
    model = models.get("xgboost", trees=2, depth=2)
    assert isinstance(model, TreesModel) and models.get("gbt").trees == 100
    pop = P.from_rows(spark, [(0, [1, 1, 0, 0, 0]), (1, [0] * 5), (2, [1, 1, 0, 0, 0])])
    got = {r.chrom_id: r.score for r in fitness.score(df, pop, model, "accuracy").collect()}
    assert got[1] is None and got[0] == got[2] > 0.5
    assert not model.payloads or model.release() is None
