"""Concurrent grid runs and the stored score table."""

import numpy as np
import pytest

from featsearch.config import SearchConfig
from featsearch.operators.models.centroid import CentroidModel
from featsearch.plans import grid, search
from featsearch.sources import abt as A
from featsearch.sources.scores import ScoreTable, fingerprint, model_key, packed
from featsearch.sources.store import RunStore
from conftest import SF001


@pytest.fixture(scope="module")
def abts(spark):
    return {n: A.load(spark, SF001, n, path=search.shared_path(spark, "abt")) for n in ("orders", "lineitem")}


def _options(**kw):
    return dict(grid.FULL_GRID, dataset=["orders", "lineitem"], model=["centroid"], population_size=[6], max_generation=[2], **kw)


def test_concurrent_equals_sequential_and_resumes(spark, abts, tmp_path):
    df = grid.grid(spark, _options(algorithm=["ga_seq", "random"]))
    store = RunStore(spark, str(tmp_path / "runs"))
    many = grid.run_grid(spark, abts, df, store, workers=4)
    assert len(many) == 4 and all(r.error is None and not r.skipped for r in many)
    for r in many:
        alone = search.run(spark, abts[r.config.dataset], SearchConfig(**{o: getattr(r.config, o) for o in grid.OPTIONS}))
        assert alone.best_genes == r.result.best_genes and alone.test == r.result.test
        assert [h["best"] for h in alone.history] == [h["best"] for h in r.result.history]
    assert store.configs().count() == store.test_metrics().count() == 4
    again = grid.run_grid(spark, abts, df, store, workers=4)
    assert all(r.skipped for r in again) and store.configs().count() == 4


def test_failing_row_is_reported_and_the_rest_finishes(spark, abts, tmp_path):
    broken = A.Abt(abts["orders"].df.drop("features"), abts["orders"].names)
    df = grid.grid(spark, _options(algorithm=["baseline_metrics", "random"]))
    store = RunStore(spark, str(tmp_path / "runs"))
    runs = grid.run_grid(spark, {"orders": broken, "lineitem": abts["lineitem"]}, df, store, workers=3)
    assert [r.config.dataset for r in runs if r.error is not None] == ["orders"] * 2
    assert store.test_metrics().count() == 2
    mended = grid.run_grid(spark, abts, df, store, workers=3)
    assert all(r.error is None for r in mended) and sum(r.skipped for r in mended) == 2
    assert store.test_metrics().count() == 4


class Counting(CentroidModel):
    fits = 0

    def confusion(self, abt, ids, bits, eval_splits=("val",)):
        if eval_splits == ("val",):
            Counting.fits += len(ids)
        return super().confusion(abt, ids, bits, eval_splits)


def test_score_table_spares_fits(spark, abts, tmp_path):
    cfg = dict(dataset="lineitem", algorithm="ga_seq", model="centroid", metric="f1", population_size=12, max_generation=3, stopping_threshold=2.0)
    table = ScoreTable(spark, str(tmp_path / "scores"))
    plain = search.run(spark, abts["lineitem"], SearchConfig(**cfg), model=Counting())
    Counting.fits = 0
    first = search.run(spark, abts["lineitem"], SearchConfig(**cfg), model=Counting(), scores=table)
    assert Counting.fits == first.scored == table.read().count() > 0
    Counting.fits = 0
    small = table.compact(str(tmp_path / "compacted"))
    again = search.run(spark, abts["lineitem"], SearchConfig(**cfg), model=Counting(), scores=small)
    assert Counting.fits == again.scored == 0
    for r in (first, again):
        assert r.best_genes == plain.best_genes and r.test == plain.test
        assert [h["avg"] for h in r.history] == [h["avg"] for h in plain.history]
    other = search.run(spark, abts["orders"], SearchConfig(**{**cfg, "dataset": "orders"}), model=Counting(), scores=small)
    assert other.scored > 0  # another dataset shares nothing


def test_fingerprint_and_keys(spark, abts):
    df = abts["orders"].df
    assert fingerprint(df) == fingerprint(df.repartition(5).select(*reversed(df.columns)))
    assert fingerprint(df) != fingerprint(df.where("row_id <> 1"))
    assert model_key(CentroidModel()) != model_key(CentroidModel(fit_split="val"))
    assert packed(np.array([1, 0], np.int8)) != packed(np.array([1, 0, 0], np.int8))
