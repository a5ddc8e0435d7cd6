"""Fitness models, drivers and the run store, on small fixtures."""

import numpy as np
import pytest

from featsearch.config import SearchConfig
from featsearch.operators import fitness, population as P
from featsearch.operators.models.centroid import CentroidModel
from featsearch.plans import report as R
from featsearch.plans import search
from featsearch.sources import abt as A
from featsearch.sources.store import RunStore
from conftest import SF001, SF01


@pytest.fixture(scope="module")
def planted(spark):
    return search.materialize(A.load(spark, SF01, "planted"), spark)


def test_config_validation():
    for bad in (dict(algorithm="nope"), dict(model="svm"), dict(metric="recall"), dict(elitism=200, population_size=10),
                dict(crossover="uniform"), dict(mutation_rate=1.5)):
        with pytest.raises(ValueError):
            SearchConfig(**bad).validate()
    assert SearchConfig(algorithm="ga_spark").validate().search == "ga"


def test_centroid_brute_force(spark, planted):
    """Batched Arrow scoring == per-row Python brute force on the same integers."""
    model = CentroidModel()
    ids, mat = P.to_matrix(P.init(spark, 12, planted.d))
    conf = {r["chrom_id"]: r for r in model.confusion(planted.df, ids, mat).collect()}
    m0, m1 = model.means(planted.df)
    rows = planted.df.where("split = 'val'").collect()
    for k, genes in zip(ids, mat):
        tp = fp = 0
        for r in rows:
            q = [int(np.floor(z * 10000)) for z in r["features"]]
            dec = sum(((q[g] - m1[g]) ** 2 - (q[g] - m0[g]) ** 2) for g in range(planted.d) if genes[g])
            if dec < 0:
                tp += r["y"] == 1
                fp += r["y"] == 0
        assert (conf[k]["tp"], conf[k]["fp"]) == (tp, fp)


def test_empty_chromosome_scores_null(spark, planted):
    pop = P.from_rows(spark, [(0, [0] * planted.d), (1, [1] * planted.d)])
    sc = {r["chrom_id"]: r["score"] for r in fitness.score(planted.df, pop, CentroidModel(), "f1").collect()}
    assert sc[0] is None and sc[1] is not None


def test_logistic_matches_mllib(spark, planted):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorSlicer
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    from featsearch.operators.models.logistic import LogisticModel

    ids, mat = P.to_matrix(P.init(spark, 3, planted.d, seed=5))
    theta = LogisticModel(solver="newton").fit(planted.df, mat)
    theta_lbfgs = LogisticModel(solver="lbfgs").fit(planted.df, mat)
    tr = planted.df.where("split = 'train'").select(F.col("y").cast("double").alias("label"), array_to_vector("features").alias("fv"))
    n = tr.count()
    for k in range(3):
        idx = [i for i, b in enumerate(mat[k]) if b]
        sub = VectorSlicer(inputCol="fv", outputCol="features", indices=idx).transform(tr)
        lr = LogisticRegression(regParam=1.0 / n, standardization=False, maxIter=300, tol=1e-10).fit(sub)
        assert np.abs(lr.coefficients.toArray() - theta[k][idx]).max() < 1e-3
        assert abs(lr.intercept - theta[k][-1]) < 1e-3
        assert np.abs(lr.coefficients.toArray() - theta_lbfgs[k][idx]).max() < 2e-2
        assert np.all(theta_lbfgs[k][:-1][mat[k] == 0] == 0)
        assert np.all(theta[k][:-1][mat[k] == 0] == 0)


def test_planted_signal_recovered(spark, planted):
    """The GA finds subsets with the planted genes and beats the baseline."""
    cfg = SearchConfig(dataset="planted", algorithm="ga", model="logistic", metric="f1", population_size=20,
                       max_generation=3, stopping_threshold=0.99999)
    res = search.run(spark, planted, cfg)
    bests = [h["best"] for h in res.history]
    assert all(b2 >= b1 for b1, b2 in zip(bests, bests[1:]))  # elitism: never worse
    assert bests[-1] > res.baseline["val"]
    assert sum(res.best_genes[g] for g in (3, 10, 20)) >= 2


def test_stop_rule_baseline_met(spark, planted):
    cfg = SearchConfig(dataset="planted", algorithm="ga", model="centroid", metric="f1", population_size=6,
                       max_generation=3, stopping_threshold=0.0)
    res = search.run(spark, planted, cfg)
    assert res.status == "baseline_met" and res.history == [] and res.best_genes == [1] * planted.d


def test_generation_count(spark, planted):
    cfg = SearchConfig(dataset="planted", algorithm="ga", model="centroid", metric="f1", population_size=6,
                       max_generation=2, stopping_threshold=0.99999)
    assert [h["gen"] for h in search.run(spark, planted, cfg).history] == [0, 1, 2]


def test_store_and_reports(spark, tmp_path):
    ab = search.materialize(A.load(spark, SF001, "orders"), spark)
    store = RunStore(spark, str(tmp_path / "runs"))
    for alg in ("baseline_metrics", "random", "ga"):
        search.run(spark, ab, SearchConfig(dataset="orders", algorithm=alg, model="centroid", metric="f1",
                                           population_size=6, max_generation=1), store)
    store.write_config(SearchConfig(dataset="orders", algorithm="rfs", model="centroid"))
    c, h, t = store.configs(), store.history(), store.test_metrics()
    assert c.count() == 4 and R.complete_runs(c, h, t).count() == 3
    assert R.with_placeholders(c, h, t).count() == 4
    assert R.history_summary(h).count() == 3
    ov = R.jaccard_overlap(R.compiled(c, h, t)).collect()
    assert len(ov) == 9 and all(r["overlap"] == 1.0 for r in ov if r["algo1"] == r["algo2"])
    sym = {(r["algo1"], r["algo2"]): r["overlap"] for r in ov}
    assert all(sym[(a, b)] == sym[(b, a)] for a, b in sym)
    store.export_csv(str(tmp_path / "csv"))


def test_unknown_model():
    from featsearch.operators import models

    with pytest.raises(ValueError):
        models.get("svm")


def test_score_cache_skips_known_chromosomes(spark, planted):
    model = CentroidModel()
    ids, mat = P.to_matrix(P.init(spark, 8, planted.d))
    cache: dict = {}
    a = fitness.score_rows(planted.df, ids, mat, model, "f1", cache=cache)
    assert len(cache) == len({m.tobytes() for m in mat})
    b = fitness.score_rows(planted.df, ids, mat, model, "f1", cache=cache)  # no new job needed
    assert a == b
    fresh = fitness.score(planted.df, P.from_rows(spark, [(int(i), [int(x) for x in m]) for i, m in zip(ids, mat)]),
                          model, "f1").collect()
    assert {r["chrom_id"]: r["score"] for r in fresh} == {r["chrom_id"]: r["score"] for r in a}


def test_experiment_grid(spark):
    from featsearch.plans import grid as G

    full = G.grid(spark, G.FULL_GRID)
    assert full.count() == 54
    opts = dict(G.FULL_GRID, backend=["processes", "threads"])
    both = G.grid(spark, opts)
    assert both.count() == 54 + 9  # threads only with ga_joblib
    assert both.where("backend = 'threads'").select("algorithm").distinct().collect()[0][0] == "ga_joblib"
    assert len(G.configs(full)) == 54


def test_resume_equals_uninterrupted(spark, tmp_path):
    """Crash a GA while it writes generation 2, resume it: same history as one full run."""
    ab = search.materialize(A.load(spark, SF001, "orders"), spark)
    kw = dict(dataset="orders", algorithm="ga", model="centroid", metric="f1", population_size=8,
              stopping_threshold=0.99999, max_generation=3)
    full = search.run(spark, ab, SearchConfig(**kw), RunStore(spark, str(tmp_path / "a")))

    class Crashing(RunStore):
        calls = 0

        def append_history(self, run_id, rows):
            Crashing.calls += 1
            if Crashing.calls == 3:
                raise RuntimeError("driver lost")
            super().append_history(run_id, rows)

    store = Crashing(spark, str(tmp_path / "b"))
    cfg = SearchConfig(**kw)
    with pytest.raises(RuntimeError):
        search.run(spark, ab, cfg, store)
    assert store.history().count() == 2
    res = search.resume(spark, ab, RunStore(spark, store.root), cfg.run_id)
    key = lambda h: (h["gen"], h["best"], h["worst"], tuple(h["best_genes"]))
    assert [key(h) for h in res.history] == [key(h) for h in full.history]
    assert res.best_genes == full.best_genes
    again = search.resume(spark, ab, RunStore(spark, store.root), cfg.run_id)  # already finished: no new rows
    assert len(again.history) == len(full.history)
    assert RunStore(spark, store.root).test_metrics().count() == 1


def test_logistic_warm_start_same_optimum(spark, planted):
    from featsearch.operators.models.logistic import LogisticModel

    ids, mat = P.to_matrix(P.init(spark, 6, planted.d, seed=9))
    cold = LogisticModel(solver="newton").fit(planted.df, mat)
    warm = LogisticModel(solver="newton", warm_start=True)
    warm.fit(planted.df, mat[:3])
    flipped = mat.copy()
    flipped[:, 0] ^= 1  # neighbours of the fitted sets
    again = warm.fit(planted.df, np.vstack([mat[3:], flipped[:3]]))
    ref = LogisticModel(solver="newton").fit(planted.df, np.vstack([mat[3:], flipped[:3]]))
    assert np.abs(again - ref).max() < 1e-3 and np.abs(cold[3:] - again[:3]).max() < 1e-3


def test_logistic_cv_matches_direct_fits(spark, planted):
    """Each (chromosome, fold) problem of the shared pass equals a direct fit
    on the other folds' train rows, scored on its own fold."""
    from pyspark.sql import functions as F

    from featsearch.operators.models.logistic import LogisticModel
    from featsearch.operators.split import fold_of

    ids, mat = P.to_matrix(P.init(spark, 2, planted.d, seed=4))
    model = LogisticModel(solver="newton")
    got = {(r["chrom_id"], r["fold"]): (r["tp"], r["fp"], r["fn"], r["tn"])
           for r in model.cv_confusion(planted.df, ids, mat, 3, 0).collect()}
    assert len(got) == 6
    base = planted.df.where("split = 'train'").withColumn("fold", fold_of(planted.df, 3, 0))
    for f in range(3):
        sub = base.withColumn("split", F.when(F.col("fold") == f, "val").otherwise("train")).drop("fold")
        ref = {r["chrom_id"]: (r["tp"], r["fp"], r["fn"], r["tn"])
               for r in LogisticModel(solver="newton").confusion(sub, ids, mat, ("val",)).collect()}
        for cid in ids:
            assert got[(int(cid), f)] == ref[int(cid)]


def test_forward_selection_logistic(spark, planted):
    from featsearch.operators.models.logistic import LogisticModel

    cfg = SearchConfig(dataset="planted", algorithm="rfs", model="logistic", metric="f1")
    res = search.forward_selection(planted, cfg, LogisticModel(), {"val": None}, n_select=2)
    assert len(res.steps) == 2 and set(s["gene"] for s in res.steps) <= {3, 10, 20}


def test_run_grid(spark, tmp_path):
    from featsearch.plans import grid as G

    ab = A.load(spark, SF001, "orders", path=str(tmp_path / "abt"))
    df = G.grid(spark, dict(G.FULL_GRID, dataset=["orders"], algorithm=["baseline_metrics", "random"],
                            model=["centroid"], population_size=[4], max_generation=[1]))
    store = RunStore(spark, str(tmp_path / "runs"))
    res = [r.result for r in G.run_grid(spark, {"orders": ab}, df, store)]
    assert len(res) == 2 and store.configs().count() == 2 and store.test_metrics().count() == 2


def test_mllib_cv_confusion(spark):
    from featsearch.operators.models.mllib import MLlibModel

    ab = A.load(spark, SF001, "orders")
    n_train = ab.df.where("split = 'train'").count()
    model = MLlibModel("mlp", mlp_iter=5, threads=2)
    conf = model.cv_confusion(ab.df, np.array([0]), np.ones((1, ab.d), dtype=np.int8), folds=2).collect()
    assert sorted(r["fold"] for r in conf) == [0, 1]
    assert sum(r["tp"] + r["fp"] + r["fn"] + r["tn"] for r in conf) == n_train
