"""Reports over literal run tables (FIXTURES C)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from featsearch.plans import report as R
from featsearch.sources.store import CONFIG_SCHEMA, HISTORY_SCHEMA, TEST_SCHEMA


def _cfg(run_id, ds, alg, minute):
    return (run_id, dt.datetime(2026, 1, 1, 0, minute), ds, alg, "logistic", "f1", "onepoint", 0.2, 10, 2, 2,
            0.99999, "processes", 0)


@pytest.fixture(scope="module")
def runs(spark):
    configs = spark.createDataFrame([
        _cfg("r1", "a", "ga_spark", 1), _cfg("r2", "a", "random", 2), _cfg("r3", "b", "baseline_metrics", 3),
        _cfg("r4", "a", "rfs", 4), _cfg("r5", "b", "baseline_metrics", 5),
    ], CONFIG_SCHEMA)
    hist = []
    for rid, base in (("r1", 0.5), ("r2", 0.4)):
        for g in range(3):
            hist.append((rid, g, 1.0 + g, base + g / 10, base + g / 10 + 0.05, base, base + 0.05, [1, 0, 1]))
    hist += [("r3", 0, 2.0, 0.7, 0.7, 0.7, 0.7, [1, 1, 1]), ("r5", 0, 2.0, 0.7, 0.7, 0.7, 0.7, [1, 1, 1])]
    history = spark.createDataFrame(hist, HISTORY_SCHEMA)
    test = spark.createDataFrame([
        ("r1", 0.6, 0.7, 0.65, [1, 0, 1], [1, 0, 1], "done"),
        ("r2", 0.5, 0.6, 0.55, [0, 1, 1], [0, 1, 1], "done"),
        ("r3", 0.8, 0.8, 0.8, [1, 1, 1], [1, 1, 1], "done"),
        ("r5", 0.8, 0.8, 0.8, [1, 1, 1], [1, 1, 1], "done"),
    ], TEST_SCHEMA)
    return configs, history, test


def test_complete_and_placeholders(runs):
    c, h, t = runs
    assert sorted(r[0] for r in R.complete_runs(c, h, t).select("run_id").collect()) == ["r1", "r2", "r3", "r5"]
    ph = R.with_placeholders(c, h, t)
    rfs = ph.where("algorithm = 'rfs'").collect()
    assert ph.count() == 5 and len(rfs) == 1 and rfs[0]["f1"] is None


def test_history_summary_last_generation(runs):
    _, h, _ = runs
    s = {r["run_id"]: r for r in R.history_summary(h).collect()}
    assert s["r1"]["avg"] == 0.5 + 0.2 and s["r1"]["last_gen"] == 2 and s["r1"]["time_s"] == 2.0


def test_duplicates_keep_first_copy(runs):
    comp = R.compiled(*runs)
    dups = R.duplicate_runs(comp.drop("started_at"))
    assert [r["run_id"] for r in dups.collect()] == ["r5"]


def test_metrics_pivot_keeps_missing_combinations(runs):
    comp = R.compiled(*runs)
    piv = R.metrics_pivot(comp, ["a", "b"], ["logistic"], list(R.ALGORITHM_ORDER))
    assert piv.count() == len(R.ALGORITHM_ORDER) * 3
    rfs = piv.where("algorithm = 'rfs' AND metric = 'f1'").first()
    assert rfs["a"] is None and rfs["b"] is None
    base = piv.where("algorithm = 'baseline_metrics' AND metric = 'f1'").first()
    assert base["b"] == 0.8 and base["a"] is None
    shown = R.round_display(piv, ["a", "b"]).where("algorithm = 'rfs' AND metric = 'f1'").first()
    assert shown["a"] == "NaN"


def test_display_names(spark):
    df = spark.createDataFrame([("baseline_metrics",), ("ga_spark",), ("rfs",), ("ga\\\\seq",)], "a string")
    got = [r[0] for r in df.select(R.display_name("a")).collect()]
    assert got == ["BASELINE", "GA SPARK", "RFS", "GASEQ"]


def test_decode_numpy_text(spark):
    df = spark.createDataFrame([("[0 1 1 0]",), ("0110",), ("[1,0]",)], "s string")
    assert [r[0] for r in df.select(R.decode_genes("s")).collect()] == [[0, 1, 1, 0], [0, 1, 1, 0], [1, 0]]


def test_jaccard_matrix_latest_run(runs):
    comp = R.compiled(*runs)
    ov = R.jaccard_overlap(comp)
    m = R.jaccard_matrix(ov, ["ga_spark", "random", "rfs"]).where("dataset = 'a' AND algo1 = 'ga_spark'").first()
    assert m["ga_spark"] == 1.0 and abs(m["random"] - 1 / 3) < 1e-15 and m["rfs"] is None


def test_convergence_and_times(runs):
    c, h, t = runs
    conv = [tuple(r) for r in R.convergence(h, "r1").collect()]
    assert [g for g, *_ in conv] == [0, 1, 2]
    tp = R.times_pivot(R.compiled(c, h, t), ["a", "b"]).where("algorithm = 'ga_spark'").first()
    assert tp["a"] == 2.0 and tp["b"] is None


def test_run_label_matches_config_run_id(spark):
    from featsearch.config import SearchConfig

    cfg = SearchConfig()
    df = spark.createDataFrame([(cfg.started_at,)], "started_at timestamp")
    assert cfg.run_id.startswith(df.select(R.run_label()).first()[0])
