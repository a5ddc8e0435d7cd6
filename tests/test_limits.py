"""No silent loss: missing inputs raise, statistics belong to their frame."""

import numpy as np
import pytest

from featsearch.config import SearchConfig
from featsearch.operators import encode, split
from featsearch.operators.fitness import cv_scores
from featsearch.operators.models import logistic
from featsearch.operators.models.centroid import CentroidModel
from featsearch.plans import grid, report, search
from featsearch.sources import abt as A
from featsearch.sources.store import RunStore
from conftest import SF001


def test_grid_names_missing_datasets(spark):
    df = grid.grid(spark, {"dataset": ["nowhere"], "algorithm": ["ga_seq"], "backend": ["processes"]})
    with pytest.raises(ValueError, match="nowhere"):
        grid.run_grid(spark, {}, df, None)


def test_store_that_is_not_there_raises(spark, tmp_path):
    with pytest.raises(Exception):
        RunStore(spark, f"{tmp_path}/nothing").history().count()
    assert RunStore(spark, str(tmp_path)).history().count() == 0
    (tmp_path / "history").mkdir()
    (tmp_path / "history" / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        RunStore(spark, str(tmp_path)).history().count()


def test_generation_written_twice_is_there_once(spark, tmp_path):
    store = RunStore(spark, str(tmp_path))
    row = {"gen": 0, "time_s": 1.0, "avg": 0.5, "best": 0.6, "worst": 0.1, "best_so_far": 0.6, "best_genes": [1, 0]}
    pop = spark.createDataFrame([(0, [1, 0]), (1, [0, 1])], "chrom_id long, genes array<int>")
    for _ in range(2):
        store.append_history("r:1", [row])
        store.write_population("r:1", 1, pop)
    store.append_history("r:1", [{**row, "gen": 1}])
    store.append_history("r:2", [row])
    assert sorted((r.run_id, r.gen) for r in store.history().collect()) == [("r:1", 0), ("r:1", 1), ("r:2", 0)]
    assert store.populations().count() == 2


def test_levels_without_cap_dots_and_case(spark):
    rows = [(i, f"v{i}.0", "Yes" if i % 2 else "yes", "a" if i % 3 else None, i % 2) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, `a.b` string, c string, `d``e` string, y int")
    out, names = A.prepare(df, "y", id_col="id")
    assert len(names) == 2000 + 2 + 1 and {"c_Yes", "c_yes", "a.b_v7.0"} <= set(names)
    for r in out.where("row_id in (6, 7)").collect():
        on = {names[i] for i, v in enumerate(r.features) if v}
        assert on == {f"a.b_v{r.row_id}.0", "c_Yes" if r.row_id % 2 else "c_yes"} | ({"d`e_a"} if r.row_id % 3 else set())


def test_null_label_raises_in_the_split(spark):
    df = spark.createDataFrame([(1, 0), (2, None), (3, 1)], "row_id long, y int")
    with pytest.raises(ValueError, match="null"):
        split.stratified_split(df)


def test_statistics_belong_to_their_frame(spark):
    model = CentroidModel()
    for shift in range(12):
        df = spark.createDataFrame(
            [(i, i % 2, "train", [float(i % 2 + shift)]) for i in range(6)],
            "row_id long, y int, split string, features array<double>",
        )
        m0, m1 = model.means(df)
        assert (m0[0], m1[0]) == (shift * 10000, (shift + 1) * 10000)


def test_absent_fold_is_no_zero():
    class Model:
        def cv_confusion(self, *a):
            class Rows:
                def collect(self):
                    return [{"chrom_id": 0, "fold": f, "tp": 1, "fp": 0, "fn": 0, "tn": 1} for f in (0, 3)]
            return Rows()

        def release(self):
            pass

    assert cv_scores(Model(), None, np.array([0]), None, folds=5) == [(0, 1.0)]


def test_logistic_block_size_changes_nothing(spark, monkeypatch):
    import pyarrow as pa

    r = np.random.default_rng(3)
    x, y = r.normal(size=(200, 4)), r.integers(0, 2, 200)
    batch = pa.RecordBatch.from_arrays([pa.array(y), pa.array(list(x), pa.list_(pa.float64()))], ["y", "features"])
    bits, theta = r.integers(0, 2, (70, 4)), r.normal(size=(70, 5))
    got = []
    for block in (1, 64, 1000):
        monkeypatch.setattr(logistic, "BLOCK", block)
        out = list(logistic.newton_batches([batch], theta, bits))
        got.append(np.array([np.frombuffer(v, np.int64) for v in out[0]["v"].to_pylist()]))
    assert (got[0] == got[1]).all() and (got[1] == got[2]).all()


def test_random_search_stops_between_passes(spark, monkeypatch):
    ab = A.load(spark, SF001, "planted")
    cfg = SearchConfig(dataset="planted", algorithm="random", model="centroid", metric="f1", population_size=5,
                       max_generation=11, stopping_threshold=0.0, seed=1).validate()
    seen = []
    plan = search.random_plan
    monkeypatch.setattr(search, "ROUNDS_PER_PASS", 4)
    monkeypatch.setattr(search, "random_plan", lambda *a: seen.append(a[-1]) or plan(*a))
    base = {"val": None, "test": None}
    res = search.random_search(ab, cfg, CentroidModel(), base)
    assert seen == [range(0, 4)] and [h["gen"] for h in res.history] == [0]
    cfg.stopping_threshold = 2.0
    whole = search.random_search(ab, cfg, CentroidModel(), base)
    assert [h["gen"] for h in whole.history] == list(range(12))
    want = [r.best for r in plan(ab, cfg, CentroidModel(), None).orderBy("gen").collect()]
    assert [h["best"] for h in whole.history] == want
    assert search.random_search(ab, cfg, CentroidModel(), {"val": 3.0}).status == "baseline_met"


def test_later_copy_by_time_not_by_id(spark):
    df = spark.createDataFrame(
        [("31012024", "2024-01-31", 1.0), ("01022024", "2024-02-01", 1.0)], "run_id string, started_at string, f1 double"
    )
    assert [r.run_id for r in report.duplicate_runs(df).collect()] == ["01022024"]


def test_one_scan_for_all_levels(spark):
    df = spark.createDataFrame([("b", "x"), ("a", None), ("b", "y")], "p string, q string")
    assert encode.all_levels(df, ["p", "q"]) == [["a", "b"], ["x", "y"]]
    with pytest.raises(ValueError):
        encode.all_levels(df, ["p", "q"], 3)
