"""Costs that must not grow faster than the input: row hashes, repeated passes, memory."""

import numpy as np
from pyspark.sql import functions as F

from featsearch.operators import split
from featsearch.operators.models import get


def _frame(spark, n=600, parts=5):
    r = np.random.default_rng(7)
    x, y = np.round(r.normal(size=(n, 3)), 3), r.integers(0, 2, n)
    rows = [(f"r{i}", int(y[i]), [float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "row_id string, y int, features array<double>").repartition(parts)


def _hashes(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("md5(")


def test_a_filter_on_the_split_hashes_a_row_once(spark):
    df = split.stratified_split(_frame(spark), seed=3)
    assert _hashes(df.where("split = 'train'").select("row_id")) == 1
    train = df.where("split = 'train'").localCheckpoint()
    assert _hashes(train.withColumn("fold", split.fold_of(train, 5, 1)).where("fold = 2").select("row_id")) == 1


def test_cross_validation_reads_written_folds(spark):
    df = split.stratified_split(_frame(spark), seed=3).localCheckpoint()
    rows = split.fold_rows(df, "features", F.col("features"), 4, 1)
    assert rows is split.fold_rows(df, "features", F.col("features"), 4, 1) and _hashes(rows) == 0
    train = df.where("split = 'train'")
    want = train.select(split.fold_of(df, 4, 1).alias("fold"), "y", "features").collect()
    assert sorted(map(tuple, want)) == sorted(map(tuple, rows.collect()))
    for name in ("centroid", "logistic"):
        counts = get(name).cv_confusion(df, np.arange(2), np.array([[1, 1, 0], [0, 1, 1]]), folds=4, seed=1)
        assert _hashes(counts) == 0


def test_later_centroid_passes_read_blocks(spark):
    """Rows are turned into blocks once; every later pass reads whole arrays and counts the same."""
    df = split.stratified_split(_frame(spark), seed=3).localCheckpoint()
    holes = F.transform("features", lambda x: F.when(x < 2, x))  # entries without a value decide nothing
    for rows in (df, df.withColumn("features", F.when(F.col("split") == "val", holes).otherwise(F.col("features"))).localCheckpoint()):
        model, bits = get("centroid"), np.array([[1, 1, 0], [0, 1, 1]])
        passes = [model.confusion(rows, np.arange(2), bits, ("val", "test")) for _ in range(3)]
        read = [any("blocks-" in f for f in p.inputFiles()) for p in passes]
        assert read == [False, True, True]
        assert len({str(sorted(map(tuple, p.collect()))) for p in passes}) == 1
        one = model.confusion(rows, np.arange(2), bits, ("val",))
        assert one.inputFiles() and sorted(one.collect()) == sorted(passes[0].where("split = 'val'").collect())
        folds = model.cv_confusion(rows, np.arange(2), bits, folds=4, seed=1)
        assert all("blocks-" in f for f in folds.inputFiles())
        assert sum(sum(r[2:]) for r in folds.collect()) == 2 * rows.where("split = 'train'").count()


def test_blocks_keep_every_number():
    from featsearch.operators.models.centroid import _packed, _wide

    for top in (5, 300, 1 << 20, 1 << 40):
        a = np.array([[top, -top], [0, 1]])
        kind, data = _packed(a)
        assert (_wide(np.frombuffer(data, kind)) == a.ravel()).all() and len(data) < a.nbytes or top == 1 << 40
    assert np.isnan(_wide(np.frombuffer(_packed(np.array([np.nan, 2.0]))[1], "<f8"))[0])


def test_partitioned_writes_do_not_sort(spark, tmp_path):
    from featsearch.session import open_writers

    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    with open_writers(spark):
        assert int(spark.conf.get(name)) > 3  # a split each
        split.stratified_split(_frame(spark), seed=3).write.partitionBy("split").parquet(f"{tmp_path}/t")
    assert spark.conf.get(name) == before and spark.read.parquet(f"{tmp_path}/t").count() == 600


def test_trees_pass_over_distinct_codes(spark):
    """More copies of the same codes are no more rows, and weigh as many."""
    df = split.stratified_split(_frame(spark), seed=3).localCheckpoint()
    copies = df.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(3)))).drop("i")
    found, sizes = [], []
    for rows in (df, copies):
        model = get("gbt", trees=3, depth=3, bins=8, least=0.0, l2=0.0, store_every=2)
        sizes.append(model._coded_rows(rows, 3, {"train"})[0].count())
        counts = model.confusion(rows, np.arange(2), np.array([[1, 1, 0], [0, 1, 1]])).collect()
        found.append({r.chrom_id: (r.tp, r.fp, r.fn, r.tn) for r in counts})
    assert sizes[0] == sizes[1] < df.where("split = 'train'").count()
    assert found[1] == {k: tuple(3 * x for x in v) for k, v in found[0].items()}


def test_tables_of_heavy_rows_are_exact():
    from featsearch.operators.models.trees import UNIT, _tables

    cell, values = np.array([0, 1, 0]), np.array([2.0**UNIT * 2.0**29, 3.0, 1.0])
    assert _tables(cell, [values], 2, 2.0**30).tolist() == [2 ** (UNIT + 29) + 1, 3]


def test_wide_populations_are_shipped_as_bits(spark, monkeypatch):
    from featsearch.operators.models import sparse

    n, d, p, shipped = 400, 3000, 96, []

    class Recorded(sparse.Payload):
        def __init__(self, spark, value, nbytes):
            shipped.append(sum(v.nbytes for v in value))
            super().__init__(spark, value, nbytes)

    monkeypatch.setattr(sparse, "Payload", Recorded)
    r = np.random.default_rng(1)
    genes = np.sort(np.stack([r.choice(d, 4, replace=False) for _ in range(n)]), axis=1)
    rows = [(i, i % 2, ("train", "val")[i % 3 == 0], [int(g) for g in genes[i]], [float(v) for v in r.normal(size=4)]) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id long, y int, split string, indices array<int>, values array<double>")
    bits = r.integers(0, 2, (p, d)).astype(np.int8)
    model = get("sparse_centroid")
    got = {c.chrom_id: (c.tp, c.fp, c.fn, c.tn) for c in model.confusion(df, np.arange(p), bits).collect()}
    assert max(shipped) < d * 48  # 12 bytes of bits and three numbers a gene; a byte a bit would be 96
    mean, sd, m0, m1 = model.fitted(df, d)
    dense, val = np.zeros((n, d)), [i for i in range(n) if i % 3 == 0]
    for i, row in enumerate(rows):
        dense[i, row[3]] = row[4]
    q, y = sparse.fixed(dense[val], mean, sd), np.array([rows[i][1] for i in val])
    said = ((q - m1) ** 2 - (q - m0) ** 2) @ bits.T.astype(np.int64) < 0
    for k in range(p):
        want = [int(((y == a) & (said[:, k] == b)).sum()) for a, b in ((1, 1), (0, 1), (1, 0), (0, 0))]
        assert got[k] == tuple(want)


def test_distinct_rows_as_numpy_and_packed_bound(spark, monkeypatch):
    import pytest

    from featsearch.operators import fitness, population

    mat = np.random.default_rng(2).integers(0, 2, (40, 5)).astype(np.int8)
    uniq, inverse = fitness.distinct(mat)
    want, at = np.unique(mat, axis=0, return_inverse=True)
    assert (uniq == want).all() and (inverse == at.reshape(-1)).all()
    pop = population.from_rows(spark, [(i, row.tolist()) for i, row in enumerate(mat)])
    monkeypatch.setattr(population, "MAX_POPULATION_BITS", 100)
    assert (population.to_matrix(pop, 8)[1] == mat).all()
    with pytest.raises(ValueError, match="exceeds"):
        population.to_matrix(pop)


def test_runs_over_a_frame_share_its_class_means(spark):
    df = split.stratified_split(_frame(spark), seed=3).localCheckpoint()
    assert get("centroid").means(df, 3) is get("centroid").means(df, 3)
    assert get("centroid", fit_split="val").means(df, 3) is not get("centroid").means(df, 3)


def test_entries_are_generated_code(spark):
    """Scaling and fixed-point copies evaluate no lambda for an array of the usual width, with the same values for any."""
    from featsearch.operators import scale

    rows = [([1.5, -2.25, 0.1],), ([None, 7.0, float("nan")],), ([float("inf"), -1e300, -0.0],), ([4.0],), ([],), (None,)]
    df = spark.createDataFrame(rows, "features array<double>").localCheckpoint()
    f, means, sds = F.col("features"), [0.5, 2.0, -0.3], [2.0, 0.7, 1.0]
    m, s = F.array(*map(F.lit, means)), F.array(*map(F.lit, sds))
    plainly = df.select(F.transform(f, lambda x, i: (x - m[i]) / s[i]).alias("z"), scale.quantize(f).alias("q"))
    now = df.select(scale.apply(f, means, sds).alias("z"), scale.quantize(f, 3).alias("q"))
    assert list(map(str, now.collect())) == list(map(str, plainly.collect()))
    assert "get(features, 2)" in str(scale.quantize(f, 3))
    assert "get(" not in str(scale.quantize(f, scale.WIDE_AGG_MAX + 1))


def test_folds_are_cut_without_a_lambda(spark):
    df = split.stratified_split(_frame(spark), seed=3).localCheckpoint()
    rows = split.fold_rows(df, "features", F.col("features"), 4, 2, keep=lambda rows: rows)
    assert _hashes(rows) == 1 and "lambda" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_overlapping_partitioned_writes_restore_the_setting(spark):
    from featsearch.session import OPEN_WRITERS, open_writers

    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    first, second = open_writers(spark), open_writers(spark)
    first.__enter__()
    second.__enter__()
    first.__exit__(None, None, None)
    assert spark.conf.get(name) == str(OPEN_WRITERS)  # the other is still writing
    second.__exit__(None, None, None)
    assert spark.conf.get(name) == before


def test_study_runs_its_datasets_side_by_side(spark, monkeypatch):
    import threading

    from featsearch.plans import study

    met, seen = threading.Barrier(len(study.DATASETS), timeout=20), []
    monkeypatch.setattr(study, "_STORES", {})
    monkeypatch.setattr(study.A, "load", lambda spark, sf, name, *a, **k: met.wait() * 0 or name)
    monkeypatch.setattr(study.search, "run", lambda spark, abt, cfg, store: seen.append((abt, cfg.dataset, cfg.algorithm)))
    study.run_study(spark, "nowhere")
    assert all(a == d for a, d, _ in seen)
    for name in study.DATASETS:  # the runs of one dataset in their order
        assert [a for _, d, a in seen if d == name] == [c.algorithm for c in study.configs() if c.dataset == name]


def test_rows_are_written_once_by_zone(spark, tmp_path):
    """Written by zones of their hashes before the cuts are known, rows are not written
    again by split; a filter on the split reads the folders that hold it."""
    import os

    from featsearch.sources import abt as A

    raw, path = _frame(spark, 5000).persist(), str(tmp_path / "abt")
    ab = A.build(raw, ["a", "b", "c"], seed=3, path=path)
    want = split.stratified_split(raw, seed=3).select("row_id", "y", "split")
    assert sorted(ab.df.select("row_id", "y", "split").collect()) == sorted(want.collect())
    assert {f.split("=")[0] for f in os.listdir(path) if "=" in f} == {"_zone"}
    plans = [ab.df.where(F.col("split") == s)._jdf.queryExecution().optimizedPlan().toString() for s in ("test", "val", "train")]
    read = [p.count("Relation") for p in plans]
    assert all(1 <= n <= 2 for n in read)  # its own zones, and those with a cut


def test_zones_with_a_cut_anywhere_split_exactly(spark, tmp_path):
    """Few rows, a class of one row, repeated and null keys: cuts far from their expected places."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("row_id", T.StringType()), T.StructField("y", T.IntegerType()),
                           T.StructField("features", T.ArrayType(T.DoubleType()))])
    many = [(f"k{i // 3}", i % 2, [float(i)]) for i in range(90)] + [(None, 0, [1.0]), (None, 1, [2.0])]
    for n, rows in enumerate((many, many[:7], [("a", 0, [1.0]), ("b", 1, [2.0])], [*many[1::2], ("solo", 0, [0.0])])):
        from featsearch.sources import abt as A

        raw = spark.createDataFrame(rows, schema)
        got = A.build(raw, ["a"], seed=n, path=f"{tmp_path}/t{n}").df.select("row_id", "y", "split")
        want = split.stratified_split(raw, seed=n).select("row_id", "y", "split")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_zones_hold_their_split():
    cut = [(100, "a"), (300, "b")]
    assert [split._zone_split(*z, *cut) for z in ((0, 100), (0, 101), (100, 101), (101, 300), (101, 301), (300, 301), (301, 400))] == [
        "test", None, None, "val", None, None, "train"]
    assert split._zone_split(0, 5, None, None) == "train" and split._zone_split(0, 5, None, (5, "b")) == "val"


def test_runs_score_blocks_from_their_first_pass(spark):
    from featsearch.config import SearchConfig
    from featsearch.plans import search
    from featsearch.sources.abt import Abt

    df = split.stratified_split(_frame(spark), seed=3).localCheckpoint()
    seen = []

    class Model(type(get("centroid"))):
        def confusion(self, *a, **k):
            out = super().confusion(*a, **k)
            seen.append(any("blocks-" in f for f in out.inputFiles()))
            return out

    cfg = SearchConfig(algorithm="baseline_metrics", model="centroid", metric="f1", population_size=4)
    res = search.run(spark, Abt(df, ["a", "b", "c"]), cfg, model=Model())
    assert seen == [True, True] and res.baseline["test_all"] == res.test


def test_keys_and_hashes_are_written_without_a_dictionary(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    from featsearch.session import checkpoint_dir
    from featsearch.sources import abt as A

    def encodings(folder):
        group = pq.ParquetFile(glob.glob(f"{folder}/**/*.parquet", recursive=True)[0]).metadata.row_group(0)
        held = [group.column(i) for i in range(group.num_columns)]
        return {c.path_in_schema: any("DICTIONARY" in e for e in c.encodings) for c in held}

    few = spark.range(900).selectExpr("concat('k', id % 3) AS row_id", "int(id % 2) AS y", "array(double(id % 2)) AS features")
    df = A.build(few.coalesce(1), ["a"], seed=3, path=str(tmp_path / "abt")).df  # repeats, so dictionaries would pay
    found = encodings(tmp_path / "abt")
    assert not found["row_id"] and not found["_h"] and found["features.list.element"]
    hashes = f"{checkpoint_dir(spark).removeprefix('file:')}/hashes-*"
    before = set(glob.glob(hashes))
    split.fold_rows(df, "features", F.col("features"), 4, 1)
    found = encodings((set(glob.glob(hashes)) - before).pop())
    assert not found["row_id"] and not found["_h"]
