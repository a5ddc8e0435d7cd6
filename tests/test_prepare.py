"""Encoding, split and scaling."""

import pytest
from pyspark.sql import functions as F

from featsearch.operators import encode, scale, split
from featsearch.sources import abt as A
from conftest import SF001


def test_one_hot_literal(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "id long, c string")
    wide, names = encode.one_hot(df, ["c"])
    assert names == ["c_a", "c_b"]
    assert [(r["c_a"], r["c_b"]) for r in wide.orderBy("id").collect()] == [(1.0, 0.0), (0.0, 1.0), (1.0, 0.0)]


def test_scaler_literal(spark):
    df = spark.createDataFrame([(0, "train", [0.0, 5.0]), (1, "train", [2.0, 5.0])], "row_id long, split string, features array<double>")
    means, sds = scale.fit(df)
    assert means == [1.0, 5.0] and sds == [1.0, 1.0]
    out = [r[0] for r in df.select(scale.apply(F.col("features"), means, sds)).collect()]
    assert out == [[-1.0, 0.0], [1.0, 0.0]]


def test_prepare_generic(spark):
    df = spark.createDataFrame(
        [(1, "x", 2.0, "yes", 9), (2, "y", 3.0, "no", 9), (3, "x", 4.0, "yes", 9)],
        "id long, cat string, v double, lab string, junk int",
    )
    out, names = A.prepare(df, "lab", id_col="id", drop_cols=["junk"])
    assert names == ["v", "cat_x", "cat_y"]
    rows = {r["row_id"]: (r["y"], r["features"]) for r in out.collect()}
    assert rows[1] == (1, [2.0, 1.0, 0.0]) and rows[2] == (0, [3.0, 0.0, 1.0])
    with pytest.raises(ValueError):
        A.prepare(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, lab string"), "lab", id_col="id")


def test_split_exact_counts_and_partition_invariance(spark):
    raw, _ = A.raw_orders(spark, SF001)
    s1 = split.stratified_split(raw.select("row_id", "y"))
    s2 = split.stratified_split(raw.select("row_id", "y").repartition(5))
    a = {r["row_id"]: r["split"] for r in s1.collect()}
    b = {r["row_id"]: r["split"] for r in s2.collect()}
    assert a == b
    counts = {(r["y"], r["split"]): r["count"] for r in s1.groupBy("y", "split").count().collect()}
    for y in (0, 1):
        n = sum(v for (yy, _), v in counts.items() if yy == y)
        t, v = split.split_sizes(n, 10, 20)
        assert counts.get((y, "test"), 0) == t and counts.get((y, "val"), 0) == v


def test_kth_keys_against_sort(spark):
    df = spark.range(3000).select(F.col("id").alias("row_id"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    from featsearch.functions.rng import u32

    base = df.withColumn("_h", u32(0, "split", F.col("row_id")))
    keys = split.kth_keys(base, "y", "_h", "row_id", {0: [1, 77, 2000], 1: [1000]})
    rows = sorted((r["y"], r["_h"], r["row_id"]) for r in base.collect())
    for (g, k), key in keys.items():
        mine = [(h, rid) for yy, h, rid in rows if yy == g]
        assert mine[k - 1] == key


def test_kth_keys_refinement_path(spark, monkeypatch):
    """Force the exact-hash histogram path used when boundary buckets are large."""
    from featsearch.functions.rng import u32

    monkeypatch.setattr(split, "DIRECT_LIMIT", 0)
    df = spark.range(5000).select(F.col("id").alias("row_id"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    base = df.withColumn("_h", u32(3, "split", F.col("row_id")))
    keys = split.kth_keys(base, "y", "_h", "row_id", {0: [1, 500, 3750], 1: [1, 1250]})
    rows = sorted((r["y"], r["_h"], r["row_id"]) for r in base.collect())
    for (g, k), key in keys.items():
        assert [(h, rid) for yy, h, rid in rows if yy == g][k - 1] == key


def test_split_rejects_hot_duplicate_key(spark, monkeypatch):
    """A cut inside a hot duplicated row_id is refused, not fetched to the driver.

    (A hot key whose rows all fall on one side of every cut needs no
    tie-break and splits exactly.)"""
    monkeypatch.setattr(split, "DIRECT_LIMIT", 0)
    monkeypatch.setattr(split, "MAX_TIES", 100)
    df = spark.range(3000).select(
        F.when(F.col("id") % 10 != 0, F.lit(-1)).otherwise(F.col("id")).alias("row_id"), F.lit(1).alias("y")
    )
    with pytest.raises(ValueError, match="not a unique key"):
        split.stratified_split(df)


def test_prepare_nulls(spark):
    df = spark.createDataFrame([(1, 2.0, "a"), (2, None, "b"), (3, 1.0, "a")], "id long, v double, lab string")
    out, _ = A.prepare(df, "lab", id_col="id")
    with pytest.raises(Exception, match="null feature"):
        out.collect()
    filled, _ = A.prepare(df, "lab", id_col="id", fill_value=0.0)
    assert {r["row_id"]: r["features"] for r in filled.collect()}[2] == [0.0]
    bad = spark.createDataFrame([(1, 2.0, "a"), (2, 1.0, None), (3, 1.0, "b")], "id long, v double, lab string")
    lab, _ = A.prepare(bad, "lab", id_col="id")
    with pytest.raises(Exception, match="null label"):
        lab.collect()


def test_subset_by_genes_column(spark):
    """F7 with the mask as a column (per-row chromosomes) and as a static list."""
    df = spark.createDataFrame([([0.0, 1.0, 2.0, 3.0], [0, 1, 1, 0]), ([5.0, 6.0, 7.0, 8.0], [1, 0, 0, 1])],
                               "features array<double>, genes array<int>")
    got = [r[0] for r in df.select(encode.subset(F.col("features"), F.col("genes"))).collect()]
    assert got == [[1.0, 2.0], [5.0, 8.0]]
    static = [r[0] for r in df.select(encode.subset_static(F.col("features"), [0, 0, 1, 1])).collect()]
    assert static == [[2.0, 3.0], [7.0, 8.0]]


def test_content_ids_repeated_rows_and_any_partitioning(spark):
    rows = [("a", 1.0)] * 500 + [("b", None)] * 3 + [(None, 2.0), ("", 2.0), ("n", 2.0)] + [(f"r{i}", float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "c string, v double")
    seen = []
    for frame in (df.repartition(1), df.repartition(7), df.repartition(4, "c").orderBy(F.desc("c"))):
        got = A.content_ids(frame)
        assert got.columns == ["c", "v", "_row_id"]
        seen.append(sorted((r["_row_id"], r["c"] or "", r["v"] or 0.0) for r in got.collect()))
        assert len({r[0] for r in seen[-1]}) == len(rows)
    assert seen[0] == seen[1] == seen[2]
    assert A.content_ids(df.limit(0)).count() == 0


def test_content_ids_clashing_names(spark):
    names = ["key", "part", "at", "row", "start", "first", "n", "a.b"]
    df = spark.createDataFrame([tuple(range(8))] * 3, names)
    got = A.content_ids(df)
    assert got.columns == names + ["_row_id"] and len({r["_row_id"] for r in got.collect()}) == 3


def test_prepare_without_ids_splits_alike(spark):
    rows = [("x" if i % 3 else "y", float(i % 40), "p" if i % 2 else "q") for i in range(400)]
    df = spark.createDataFrame(rows, "c string, v double, lab string")

    def splits(frame):
        raw, _ = A.prepare(frame, "lab")
        return sorted((r["row_id"], r["split"]) for r in split.stratified_split(raw).collect())

    assert splits(df.repartition(2)) == splits(df.repartition(9))


def test_dictionary_against_sorted_levels(spark, monkeypatch):
    rows = [(i, f"l{(i * 7919) % 3001}" if i % 11 else None, "hot" if i % 3 else f"é{i % 5}") for i in range(6000)]
    df = spark.createDataFrame(rows, "level long, a string, b string").repartition(9)
    codes = encode.dictionary(df, ["a", "b"])
    got = {(r["i"], r["level"]): r["code"] for r in codes.collect()}
    for i in (0, 1):
        want = sorted({r[i + 1] for r in rows if r[i + 1] is not None})
        assert {lv: got[i, lv] for lv in want} == {lv: n for n, lv in enumerate(want)}
    assert len(got) == sum(len({r[i + 1] for r in rows} - {None}) for i in (0, 1))
    plain = {r["level"]: (r["a_code"], r["b_code"]) for r in encode.coded(df, ["a", "b"], codes).collect()}
    monkeypatch.setattr(encode, "SMALL_ROWS", 0)
    shuffled = {r["level"]: (r["a_code"], r["b_code"]) for r in encode.coded(df, ["a", "b"], codes).collect()}
    assert plain == shuffled and len(plain) == 6000
    assert all(plain[k] == (got.get((0, a)), got.get((1, b))) for k, a, b in rows)
    assert encode.dictionary(df.limit(0), ["a"]).count() == 0
