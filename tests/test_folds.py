"""Stratified folds against plain per-class ranking."""

import collections

import pytest

from featsearch.functions.rng import u32
from featsearch.operators import split
from pyspark.sql import functions as F


@pytest.mark.parametrize("folds,sizes", [(5, (103, 7)), (3, (2, 50)), (2, (1, 1)), (4, (0, 40))])
def test_folds(spark, monkeypatch, folds, sizes):
    rows = [(i, int(i >= sizes[0]), "train") for i in range(sum(sizes))] + [(1000 + i, i % 2, "val") for i in range(9)]
    found = []
    for parts, limit in ((1, split.DIRECT_LIMIT), (5, 0)):  # fetched whole, then by exact hashes
        monkeypatch.setattr(split, "DIRECT_LIMIT", limit)
        df = spark.createDataFrame(rows, "row_id long, y int, split string").repartition(parts)
        out = df.where("split = 'train'").select("row_id", "y", split.fold_of(df, folds, 3).alias("fold"), u32(3, "fold", F.col("row_id")).alias("h"))
        found.append(sorted(tuple(r) for r in out.collect()))
    assert found[0] == found[1]
    for y in (0, 1):
        own = sorted((h, i, f) for i, c, f, h in found[0] if c == y)
        n = len(own)
        assert [f for *_, f in own] == [sum(rk > n * j // folds for j in range(1, folds)) for rk in range(1, n + 1)]
        each = collections.Counter(f for *_, f in own)
        assert n < folds or (set(each) == set(range(folds)) and max(each.values()) - min(each.values()) <= 1)
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE t (row_id BIGINT, y INT)")
    con.executemany("INSERT INTO t VALUES (?, ?)", [(i, c) for i, c, _ in rows if _ == "train"])
    assert sorted(con.execute(split.fold_sql("t", folds, 3)).fetchall()) == [(i, f) for i, _, f, _ in found[0]]


def test_null_labels_raise(spark):
    df = spark.createDataFrame([(1, None, "train"), (2, 1, "train")], "row_id long, y int, split string")
    with pytest.raises(ValueError, match="null"):
        split.fold_of(df, 2)
