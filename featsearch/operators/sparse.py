"""Sparse feature blocks: rows as ``(indices, values)`` of their nonzero genes.

For inputs whose one-hot width makes dense arrays impossible. Levels are
numbered by a dictionary table (``encode.dictionary``), so neither the plan nor
a row grows with the width; scaling is never applied to a copy, the models
centre implicitly (``models/sparse.py``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featsearch.operators import encode, split
from featsearch.session import written
from featsearch.sources.abt import Abt


def features(df: DataFrame, nums: list[str], cats: list[str]) -> tuple[DataFrame, DataFrame, int]:
    """``df`` with ``indices ARRAY<INT>`` (ascending) and ``values ARRAY<DOUBLE>``,
    the table ``gene, feature`` of names, and the number of genes.

    Genes are the numeric columns, then the levels of ``cats``, as in the dense
    ``encode.features``. A null level has no entry; a null number raises.
    """
    spark = df.sparkSession
    codes = written(encode.dictionary(df, cols=cats), "levels") if cats else None
    sizes = {r["i"]: r["count"] for r in codes.groupBy("i").count().collect()} if cats else {}
    offsets, d = [], len(nums)
    for i in range(len(cats)):
        offsets.append(d)
        d += sizes.get(i, 0)
    suffix = "__code"
    wide = encode.coded(df, cats, codes, suffix) if cats else df
    entries = []
    for i, c in enumerate(nums):
        x = encode.quoted(c).cast("double")
        checked = F.when(x.isNull(), F.raise_error(F.lit("null feature value"))).otherwise(x)
        entries.append(F.when(checked != 0, F.struct(F.lit(i).alias("gene"), checked.alias("x"))))
    for c, at in zip(cats, offsets, strict=True):
        code = encode.quoted(c + suffix)
        entries.append(F.when(code.isNotNull(), F.struct((code + at).cast("int").alias("gene"), F.lit(1.0).alias("x"))))
    kept = F.filter(F.array(*entries), lambda e: e.isNotNull())
    out = wide.withColumn("__entries", kept).select(
        *[encode.quoted(c) for c in df.columns],
        F.col("__entries.gene").alias("indices"), F.col("__entries.x").alias("values"),
    )
    names = spark.createDataFrame([(i, c) for i, c in enumerate(nums)], "gene bigint, feature string")
    for i, (c, at) in enumerate(zip(cats, offsets, strict=True)):
        of = codes.where(F.col("i") == i)
        names = names.unionByName(of.select((F.col("code") + at).alias("gene"), F.concat(F.lit(c + "_"), "level").alias("feature")))
    return out, names, d


def build(raw: DataFrame, d: int, path: str, seed: int = 0, test_pct: int = 10, val_pct: int = 20) -> Abt:
    """Split ``row_id, y, indices, values`` and write it, partitioned by split."""
    rows = split.stratified_split(raw, seed=seed, test_pct=test_pct, val_pct=val_pct)
    columns = ["row_id", "y", "split", "indices", "values"]
    rows.select(*columns).write.partitionBy("split").parquet(path)
    return Abt(raw.sparkSession.read.parquet(path).select(*columns), range(d))
