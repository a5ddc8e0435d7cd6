"""Encodings (F1-F7): categorical detection, one-hot, label codes, packing, subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featsearch.session import written

#: A dictionary of at most so many levels and bytes is broadcast.
SMALL_ROWS, SMALL_BYTES = 1 << 20, 32 << 20
#: Most levels of all columns together: the widest feature array there is.
MAX_LEVELS = 100_000


def quoted(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def categorical_columns(df: DataFrame, exclude=()) -> list[str]:
    """String-typed columns are categorical (pandas' object/category)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def all_levels(df: DataFrame, cols: list[str], max_levels: int = MAX_LEVELS) -> list[list]:
    """Sorted distinct non-null values of each column: one scan for all.

    The number of levels is checked before they reach the driver, since the
    feature width grows with it.
    """
    if not cols:
        return []
    cells = F.array(*[F.struct(F.lit(i).alias("i"), quoted(c).cast("string").alias("v")) for i, c in enumerate(cols)])
    found = df.select(F.explode(cells).alias("x")).select("x.i", "x.v").where("v is not null").distinct()
    rows = found.limit(max_levels + 1).collect()
    if len(rows) > max_levels:
        raise ValueError(f"columns {', '.join(cols)} have more than {max_levels} levels")
    out: list[list] = [[] for _ in cols]
    for r in rows:
        out[r["i"]].append(r["v"])
    return [sorted(v) for v in out]


def local_place(order: list[str]) -> list[Column]:
    """``part, at``: the partition of a row and its place inside it."""
    return [F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at"), *order]


def dictionary(df: DataFrame, cols: list[str]) -> DataFrame:
    """``i, level, code``: the sorted distinct non-null values of ``cols[i]``,
    as text, numbered from 0; a table, so their number has no bound.

    Range partitions are sorted and written once; a row per partition and
    column then says how many levels of a column lie in earlier partitions.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("i"), quoted(c).cast("string").alias("level")) for i, c in enumerate(cols)])
    found = df.select(F.explode(cells).alias("x")).select("x.*").where("level is not null").distinct()
    ordered = found.repartitionByRange("i", "level").sortWithinPartitions("i", "level")
    placed = written(ordered.select(*local_place(["i", "level"])), "levels")
    per = placed.groupBy("i", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("i").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("i", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("start"))
    return placed.join(F.broadcast(starts), ["i", "part"]).select("i", "level", (F.col("start") + F.col("at")).alias("code"))


def coded(df: DataFrame, cols: list[str], codes: DataFrame, suffix: str = "_code") -> DataFrame:
    """``df`` with the code of every column of ``cols`` (null: null) from its
    ``dictionary``, broadcast if that is small, else joined by a shuffle."""
    codes = written(codes, "codes")
    size = codes.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("level")).alias("bytes")).collect()
    small = {r["i"] for r in size if r["n"] <= SMALL_ROWS and r["bytes"] <= SMALL_BYTES}
    for i, c in enumerate(cols):
        side = codes.where(F.col("i") == i).select(F.col("level").alias("__level"), F.col("code").alias(c + suffix))
        match = quoted(c).cast("string") == F.col("__level")
        df = df.join(F.broadcast(side) if i in small else side, match, "left").drop("__level")
    return df


def levels(df: DataFrame, col: str, max_levels: int = MAX_LEVELS) -> list:
    """Sorted distinct non-null values of one column, in its own type."""
    vals = df.select(quoted(col).alias("v")).where("v is not null").distinct().limit(max_levels + 1).collect()
    if len(vals) > max_levels:
        raise ValueError(f"column {col!r} has more than {max_levels} levels")
    return sorted(r[0] for r in vals)


def one_hot_array(col: str, lvls: list) -> Column:
    """All levels of a column as one array of 0/1 doubles; null is all zeros.

    No column is made per level, so levels may differ in case or hold dots.
    """
    at = F.coalesce(F.array_position(F.lit(lvls), quoted(col).cast("string")), F.lit(0))
    return F.transform(F.sequence(F.lit(1), F.lit(len(lvls))), lambda i: F.when(i == at, 1.0).otherwise(0.0))


def features(df: DataFrame, nums: list[str], cats: list[str], max_levels: int = MAX_LEVELS) -> tuple[Column, list[str]]:
    """Numeric columns, then the one-hot levels of ``cats``, as one array."""
    parts = [pack(nums)] if nums else []
    names = list(nums)
    for c, lv in zip(cats, all_levels(df, cats, max_levels), strict=True):
        if lv:
            parts.append(one_hot_array(c, lv))
            names += [f"{c}_{v}" for v in lv]
    return (F.concat(*parts) if parts else F.array().cast("array<double>")), names


def one_hot_columns(col: str, lvls: list) -> list[Column]:
    """Every level gets a 0/1 double column ``<col>_<level>``; no level is dropped."""
    return [F.when(quoted(col) == F.lit(v), 1.0).otherwise(0.0).alias(f"{col}_{v}") for v in lvls]


def one_hot(df: DataFrame, cols: list[str], max_levels: int = MAX_LEVELS) -> tuple[DataFrame, list[str]]:
    """Expand ``cols`` in place of themselves at the end (pandas ``get_dummies`` order)."""
    keep = [quoted(c) for c in df.columns if c not in cols]
    new_cols: list[Column] = []
    names: list[str] = []
    for c, lv in zip(cols, all_levels(df, cols, max_levels), strict=True):
        new_cols += one_hot_columns(c, lv)
        names += [f"{c}_{v}" for v in lv]
    return df.select(*keep, *new_cols), names


def label_codes(df: DataFrame, col: str, max_levels: int = MAX_LEVELS, lv: list | None = None) -> Column:
    """Sorted distinct labels -> 0..k-1 (LabelEncoder); a literal map lookup, no join."""
    lv = levels(df, col, max_levels) if lv is None else lv
    mapping = F.create_map(*[x for i, v in enumerate(lv) for x in (F.lit(v), F.lit(i))])
    return mapping[quoted(col)]


def pack(cols: list[str]) -> Column:
    """Features as one ``ARRAY<DOUBLE>``, so width does not bloat the plan."""
    return F.array(*[quoted(c).cast("double") for c in cols])


def subset(features: Column, genes: Column) -> Column:
    """Columns of ``features`` whose bit in ``genes`` is 1 (data_chromosome_subset)."""
    z = F.arrays_zip(features.alias("x"), genes.alias("b"))
    return F.transform(F.filter(z, lambda s: s["b"] == 1), lambda s: s["x"])


def subset_static(features: Column, mask: list[int]) -> Column:
    """Same with a mask known on the driver: a plain projection of array slots."""
    return F.array(*[features[i] for i, b in enumerate(mask) if b])
