"""Labelled datasets -> the analytic base table.

Shape after preparation::

    row_id, y INT (0/1), split STRING (train|val|test), features ARRAY<DOUBLE>

``prepare`` is the generic path for any labelled DataFrame. The named
fixtures below build ABTs from the given tables; each has an SQL twin
(``raw_sql``) producing the same raw rows in long form for DuckDB.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featsearch.functions.rng import u32
from featsearch.operators import encode, scale, split
from featsearch.session import open_writers, plainly, written
from featsearch.sources.tables import table

MAX_FEATURES = 100_000


@dataclass
class Abt:
    df: DataFrame  # row_id, y, split, features (standardized)
    names: list[str]
    means: list[float] = field(default_factory=list)
    sds: list[float] = field(default_factory=list)

    @property
    def d(self) -> int:
        return len(self.names)


def content_ids(df: DataFrame, name: str = "_row_id") -> DataFrame:
    """``df`` with a key made of its content: a 128-bit hash of all values and
    the occurrence number among equal rows, so keys follow neither the file
    layout nor the partitioning.

    Rows are sorted by hash inside their partition and written once; the
    occurrence number is the place inside the partition plus the equal rows of
    earlier partitions, so a row that repeats without end is no hot group.
    """

    def text(field):
        c = encode.quoted(field.name)
        nested = isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType))
        c = F.to_json(c, {"ignoreNullFields": "false"}) if nested else c.cast("string")
        return F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("n"))

    row = F.struct(*[encode.quoted(c) for c in df.columns]).alias("row")
    keyed = df.select(F.md5(F.concat(*[text(f) for f in df.schema.fields])).alias("key"), row)
    placed = written(keyed.sortWithinPartitions("key").select(*encode.local_place(["key", "row"])), "keyed")
    per = placed.groupBy("key", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    of_key = Window.partitionBy("key")
    earlier = of_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    repeated = (
        per.withColumn("total", F.sum("n").over(of_key))
        .withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first"))
        .where("total > 1").select("key", "part", "start")
    )
    number = F.coalesce(F.col("start") + F.col("at"), F.lit(0)).cast("string")
    return placed.join(repeated, ["key", "part"], "left").select("row.*", F.concat_ws(":", "key", number).alias(name))


def prepare(
    df: DataFrame,
    label_col: str,
    id_col: str | None = None,
    positive=None,
    drop_cols=(),
    max_levels: int = encode.MAX_LEVELS,
    fill_value: float | None = None,
) -> tuple[DataFrame, list[str]]:
    """Generic S1: drop ids, pop the label, one-hot strings, pack doubles.

    Returns ``(row_id, y, features)`` and the feature names. Labels must be
    binary after encoding, unless ``positive`` names the positive class.
    Null labels are rejected; null numeric features are rejected unless
    ``fill_value`` is given (no silent imputation). Without ``id_col`` (a unique
    key) rows are keyed by their content (``content_ids``), dropped columns not
    counted.
    """
    if label_col not in df.columns:
        raise ValueError(f"label column {label_col!r} not found")
    df = df.drop(*[c for c in drop_cols if c != id_col])
    if id_col is None:
        id_col = "_row_id"
        df = content_ids(df, id_col)
    feats = [c for c in df.columns if c not in (label_col, id_col)]
    cats = encode.categorical_columns(df, exclude=(label_col, id_col))
    nums = [c for c in feats if c not in cats]
    feats_col, names = encode.features(df, nums, cats, max_levels)
    if len(names) > MAX_FEATURES:
        raise ValueError("too many features")
    label = encode.quoted(label_col)
    if positive is not None:
        y = (label == F.lit(positive)).cast("int")
    else:
        lv = encode.levels(df, label_col)
        if len(lv) != 2:
            raise ValueError(f"label {label_col!r} has {len(lv)} classes; give positive= to binarise")
        y = encode.label_codes(df, label_col, lv=lv).cast("int")
    if fill_value is not None:
        feats_col = F.transform(feats_col, lambda x: F.coalesce(x, F.lit(float(fill_value))))
    else:
        feats_col = F.when(F.exists(feats_col, lambda x: x.isNull()),
                           F.raise_error(F.lit("null feature value; give fill_value"))).otherwise(feats_col)
    out = df.select(
        encode.quoted(id_col).alias("row_id"),
        F.when(label.isNull(), F.raise_error(F.lit("null label"))).otherwise(y).alias("y"),
        feats_col.alias("features"),
    )
    return out, names


def build(raw: DataFrame, names: list[str], seed: int = 0, test_pct: int = 10, val_pct: int = 20,
          path: str | None = None) -> Abt:
    """Split (exact stratified) then scale with train statistics.

    Inputs read as fewer splits than there are cores (small tables) are
    spread over all cores and cached for the few preparation jobs (not with ``path``,
    which reads them once); large inputs are left as scanned, each job re-reading only the pruned columns.

    With ``path`` (shared storage), the rows are written there once, in folders by
    zones of their hashes; cuts, splits and the scaler come from the written rows,
    which saves further scans of the raw input and a second write by split.
    """
    spark = raw.sparkSession
    par = spark.sparkContext.defaultParallelism
    if raw.rdd.getNumPartitions() < par:
        raw = raw.repartition(par)
        raw = raw if path is not None else raw.persist()
    if path is not None:  # row ids are hashed once, the cuts are found in the written hashes
        zoned = raw.select("row_id", "y", "features", u32(seed, "split", F.col("row_id")).alias("_h"))
        zoned = zoned.withColumn("_zone", split.zone(F.col("_h"), test_pct, val_pct))
        with open_writers(spark):
            plainly(zoned.write, ["row_id", "_h"]).partitionBy("_zone").parquet(path)
        df = split.split_zones(spark.read.schema(zoned.schema).parquet(path), test_pct, val_pct)
    else:
        df = split.stratified_split(raw, seed=seed, test_pct=test_pct, val_pct=val_pct)
    means, sds = scale.fit(df, d=len(names))
    df = df.withColumn("features", scale.apply(F.col("features"), means, sds))
    return Abt(df.select("row_id", "y", "split", "features"), names, means, sds)


# ---------------------------------------------------------------- fixtures

DOC_WORD = "[^ \\t\\n\\r]+"


def raw_embeddings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    e = table(spark, sf_dir, "embeddings")
    d = e.select(F.max(F.size("embedding"))).first()[0]
    df = e.select(
        F.col("vec_id").alias("row_id"),
        (F.col("label") < 5).cast("int").alias("y"),
        F.transform("embedding", lambda v: v.cast("double")).alias("features"),
    )
    return df, [f"e{i}" for i in range(d)]


def raw_planted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    df, names = raw_embeddings(spark, sf_dir)
    f = F.col("features")
    return df.withColumn("y", ((f[3] + f[10] - f[20]) > 0).cast("int")), names


def raw_lineitem(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    li = table(spark, sf_dir, "lineitem")
    rid = F.concat_ws(
        ":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int")
    )
    base = li.select(
        rid.alias("row_id"),
        (F.col("l_linestatus") == "F").cast("int").alias("y"),
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        F.col("l_linenumber").cast("double").alias("l_linenumber"),
        F.month("l_shipdate").cast("double").alias("ship_month"),
        "l_returnflag",
    )
    nums = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "ship_month"]
    base, oh = encode.one_hot(base, ["l_returnflag"])
    names = nums + oh
    return base.select("row_id", "y", encode.pack(names).alias("features")), names


def raw_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")

    def occurring(chars):
        return F.length("text") - F.length(F.translate("text", chars, ""))

    # the numbers first: the text itself is never shuffled
    measured = docs.select(
        "doc_id",
        F.col("n_chars").cast("double").alias("n_chars"),
        (F.length(F.regexp_replace("text", DOC_WORD, "x")) - occurring(" \t\n\r")).cast("double").alias("n_words"),
        occurring("0123456789").cast("double").alias("n_digits"),
        (occurring("\n") + 1).cast("double").alias("n_lines"),
        "lang",
        "source",
    )
    base = measured.join(labels.select("doc_id", F.col("quality").cast("int").alias("y")), "doc_id").withColumnRenamed(
        "doc_id", "row_id"
    )
    nums = ["n_chars", "n_words", "n_digits", "n_lines"]
    base, oh = encode.one_hot(base, ["lang", "source"])
    names = nums + oh
    return base.select("row_id", "y", encode.pack(names).alias("features")), names


def raw_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    o = table(spark, sf_dir, "orders")
    base = o.select(
        F.col("o_orderkey").alias("row_id"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        "o_totalprice",
        F.month("o_orderdate").cast("double").alias("order_month"),
        "o_orderpriority",
    )
    nums = ["o_totalprice", "order_month"]
    base, oh = encode.one_hot(base, ["o_orderpriority"])
    names = nums + oh
    return base.select("row_id", "y", encode.pack(names).alias("features")), names


RAW = {
    "embeddings": raw_embeddings,
    "planted": raw_planted,
    "lineitem": raw_lineitem,
    "documents": raw_documents,
    "orders": raw_orders,
}


def load(spark: SparkSession, sf_dir: str, name: str, seed: int = 0, path: str | None = None) -> Abt:
    if name not in RAW:
        raise ValueError(f"unknown dataset {name!r}; valid: {', '.join(RAW)}")
    raw, names = RAW[name](spark, sf_dir)
    return build(raw, names, seed=seed, path=path)


# ---------------------------------------------------------------- SQL twins
# Each returns (rows_sql, long_sql): rows_sql yields (row_id, y); long_sql
# yields (row_id, gene BIGINT, x DOUBLE) of the raw (unscaled) features.

def _onehot_sql(src: str, col: str, offset: str) -> str:
    return f"""SELECT r.row_id, CAST({offset} + lv.li AS BIGINT) AS gene,
  CASE WHEN r.{col} = lv.lvl THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS x
FROM {src} r, (SELECT lvl, row_number() OVER (ORDER BY lvl) - 1 AS li
               FROM (SELECT DISTINCT {col} AS lvl FROM {src})) lv"""


def _numeric_sql(src: str, cols: list[str]) -> str:
    parts = [
        f"SELECT row_id, CAST({i} AS BIGINT) AS gene, CAST({c} AS DOUBLE) AS x FROM {src}"
        for i, c in enumerate(cols)
    ]
    return "\nUNION ALL ".join(parts)


def raw_sql(name: str) -> tuple[str, str]:
    if name in ("embeddings", "planted"):
        if name == "embeddings":
            y = "CAST(label < 5 AS INTEGER)"
        else:
            y = "CAST(CAST(embedding[4] AS DOUBLE) + CAST(embedding[11] AS DOUBLE) - CAST(embedding[21] AS DOUBLE) > 0 AS INTEGER)"
        rows = f"SELECT vec_id AS row_id, {y} AS y FROM embeddings"
        long = (
            "SELECT vec_id AS row_id, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS gene, "
            "CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings"
        )
        return rows, long
    if name == "lineitem":
        src = """(SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER)) AS row_id,
  CAST(l_linestatus = 'F' AS INTEGER) AS y, l_quantity, l_extendedprice, l_discount, l_tax,
  CAST(l_linenumber AS DOUBLE) AS l_linenumber, CAST(month(l_shipdate) AS DOUBLE) AS ship_month, l_returnflag
  FROM lineitem)"""
        nums = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "ship_month"]
        rows = f"SELECT row_id, y FROM {src}"
        long = _numeric_sql(src, nums) + "\nUNION ALL " + _onehot_sql(src, "l_returnflag", "6")
        return rows, long
    if name == "documents":
        src = """(SELECT d.doc_id AS row_id, CAST(l.quality AS INTEGER) AS y, CAST(d.n_chars AS DOUBLE) AS n_chars,
  CAST(len(regexp_extract_all(d.text, '[^ \t\n\r]+')) AS DOUBLE) AS n_words,
  CAST(len(regexp_extract_all(d.text, '[0-9]')) AS DOUBLE) AS n_digits,
  CAST(len(regexp_extract_all(d.text, '\n')) + 1 AS DOUBLE) AS n_lines,
  d.lang, d.source
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
        nums = ["n_chars", "n_words", "n_digits", "n_lines"]
        rows = f"SELECT row_id, y FROM {src}"
        long = (
            _numeric_sql(src, nums)
            + "\nUNION ALL "
            + _onehot_sql(src, "lang", "4")
            + "\nUNION ALL "
            + _onehot_sql(src, "source", f"(4 + (SELECT count(DISTINCT lang) FROM {src}))")
        )
        return rows, long
    if name == "orders":
        src = """(SELECT o_orderkey AS row_id, CAST(o_orderstatus = 'F' AS INTEGER) AS y, o_totalprice,
  CAST(month(o_orderdate) AS DOUBLE) AS order_month, o_orderpriority FROM orders)"""
        rows = f"SELECT row_id, y FROM {src}"
        long = _numeric_sql(src, ["o_totalprice", "order_month"]) + "\nUNION ALL " + _onehot_sql(
            src, "o_orderpriority", "2"
        )
        return rows, long
    raise ValueError(name)
