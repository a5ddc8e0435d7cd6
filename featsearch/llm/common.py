"""Helpers shared by the operators: words, written tables, skew-safe joins."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featsearch.session import checkpoint_dir, ship_package

#: White space of all word rules: blank and the controls 9 to 13.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    The folder is ``spark.checkpoint.dir``, so a lost executor costs nothing
    that was written, and later jobs read the table instead of its lineage.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words of a text column (null: 0), JVM only.

    Each word shrinks to one character; what is left beside white space is
    the count. No array of words is built.
    """
    text = F.coalesce(text, F.lit(""))
    spaces = F.length(text) - F.length(F.translate(text, SPACE, ""))
    return F.length(F.regexp_replace(text, WORD, "x")) - spaces


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Equi-join on ``key`` whose hot keys Spark may split at run time.

    ``right`` is usually an aggregate by ``key`` and therefore already
    partitioned by it; Spark then shuffles the left side alone and cannot
    split a hot partition. A second key made from the first (``mix``) asks for
    a fresh exchange of both sides, which adaptive skew handling can cut.
    """
    mix = F.xxhash64(F.col(key), F.lit(1))
    return (
        left.withColumn("__mix", mix)
        .join(right.withColumn("__mix", mix), [key, "__mix"], how)
        .drop("__mix")
    )


#: Narrow rows that are broadcast at most (under 32 MB).
SMALL = 1 << 20


def join_sized(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Equi-join with a stored narrow table: broadcast if it has at most
    ``SMALL`` rows, otherwise ``join_hot``."""
    if right.count() <= SMALL:
        return left.join(F.broadcast(right), key, how)
    return join_hot(left, right, key, how)


def python_ready(spark: SparkSession, rows: int = 1000) -> None:
    """Ship this package to Python workers; bound Arrow batches to ``rows``
    records and 16 MB."""
    ship_package(spark)
    conf = spark.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
