"""Stored score table: confusion counts of gene sets, shared by generations,
runs and restarts.

A fit is a function of the prepared rows, the model and the gene set, so a
count is stored under (dataset fingerprint, model with its options, split,
packed genes) and a chromosome that any run has scored is never fitted again.
"""

from __future__ import annotations

import threading

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTS = ("tp", "fp", "fn", "tn")
SCHEMA = "dataset string, model string, split string, genes binary, tp bigint, fp bigint, fn bigint, tn bigint"


def fingerprint(abt: DataFrame) -> str:
    """128 bits and the row count of a prepared dataset, in one aggregation that
    does not depend on the order of rows (their ids are unique)."""
    cols = [F.col(f"`{c}`") for c in sorted(abt.columns)]
    r = abt.agg(F.bit_xor(F.xxhash64(*cols)).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), *cols)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    return f"{(r['a'] or 0) & (1 << 64) - 1:016x}{(r['b'] or 0) & (1 << 64) - 1:016x}-{r['n']}"


def model_key(model) -> str:
    """Name and plain options of a model."""
    options = {k: v for k, v in vars(model).items() if not k.startswith("_") and isinstance(v, (bool, int, float, str, type(None)))}
    return ",".join([model.name, *(f"{k}={options[k]}" for k in sorted(options) if k not in ("name", "batched"))])


def packed(bits: np.ndarray) -> bytes:
    """The width, then eight genes a byte."""
    return len(bits).to_bytes(4, "big") + np.packbits(bits.astype(np.uint8)).tobytes()


class ScoreTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._lock = threading.Lock()  # runs of one application append one at a time

    def _exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def read(self) -> DataFrame:
        if not self._exists():
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def known(self, dataset: str, model: str, split: str, rows: np.ndarray) -> dict:
        """Counts of those gene sets (rows of 0/1) that the table holds, by the
        bytes of the row. The wanted sets, at most a population, are broadcast."""
        if not len(rows) or not self._exists():
            return {}
        keys = {packed(r): r.tobytes() for r in rows}
        wanted = self.spark.createDataFrame([(bytearray(k),) for k in keys], "genes binary")
        mine = self.read().where((F.col("dataset") == dataset) & (F.col("model") == model) & (F.col("split") == split))
        found = mine.join(F.broadcast(wanted), "genes", "left_semi").dropDuplicates(["genes"]).collect()
        return {keys[bytes(r["genes"])]: r for r in found}

    def add(self, dataset: str, model: str, split: str, counts: dict, width: int) -> None:
        """Append ``counts``: bytes of a 0/1 row -> mapping with the four counts."""
        if not counts:
            return
        rows = [
            (dataset, model, split, bytearray(packed(np.frombuffer(k, np.int8)[:width])), *(int(c[n]) for n in COUNTS))
            for k, c in counts.items()
        ]
        with self._lock:
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def compact(self, target: str) -> "ScoreTable":
        """The distinct rows in few files under ``target``, sorted by key so that
        a lookup prunes row groups."""
        keys = ["dataset", "model", "split", "genes"]
        self.read().dropDuplicates(keys).repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(target)
        return ScoreTable(self.spark, target)
