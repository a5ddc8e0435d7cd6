"""Session helpers for local runs and tests, and the shared checkpoint folder."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "featsearch") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )


# Settings for large clusters: the scoring passes read wide splits through
# Python workers, so fewer, larger input splits amortise worker overhead;
# every shuffle here is tiny (P rows per task), so AQE may coalesce freely.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.files.maxPartitionBytes": str(512 << 20),
    "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
    "spark.sql.shuffle.partitions": "2000",
}
# Core settings that only take effect at submit time (``--conf``).
SUBMIT_CONF = {"spark.task.maxFailures": "8", "spark.speculation": "true", "spark.scheduler.mode": "FAIR"}


def apply_cluster_conf(spark: SparkSession) -> None:
    """Apply :data:`CLUSTER_CONF` where the session does not set a value."""
    for k, v in CLUSTER_CONF.items():
        if spark.conf.get(k, None) in (None, ""):
            spark.conf.set(k, v)


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Read from the session; only when unset is a folder set: ``fallback``, or
    for a local master (tests, bench) a fresh temporary one. A cluster
    without the setting is refused rather than given a machine-local folder.
    """
    sc = spark.sparkContext
    cur = sc._jsc.sc().getCheckpointDir()
    if cur.isDefined():
        return cur.get()
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return conf
    if fallback is None and not sc.master.startswith("local"):
        # a machine-local folder would be invisible to the executors
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS, object store) for this cluster")
    path = fallback or tempfile.mkdtemp(prefix="featsearch-ckpt-")
    sc.setCheckpointDir(path)
    return path


def plainly(writer: DataFrameWriter, columns) -> DataFrameWriter:
    """For columns whose values hardly repeat (keys, hashes): Parquet would fill a
    dictionary of them and throw it away."""
    return writer.options(**{f"parquet.enable.dictionary#{c}": "false" for c in columns})


def written(df: DataFrame, tag: str, plain=()) -> DataFrame:
    """``df`` written once below the checkpoint folder and read back; ``plain``:
    columns as in ``plainly``."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"
    plainly(df.write, plain).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Folders of a partitioned write that a task keeps open.
OPEN_WRITERS = 8
_WRITING: list = []  # per write under way, the setting that it found
_WRITING_LOCK = threading.Lock()


@contextlib.contextmanager
def open_writers(spark: SparkSession):
    """For partitioned writes into a few folders: a task keeps one file open per
    folder and does not sort (and spill) all its rows first. Of writes that
    overlap, the last to end restores the setting."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    with _WRITING_LOCK:
        _WRITING.append(_WRITING[0] if _WRITING else spark.conf.get(name))
        spark.conf.set(name, str(OPEN_WRITERS))
    try:
        yield
    finally:
        with _WRITING_LOCK:
            before = _WRITING.pop()
            if not _WRITING:
                spark.conf.set(name, before)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``featsearch`` importable in Python workers (``addPyFile``, once per app)."""
    import os
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="featsearch-py-"), "featsearch.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(app)


# Task payloads above this size travel as broadcast variables (once per
# executor) instead of inside the task closure (once per task).
BROADCAST_MIN_BYTES = 1 << 20


class Payload:
    """A driver-side value for tasks: inline when small, broadcast when large.

    ``get()`` works on executors; ``release()`` drops a broadcast once the
    job that needed it has run.
    """

    def __init__(self, spark: SparkSession, value, nbytes: int):
        self._bc = spark.sparkContext.broadcast(value) if nbytes >= BROADCAST_MIN_BYTES else None
        self._value = None if self._bc is not None else value

    def get(self):
        return self._bc.value if self._bc is not None else self._value

    def release(self):
        if self._bc is not None:
            self._bc.unpersist()

    def __getstate__(self):
        return {"_bc": self._bc, "_value": self._value}

    def __setstate__(self, st):
        self._bc, self._value = st["_bc"], st["_value"]


# Scoring and fitting passes emit P rows per task, so their shuffle grows with
# the number of tasks, not with the data. Inputs split finer than this are
# coalesced (no shuffle: each task reads several splits).
MAX_SCORING_TASKS = 4096


def bounded_tasks(df: DataFrame) -> DataFrame:
    """Cap the tasks of a per-task-emitting pass at ``spark.featsearch.maxScoringTasks``.

    ``coalesce`` never adds partitions, so nothing is counted first.
    """
    return df.coalesce(int(df.sparkSession.conf.get("spark.featsearch.maxScoringTasks", str(MAX_SCORING_TASKS))))
